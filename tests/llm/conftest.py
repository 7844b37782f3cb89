import pytest

from alertloom.llm.common import tuned


@pytest.fixture
def table(spark):
    """A DataFrame from rows and a schema, split over a few partitions."""
    tuned(spark)

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make
