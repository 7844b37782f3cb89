import glob
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from alertloom.session import local_session  # noqa: E402
from alertloom.sources.files import parse_alerts, usable  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "alertloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not glob.glob(f"{SF}/*.parquet"):
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture
def make_alerts(spark):
    """Typed alerts from Python dicts, through the JSON parser."""
    def make(*alerts):
        rows = [(json.dumps(a),) for a in alerts]
        return usable(parse_alerts(spark.createDataFrame(rows, "value STRING")))
    return make
