"""The registered queries and their DuckDB counterparts agree on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import compare

ORACLE = contract.oracle_sql()
# Needs the full forest: covered by test_models with a small one.
HEAVY = {"model_split", "attribution_additivity", "model_properties"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(ORACLE) - HEAVY))
def test_same_rows(spark, sf, duck, name):
    rows = contract.queries()[name](spark, sf).toPandas()
    assert compare(rows, duck.execute(ORACLE[name]).df()) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 1000
