"""Every registered query against its SQL on DuckDB, over whole tables."""

import os
import sys

import pytest

import __spark_entry__ as contract

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import database, difference  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql_side():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_agrees_with_sql(spark, sql_side, name):
    found = contract.queries()[name](spark, FOLDER).toPandas()
    assert len(found)
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        assert difference(found, sql_side.execute(sql).df()) is None


def test_entry_has_a_stable_schema(spark, sql_side):
    assert contract.entry(spark).columns == contract.entry(spark).columns
    assert set(contract.oracle_sql()) <= set(contract.queries())
