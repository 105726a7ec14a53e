"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from seamark.plans import catalog
from tests.oracle import compare, connect

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(catalog.queries()[name](spark, DIR), con, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, DIR)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
