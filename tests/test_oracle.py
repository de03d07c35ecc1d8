"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {name: driver.queries()[name] for name in driver.QUERIES}, driver.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) == set(QUERIES)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    diff, count, _ = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert diff == ""
    assert count > 0


def test_entry(spark):
    found = driver.entry(spark)
    assert found.columns == ["list", "path", "symbol_id", "name", "start_line"]
    assert found.count() > 0
