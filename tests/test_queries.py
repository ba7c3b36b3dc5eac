"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, open_tables

import __spark_entry__ as driver
from loghelm.plans import catalog

DIRECTORY = "/root/testdata/sf0.001"
# The optional operators have tests of their own.
QUERIES = {name: query for name, query in driver.queries().items() if name in catalog.QUERIES}
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def tables():
    return open_tables(DIRECTORY)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    assert compare(QUERIES[name](spark, DIRECTORY), tables, SQL[name]) is None
