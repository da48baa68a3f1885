"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from pagetab.plans import queries

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert {x for x in SQL if x in queries.QUERIES} == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con: duckdb.DuckDBPyConnection, name):
    assert compare(spark, con, SF, entry.queries()[name], SQL[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "crawl_id" in df.columns
