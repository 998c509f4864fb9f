"""Every registered query against its SQL, on whole tables."""

import pytest
from conftest import SF_DIR
from oracle import connect, difference

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert difference(spark, connection, QUERIES[name], SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_flagship(spark):
    found = driver.entry(spark)
    assert found.columns == ["vec_id", "similarity"] and found.count() == 10


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
