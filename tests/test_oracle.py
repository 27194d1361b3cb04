"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks import compare
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return compare.duck(SMALL)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = compare.difference(spark, con, SMALL, QUERIES[name], ORACLE.get(name))
    assert problem is None
    assert rows > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert [r["K"] for r in df.orderBy("K").collect()] == [1, 3]
