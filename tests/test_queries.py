"""Every named query: equal to its SQL, or, without one, runs and yields rows."""

import pytest
from compare import connect, mismatch

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, con):
    assert mismatch(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["hemisphere", "household_id"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
