"""Every catalogue query with oracle SQL must match DuckDB on the sf0.01 tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"
_SQL = entry.oracle_sql()
_Q = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_matches_oracle(spark, con, name):
    problems, _, _ = compare(spark, con, name, _Q[name], _SQL[name], SF)
    assert not problems, problems


def test_every_oracle_has_query():
    assert set(_SQL) <= set(_Q)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "weighted_sentiment" in df.columns
