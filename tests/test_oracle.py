"""Every registered query with a SQL twin gives the same rows, columns and types as the twin."""

import pytest

from check import compare, connect
from tasteloom.registry import QUERIES, oracles

SQL = oracles()
PROPERTY_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), SQL[name], con) is None


@pytest.mark.parametrize("name", PROPERTY_ONLY)
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["k", "HitRate", "Recall", "NDCG", "MRR"]
    assert set(e.oracle_sql()) <= set(e.queries())
