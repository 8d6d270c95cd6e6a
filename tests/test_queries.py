"""Every registered query against its SQL, on the smallest tables."""

import pytest

from compare import connect, differences
from patronage.registry import QUERIES, SQL

SLOW = {"ml_kmeans_labels", "ml_elbow", "ml_leaderboard", "ml_blend_predictions"}


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, connection, name):
    assert differences(QUERIES[name](spark, small), connection, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs_without_sql_counterpart(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry_point

    assert entry_point.entry(spark).count() > 0
