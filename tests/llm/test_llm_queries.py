"""The registered queries of the subpackage on the smallest tables."""

import pytest

from compare import connect, differences
from patronage.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, connection, name):
    assert differences(QUERIES[name](spark, small), connection, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
