"""Every registered query against its independent SQL."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

QUERIES, ORACLE = entry.QUERIES, entry.ORACLE


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_a_check():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, folder, con, name):
    assert difference(entry.queries()[name](spark, folder), con, ORACLE[name]) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["map", "r2", "relative_error", "cosine_mean", "cosine_p05"]
    assert result.count() == 1
