"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert difference(result, sql, duck) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
