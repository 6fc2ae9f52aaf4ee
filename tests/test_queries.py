"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got, want, columns, sql_columns, _, _ = check(spark, con, TABLES, entry.queries()[name], entry.oracle_sql()[name])
    assert columns == sql_columns
    assert got == want
    assert got, "the query returned no rows"


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, TABLES).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
