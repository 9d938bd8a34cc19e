"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare


@pytest.mark.parametrize("name", list(entry.queries()))
def test_matches_sql(spark, sf, duckdb_connection, name):
    ok, detail = compare(spark, name, sf, duckdb_connection)
    assert ok, detail
    assert "TYPES" not in detail, detail


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "rank"
