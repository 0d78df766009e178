"""Every registered query equals its SQL (or, without one, returns rows)."""

import pytest

import __spark_entry__ as entry
from verify import compare


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf_dir, name):
    good, note = compare(spark, sf_dir, name)
    assert good, note
