"""Every registered query against its oracle SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare

SMALLEST = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "a_id", "b_id", "c_id", "start_us", "end_us"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    outcome = compare(spark, SMALLEST, name)
    assert outcome.startswith(("ok", "rows-only")), outcome
