"""Registered queries against their SQL checks on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences
from conftest import SMALL

CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, entry.queries()[name], CHECKS[name], SMALL) == []


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(entry.queries())


def test_entry_has_one_row_per_language_and_one_for_all(spark):
    rows = entry.entry(spark).collect()
    assert rows[0]["Corpus"] == "Combined"
    assert rows[0]["N Texts"] == sum(r["N Texts"] for r in rows[1:])
