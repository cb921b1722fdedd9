"""The registered queries of the subpackage against their SQL on the smallest tables, and their columns."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences
from conftest import SMALL
from lexistat.llm.checks import CHECKS


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, name):
    assert differences(spark, connect(SMALL), entry.queries()[name], CHECKS[name], SMALL) == []


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
