"""Queries with a SQL check against it, and the entry's list."""

import pytest
from oracle import compare, connect

from siftwright.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, folder, name):
    assert compare(QUERIES[name](spark, folder), connect(folder), CHECKS[name]) is None


def test_entry_lists_all():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names and set(e.oracle_sql()) <= set(names)
