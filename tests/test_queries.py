"""Every registered query against its SQL check on the small tables."""

import pytest
from oracle import compare, connect

from siftwright.plans import CHECKS, QUERIES

# Full fits take minutes: tests/check_queries.py and the driver hold them against SQL, test_models.py covers the operators.
FITS = {
    "model_comparison", "label_signal_none", "label_signal_control", "cost_weighted_comparison", "permutation_importance", "sampled_shapley",
    "mixture_bic", "mixture_fit",
}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_registry_is_consistent():
    assert set(CHECKS) == set(QUERIES) and FITS < set(CHECKS)


@pytest.mark.parametrize("name", sorted(set(CHECKS) - FITS))
def test_query_matches_sql(spark, folder, con, name):
    diff = compare(QUERIES[name](spark, folder), con, CHECKS[name])
    assert diff is None, diff


def test_entry_is_the_impact_table(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["metric", "naive", "audited", "change"]
    assert set(CHECKS) <= set(e.oracle_sql()) <= set(e.queries())
