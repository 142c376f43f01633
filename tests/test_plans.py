"""Physical plans: no cross join anywhere, Python only behind an aggregate."""

import re

import pytest

from siftwright.plans import CHECKS, QUERIES

# these stop on a result table, so their plan is only a scan
STORED = {n for n in CHECKS if n.startswith("stream_")}
# fits run whole when the query is built
FITS = {
    "oof_scores", "model_comparison", "label_signal_none", "label_signal_control", "cost_weighted_comparison", "permutation_importance",
    "sampled_shapley", "logistic_attribution", "score_sink", "mixture_bic", "mixture_fit",
}
TAILS = {
    "issue_register", "severity_rollup", "resolution_rollup", "reconcile", "clean_bill", "tail_excess_lognormal", "zero_floor",
    "welch_t", "chi2_yates", "ks_uniform", "normal_fit_bands",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(CHECKS) - STORED - FITS))
def test_plan(spark, folder, name):
    plan = _plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) <= (name in TAILS)


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = _plan(QUERIES["before_start_by_month"](spark, folder))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(scans) == ["l_orderkey:bigint,l_shipdate:timestamp_ntz", "o_orderkey:bigint,o_orderdate:timestamp_ntz"]
    kept = _plan(spark.read.parquet(f"{folder}/lineitem.parquet").where("l_quantity > 49").groupBy("l_returnflag").count())
    assert "GreaterThan(l_quantity,49.0)" in kept


def test_quantiles_use_no_single_buffer(spark, folder):
    plan = _plan(QUERIES["quantile_profile"](spark, folder))
    assert "percentile(" not in plan and "TakeOrderedAndProject" in plan


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name,table", [("roc_auc", "labels"), ("quantile_profile", "lineitem"), ("calibration", "labels"), ("psi_by_period", "orders")])
def test_order_statistics_read_stored_values(spark, folder, no_broadcast, name, table):
    # the input has run once, into the stored table of distinct values, when the result's plan is made
    from siftwright.operators import ordering as O

    df = spark.read.parquet(f"{folder}/{table}.parquet")
    column = {"labels": "doc_id", "lineitem": "l_extendedprice", "orders": "o_totalprice"}[table]
    plan = _plan(O.quantiles(df, column, {"m": 0.5}))
    assert f"{table}.parquet" not in plan and "values-" in plan


@pytest.mark.parametrize("name", ["stratified_folds", "fold_sizes", "decile_lift", "label_permutation"])
def test_positions_run_their_input_once(spark, folder, no_broadcast, name):
    plan = _plan(QUERIES[name](spark, folder))
    # all scans are of stored rows; the tables were read when those were written
    assert "positions-" in plan and not re.findall(r"\w+\.parquet\]", plan)


def test_duplicate_classes_use_hash_tables(spark, folder, no_broadcast):
    for name in ("dup_classes", "dup_row_flags"):
        assert "SortAggregate" not in _plan(QUERIES[name](spark, folder))


def test_hot_entity_is_reduced_before_the_join(spark, folder, no_broadcast):
    from siftwright.operators import integrity as I

    facts = I.date_counts(spark.read.parquet(f"{folder}/lineitem.parquet"), "l_orderkey", "l_shipdate")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate")
    plan = _plan(I.flag_before_start(facts, orders, fact_key="l_orderkey", entity_key="o_orderkey", fact_date="l_shipdate", start_date="o_orderdate"))
    assert plan.index("SortMergeJoin") < plan.index("HashAggregate")
