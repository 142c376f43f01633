"""Feature notes, conflicting customers and filled gaps, on small planted tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwright.operators import features as V
from siftwright.operators import repair as X
from siftwright.plans import feature_queries as Q
from siftwright.sources.scratch import materialize
from siftwright.sources.tables import Tables


def test_notes_go_through_joins_filters_and_stored_tables(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double").select("k", V.noted("x", "x", "level", ["p", "q"], "why x"))
    b = spark.createDataFrame([(1, "u"), (3, "v")], "k int, s string").select("k", V.noted(F.upper("s"), "s", "name", ["s"], "why s"))
    table = materialize(V.join_features(a, "k", [b]).where("k > 0"), "noted")
    got = {r.feature: (r.family, r.inputs, r.rationale, r.n, r.n_missing, r["mean"]) for r in V.feature_catalogue(table).collect()}
    assert got == {"x": ("level", "p,q", "why x", 1, 1, 2.0), "s": ("name", "s", "why s", 1, 1, None)}
    with pytest.raises(ValueError):
        V.feature_catalogue(spark.range(3))
    empty = V.feature_catalogue(table.limit(0)).collect()
    assert {(r.feature, r.n) for r in empty} == {("x", 0), ("s", 0)}


def test_the_catalogue_lists_every_feature_and_only_those(spark, folder):
    table = Q.customer_features(Tables(spark, folder))
    noted = {f.name for f in table.schema.fields if V.NOTE in f.metadata}
    assert set(table.columns) - noted == {"o_custkey", "label", "dq_dup_conflict"}
    families = {f.metadata[V.NOTE]["family"] for f in table.schema.fields if V.NOTE in f.metadata}
    assert families == {"demographic", "contract", "usage_level", "usage_volatility", "usage_trend", "engagement"}


def _spoiled(spark, folder) -> Tables:
    t = Tables(spark, folder)
    t._scans["customer"] = spark.createDataFrame(
        [(1, 5.0, "MACHINERY", 0), (1, 5.0, "MACHINERY", 0), (2, 9.0, "BUILDING", 1), (2, -1.0, "BUILDING", 1), (3, 1.0, None, 2), (3, 1.0, "FURNITURE", 2), (4, 2.0, "BUILDING", 9)],
        "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int")
    t._scans["supplier"] = spark.createDataFrame([(0, 10.0), (0, 20.0), (1, -3.0), (1, 7.0), (2, 40.0)], "s_nationkey int, s_acctbal double")
    t._scans["orders"] = spark.createDataFrame([(1, datetime(1995, 3, 1)), (1, datetime(1999, 1, 1)), (3, datetime(1997, 5, 2))], "o_custkey long, o_orderdate timestamp_ntz")
    return t


def test_conflicting_customers_stay_once_and_flagged(spark, folder):
    rows = {r.o_custkey: r for r in Q.customer_entity(_spoiled(spark, folder)).collect()}
    assert {k: r.dq_dup_conflict for k, r in rows.items()} == {1: False, 2: True, 3: True, 4: False}
    assert rows[2].label == 1 and rows[3].c_mktsegment is None


def test_absent_and_invalid_suppliers_are_told_apart(spark, folder):
    rows = {r.o_custkey: (r.supply_imputed, r.supply_missing, r.supply_invalid) for r in Q.customer_entity(_spoiled(spark, folder)).collect()}
    # the median of the valid ones, 10 and 40, fills both kinds of gap
    assert rows == {1: (10.0, 0, 0), 2: (25.0, 0, 1), 3: (40.0, 0, 0), 4: (25.0, 1, 0)}


def test_repair_fills_gaps_behind_a_flag(spark):
    df = spark.createDataFrame([(1, 4.0), (1, 4.0), (2, 900.0), (3, None), (4, 8.0), (5, 6.0)], "k int, v double")
    out = X.repair_entities(df, ["k"], flags={"dq_high": F.coalesce(F.col("v") > 100, F.lit(False))}, clean={"v_clean": ("v", ["dq_high"])}, impute=["v_clean"])
    got = {r.k: (r.v, r.v_clean, r.v_clean_imputed, r.v_clean_missing) for r in out.collect()}
    assert got == {1: (4.0, 4.0, 4.0, False), 2: (900.0, None, 6.0, True), 3: (None, None, 6.0, True), 4: (8.0, 8.0, 8.0, False), 5: (6.0, 6.0, 6.0, False)}
