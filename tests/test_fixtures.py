"""Planted defects with known counts, and invariants of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.functions import tails
from siftwright.functions.scalars import swap_month_day
from siftwright.operators import detectors as D
from siftwright.operators import evaluate as E
from siftwright.operators import features as V
from siftwright.operators import integrity as I
from siftwright.operators import mixture as M
from siftwright.operators import models as L
from siftwright.operators import monitor as G
from siftwright.operators import register as R
from siftwright.operators import repair as X
from siftwright.operators import statistics as S


def test_exact_duplicates_with_equal_nulls(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", None), ("b", None), ("c", 3.0), ("c", 3.0), ("d", 4.0), ("e", None), ("e", 1.0)]
    df = spark.createDataFrame(rows, "k string, age double")
    got = {r["dup_class"]: (r["n_keys"], r["n_rows"]) for r in I.duplicate_summary(df, ["k"]).collect()}
    assert got == {"exact": (3, 6), "unique": (1, 1), "conflict": (1, 2)}
    flagged = I.classify_duplicates(df, ["k"])
    assert flagged.count() == len(rows) and flagged.where("dup_class = 'conflict'").count() == 2
    kept = {r["k"]: r for r in I.keep_first(df, ["k"]).collect()}
    assert len(kept) == 5 and kept["e"]["age"] is None and kept["e"]["dq_dup_conflict"] and not kept["b"]["dq_dup_conflict"]
    assert I.differing_columns(df, ["k"]).collect()[0].asDict() == {
        "k": "e", "n_rows": 2, "n_differing": 1, "differing_columns": "age"}


def test_keep_first_follows_the_declared_order(spark):
    df = spark.createDataFrame([("a", 9, 2), ("a", 5, 1), ("b", 7, 3)], "k string, v int, seq int")
    assert {r["k"]: r["v"] for r in I.keep_first(df, ["k"], ["seq"]).collect()} == {"a": 5, "b": 7}


def test_null_key_is_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    flagged = I.classify_duplicates(df, ["k"]).collect()
    assert sorted(r["dup_class"] for r in flagged) == ["conflict", "conflict", "unique"]


def test_date_swaps(spark):
    rows = [("a", "2022-06-09"), ("a", "2022-09-06"), ("b", "2022-01-02"), ("b", "2022-03-04"), ("c", "2022-05-25"), ("c", "2022-05-06"),
            ("d", "2022-01-02"), ("d", "2022-07-07"), ("d", "2022-02-01"), ("e", "2022-03-03"), ("e", "2022-03-03")]
    df = spark.createDataFrame(rows, "k string, d string").withColumn("d", F.to_date("d"))
    got = {r["k"]: (r["n_dates"], r["has_swap"]) for r in I.date_swap_pairs(df, ["k"], "d").collect()}
    assert got == {"a": (2, True), "b": (2, False), "c": (2, False), "d": (3, True)}
    assert df.select(swap_month_day("d").alias("s")).where("s is null").count() == 1


def test_before_start_keeps_all_rows(spark):
    fact = spark.createDataFrame([(1, dt.date(2023, 1, 31)), (1, dt.date(2023, 2, 28)), (2, dt.date(2023, 1, 31)), (9, dt.date(2023, 1, 1))], "k int, m date")
    ent = spark.createDataFrame([(1, dt.date(2023, 2, 15)), (2, dt.date(2020, 1, 1))], "e int, s date")
    flagged = I.flag_before_start(fact, ent, fact_key="k", entity_key="e", fact_date="m", start_date="s")
    row = I.before_start_summary(flagged, "k").first()
    assert (row["n_rows"], row["affected_rows"], row["affected_entities"], row["max_days"], row["median_days"]) == (4, 1, 1, 15, 15.0)


def test_mixture_separates_the_contaminant(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(50, 15, 5000), rng.normal(257, 65, 50)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    one, two = M.fit_mixtures(df, "x", ks=(1, 2), n_init=2)
    low, high = two.components
    assert two.bic < one.bic and high.weight == pytest.approx(0.01, abs=0.004)
    assert low.mean == pytest.approx(50, abs=1.5) and high.mean == pytest.approx(255, abs=30)
    flagged = df.where(M.is_contaminated("x", two))
    assert 40 <= flagged.count() <= 60 and flagged.agg(F.min("x")).first()[0] > 80
    close = M.Mixture(10, 0.0, (M.Component(0.5, 10.0, 5.0), M.Component(0.5, 12.0, 5.0)))
    assert df.where(M.is_contaminated("x", close)).count() == 0


def test_zero_floor_counts_clipped_values(spark):
    x = np.clip(np.random.default_rng(1).normal(3, 3, 4000), 0, None)
    row = D.zero_floor(spark.createDataFrame([(float(v), 1.0) for v in x], "x double, c double"), "x", ["c"]).first()
    assert row["at_zero"] == int((x == 0).sum()) and row["below_zero"] == 0 and row["c_at_zero"] == 1.0


def test_panel_features_edge_cases(spark):
    rows = [("flat", t, 5.0) for t in range(1, 13)] + [("nobase", t, 0.0 if t <= 3 else float(t)) for t in range(1, 13)] + [("one", 1, 2.0)]
    got = {r["k"]: r for r in V.panel_features(spark.createDataFrame(rows, "k string, t int, v double"), "k", {"m": "v"}, extras=True).collect()}
    assert got["flat"]["m_slope"] == 0.0 and got["flat"]["m_trend_r2"] == 0.0 and got["flat"]["m_declining"] == 0
    assert got["nobase"]["m_halfratio"] is None and got["nobase"]["m_last3"] == pytest.approx(11.0)
    assert got["nobase"]["m_last_minus_first"] == 12.0 and got["one"]["m_slope"] == 0.0 and got["one"]["m_halfratio"] == 1.0
    v = np.array([0, 0, 0] + list(range(4, 13)), float)
    t = np.arange(1, 13)
    assert got["nobase"]["m_slope"] == pytest.approx(np.polyfit(t, v, 1)[0])
    assert got["nobase"]["m_trend_r2"] == pytest.approx(np.corrcoef(t, v)[0, 1] ** 2)
    assert got["nobase"]["m_sd"] == pytest.approx(v.std()) and got["nobase"]["m_median"] == np.median(v)


def test_missing_indicator_and_median(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0), (3, 10.0, 1.0), (4, 4.0, 1.0)], "k int, a double, b double")
    gaps = V.null_columns(df, ["a", "b"])
    got = {r["k"]: (r["a"], r["a_nobase"]) for r in V.fill_with_indicator(df, ["a", "b"], gaps).collect()}
    assert gaps == ["a"] and got[2] == (4.0, 1) and got[1] == (2.0, 0)


def _psi_by_hand(base, comp, bins=10):
    q = np.quantile(base, np.linspace(0, 1, bins + 1))
    inner = np.unique(q[1:-1])
    b = np.bincount(np.searchsorted(inner, base, side="right"), minlength=len(inner) + 1) / len(base)
    c = np.bincount(np.searchsorted(inner, comp, side="right"), minlength=len(inner) + 1) / len(comp)
    b, c = np.maximum(b, 1e-6), np.maximum(c, 1e-6)
    return float(((c - b) * np.log(c / b)).sum())


def test_psi_identity_shift_and_ties(spark):
    rng = np.random.default_rng(5)
    x, three = rng.normal(0, 1, 2000), rng.integers(0, 3, 2000).astype(float)
    rows = [(1, float(a), float(b)) for a, b in zip(x, three)] + [(2, float(a + 1), float(b)) for a, b in zip(x, three)]
    out = G.psi(spark.createDataFrame(rows, "p int, x double, three double"), "p", ["x", "three"], F.col("p") == 1)
    got = {(r["metric"], r["p"]): r for r in out.collect()}
    assert got["x", 1]["psi"] == pytest.approx(0.0, abs=1e-12) and got["x", 1]["in_reference"] and not got["x", 2]["in_reference"]
    assert got["x", 2]["psi"] > 0.25 and got["x", 2]["psi"] == pytest.approx(_psi_by_hand(x, x + 1))
    assert got["three", 2]["psi"] == pytest.approx(0.0, abs=1e-12)
    steps = {r["metric"]: r["alarm"] for r in G.step_change(out, "p", F.lit(1)).collect()}
    assert steps == {"x": "major", "three": "stable"}


def test_score_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    row = E.score_metrics(df, "s", "y").first()
    assert row["roc_auc"] == pytest.approx(0.75) and row["average_precision"] == pytest.approx(0.8333333, abs=1e-6)
    tied = E.score_metrics(df.withColumn("s", F.lit(0.3)), "s", "y").first()
    assert tied["roc_auc"] == 0.5 and tied["average_precision"] == 0.5


def test_equal_count_deciles(spark):
    df = spark.createDataFrame([(i, i / 23.0, i % 2) for i in range(23)], "k int, s double, y int")
    got = E.decile_lift(df, "s", "y", "k").orderBy("decile").collect()
    assert [r["n"] for r in got] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2] and got[-1]["cum_recall"] == pytest.approx(1.0)
    small = E.decile_lift(df.where("k < 4"), "s", "y", "k").orderBy("decile").collect()
    assert [r["n"] for r in small] == [1, 1, 1, 1]


def test_published_policy_costs(spark):
    # 10,000 entities, 786 positives, offer 1, loss 5
    df = spark.range(10000).select((F.col("id") < 786).cast("int").alias("y"), F.lit(0.0).alias("s"))
    cost = {r["policy"]: r for r in E.policy_costs(df, "s", "y").collect()}
    assert [cost[p]["cost"] for p in ("nobody", "everybody", "perfect")] == [3930.0, 10000.0, 786.0]
    assert cost["perfect"]["saving"] == 3144.0 and cost["perfect"]["share_of_achievable"] == 1.0
    assert (3930 - 4039) / 3144 == pytest.approx(-0.0347, abs=1e-4)
    # cheapest is decided by cost, not by name
    sens = {r["ratio"]: r["cheapest"] for r in E.cost_sensitivity(df, "s", "y").collect()}
    assert sens[1.0] == "nobody" and sens[20.0] == "everybody"


def test_policy_bounds_and_sweep(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(rng.random()), int(rng.random() < 0.1)) for i in range(500)], "k int, s double, y int")
    pdf = df.toPandas()
    taus = [i / 20 for i in range(21)]
    for r in E.cost_curve(df, "s", "y", taus).collect():
        pred = pdf.s >= r["tau"]
        assert r["tp"] == int((pred & (pdf.y == 1)).sum()) and r["fp"] == int((pred & (pdf.y == 0)).sum())
        assert r["cost"] == pred.sum() + 5 * (~pred & (pdf.y == 1)).sum()
        assert pdf.y.sum() <= r["cost"] <= len(pdf) + 5 * pdf.y.sum()


def test_folds_and_permutations_keep_class_counts(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    sizes = L.stratified_folds(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    drawn = L.permute_labels(df, "id", "y", 3)
    assert {r["draw"]: (r["n"], r["p"]) for r in drawn.groupBy("draw").agg(F.count("y").alias("n"), F.sum("y").alias("p")).collect()} == {
        d: (1003, 101) for d in range(3)}


def test_fan_out_and_impact_arithmetic(spark):
    a = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "k int, y int")
    assert I.fan_out(a, b, "k", "k").first()["rows_out"] == a.join(b, "k").count() == 4
    kept = I.keep_first(a, ["k"], ["v"])
    got = {r["metric"]: (r["naive"], r["audited"]) for r in X.impact(
        a, kept, b, key="k", label_key="k", label="y", metrics={"v": ("v", "v")}).collect()}
    j = a.join(b, "k").agg(F.avg("y").alias("y"), F.avg("v").alias("v")).first()
    assert got["rows_joined"] == (4.0, 3.0) and got["label_rate"][0] == pytest.approx(j["y"]) and got["mean_v"][0] == pytest.approx(j["v"])


def test_reconcile_fails_loudly(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    e = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.4, 0.5), ("c", 3.0, 0.0)], "name string, expected double, tolerance double")
    checks = R.reconcile(m, e)
    assert {r["name"]: r["passed"] for r in checks.collect()} == {"a": True, "b": True, "c": False}
    with pytest.raises(ValueError, match="1 checks") as failure:
        R.require_all(checks)
    written = spark.read.parquet(str(failure.value).split()[-1]).collect()
    assert [(r["name"], r["expected"]) for r in written] == [("c", 3.0)]
    assert {r["name"] for r in R.clean_bill(checks).collect()} == {"a", "b"}


def test_calendar_and_grid(spark):
    rows = [("a", dt.date(2023, 1, 31)), ("a", dt.date(2023, 3, 31)), ("b", dt.date(2023, 1, 31)), ("b", dt.date(2023, 5, 31))]
    df = spark.createDataFrame(rows, "e string, d date")
    assert sorted(str(r["period"]) for r in I.calendar_gaps(df, "d").collect()) == ["2023-02-01", "2023-04-01"]
    cells = sorted((r["entity"], str(r["period"])) for r in I.grid_missing_cells(df, "e", "d").collect())
    assert cells == [("a", "2023-05-01"), ("b", "2023-03-01")]
    row = I.period_hygiene(df, "e", "d").first()
    assert row["all_month_end"] and row["months_present"] == 3 and row["months_expected"] == 5 and row["surplus_pairs"] == 0


def test_chi2_of_a_known_table(spark):
    # [[10, 20], [30, 40]]: chi-square with continuity correction 0.4464, p 0.5040
    rows = [("r", 0)] * 10 + [("r", 1)] * 20 + [("s", 0)] * 30 + [("s", 1)] * 40
    row = S.chi2_tests(spark.createDataFrame(rows, "c string, y int"), ["c"], "y").first()
    assert row["chi2"] == pytest.approx(0.4464286, abs=1e-6) and row["p"] == pytest.approx(0.504036, abs=1e-5) and row["dof"] == 1


def test_tail_functions():
    assert tails.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert tails.student_t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.student_t_two_sided(0.0, 7.5) == pytest.approx(1.0)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(5.0, 2) == pytest.approx(math.exp(-2.5), rel=1e-12)
    assert tails.chi2_upper(18.307038053, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.kolmogorov_upper(1.3580986 / math.sqrt(1000), 1000) == pytest.approx(0.05, abs=1e-5)


def test_constant_columns_do_not_fail(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0)], "x double, y int")
    assert S.correlations(df, ["x"], "y").first()["r"] is None
    row = S.welch_tests(df, ["x"], "y").first()
    assert row["t"] is None and row["p"] is None
    assert D.zscore_outliers(df, ["x"]).first()["n_outside"] == 0
