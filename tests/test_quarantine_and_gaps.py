"""Quarantine, gap runs, dated results, malformed cells and the optimum of fits, on small planted tables."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.operators import integrity as I
from siftwright.operators import mixture as M
from siftwright.operators import models as L
from siftwright.operators import repair as X
from siftwright.sources import sinks
from siftwright.sources.tables import malformed_cells, read_csv_cells


def test_all_rows_of_a_conflicting_key_are_quarantined_and_none_is_lost(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, None), (4, None), (4, None), (None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "k int, v string")
    routed = X.route_conflicts(df, ["k"])
    parts = sinks.write_routed(routed, f"{tmp_path}/routed")
    assert sorted(((r.k, r.v) for r in parts[X.QUARANTINED].collect()), key=str) == sorted([(3, "a"), (3, None), (None, "x"), (None, "y")], key=str)
    assert sorted(((r.k, r.v) for r in parts[X.KEPT].collect()), key=str) == sorted([(1, "a"), (2, "a"), (2, "a"), (4, None), (4, None)], key=str)
    account = {r.route: (r.n_rows, r.n_keys, r.largest_key) for r in X.routed_account(routed, ["k"]).collect()}
    assert account == {"kept": (5, 3, 2), "quarantined": (4, 2, 2)} and sum(n for n, _, _ in account.values()) == len(rows)
    assert X.routed_account(X.route_conflicts(df.limit(0), ["k"]), ["k"]).count() == 0


def test_gaps_come_as_runs_at_both_ends_and_between(spark):
    months = {1: [1, 2, 3, 4, 5, 6], 2: [3], 3: [1, 2, 6], 4: [6], 5: [1, 3, 5]}
    df = spark.createDataFrame([(e, date(2024, m, 9)) for e, ms in months.items() for m in ms for _ in range(2)] + [(9, None)], "e int, d date")
    got = sorted((r.entity, r.first_period.month, r.last_period.month, r.n_periods) for r in I.grid_missing_runs(df, "e", "d").collect())
    assert got == [(2, 1, 2, 2), (2, 4, 6, 3), (3, 3, 5, 3), (4, 1, 5, 5), (5, 2, 2, 1), (5, 4, 4, 1), (5, 6, 6, 1)]
    cells = I.grid_missing_cells(df, "e", "d").groupBy("entity").count()
    assert {r.entity: r["count"] for r in cells.collect()} == {2: 5, 3: 3, 4: 5, 5: 3}
    assert I.grid_missing_runs(df.limit(0), "e", "d").count() == 0


def test_a_rerun_replaces_its_own_date_only(spark, tmp_path):
    path = f"{tmp_path}/results"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "n int, run_date string")
    for run in ("2024-01-31", "2024-02-29"):
        sinks.write_dated(one, path, run)
    out = sinks.write_dated(one.where("n = 2"), path, "2024-01-31")
    assert sorted((r.n, r.run_date.isoformat()) for r in out.collect()) == [(1, "2024-02-29"), (2, "2024-01-31"), (2, "2024-02-29")]
    with pytest.raises(ValueError):
        sinks.write_dated(one, path, "31.01.2024")


def test_cells_that_do_not_parse_are_counted_apart_from_empty_and_nan(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,x,n\n1,2.5,3\n2,NaN,4\n3,,5\n4,abc,6\nfive,1.0,7.5\n6,1\n7,1.0,2,9\n8,1e3,99999999999\n")
    schema = spark.createDataFrame([], "k int, x double, n int").schema
    cells = read_csv_cells(spark, str(path), schema)
    got = {r["column"]: (r.n_rows, r.empty, r.malformed, r.not_a_number, r.in_bad_rows, r.first_bad) for r in malformed_cells(cells).collect()}
    assert got == {"k": (8, 0, 1, 0, 2, "five"), "x": (8, 1, 1, 1, 2, "abc"), "n": (8, 0, 2, 0, 2, "7.5")}
    assert [r.raw for r in cells.where("k.value is null and k.raw is not null").select("k.raw").collect()] == ["five"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.4), float(rng.normal()), float(rng.normal(3, 2)), 1.0) for i in range(500)]
    rows = [(i, y, a + y, b, c) for i, y, a, b, c in rows]
    return L.design_matrix(spark.createDataFrame(rows, "k int, label int, a double, b double, same double"), "k", "label", ["a", "b", "same"])


@pytest.mark.parametrize("weight", [None, lambda d: L.balanced_weight(d, "label"), lambda d: L.cost_weight("label")])
def test_the_gradient_is_zero_at_the_fit_and_not_beside_it(matrix, weight):
    coefficients, rows = L.logistic_parameters(matrix, weight=weight)
    found = {r.parameter: r for r in L.logistic_gradient(rows, coefficients).collect()}
    assert set(found) == {"intercept", "a", "b", "same"} and max(abs(r.gradient) for r in found.values()) < 1e-6
    share = rows.agg(F.sum(F.col("w") * F.col("label")) / F.sum("w")).first()[0]
    assert found["a"].calibration == pytest.approx(share, abs=1e-6)
    # the same by numpy, at coefficients beside the optimum
    moved = coefficients.withColumn("coefficient", F.col("coefficient") + F.when(F.col("parameter") == "a", 0.3).otherwise(0.0))
    x = rows.select("a", "b", "label", "w").toPandas()
    c = {r.parameter: r for r in moved.collect()}
    z = {n: (x[n] - c[n].center) / c[n].scale for n in "ab"}
    p = 1 / (1 + np.exp(-(c["intercept"].coefficient + sum(z[n] * c[n].coefficient for n in "ab"))))
    want = {n: ((x["w"] * (x["label"] - p) * z[n]).sum() - c[n].coefficient) / x["w"].sum() for n in "ab"}
    got = {r.parameter: r.gradient for r in L.logistic_gradient(rows, moved).collect()}
    assert all(got[n] == pytest.approx(want[n], abs=1e-9) for n in "ab") and abs(got["a"]) > 0.01 and got["same"] == 0


def test_em_step_is_that_of_the_single_rows(spark):
    rng = np.random.default_rng(2)
    x = np.round(np.concatenate((rng.normal(0, 1, 300), rng.normal(6, 2, 100))), 1)
    counts = M.value_counts(spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double"), "v")
    parts = [M.Component(0.5, -1.0, 2.0), M.Component(0.5, 4.0, 1.5)]
    loglik, new = M.em_step(counts, parts)
    dense = np.array([c.weight * np.exp(-(((x - c.mean) / c.sd) ** 2) / 2) / (c.sd * np.sqrt(2 * np.pi)) for c in parts])
    r = dense / dense.sum(axis=0)
    assert loglik == pytest.approx(np.log(dense.sum(axis=0)).sum())
    for i, c in enumerate(new):
        mean = (r[i] * x).sum() / r[i].sum()
        assert (c.weight, c.mean, c.sd) == (pytest.approx(r[i].mean()), pytest.approx(mean), pytest.approx(np.sqrt((r[i] * (x - mean) ** 2).sum() / r[i].sum())))
    model = M.fit_counts(counts, 2)
    low, high = model.components
    assert model.n == 400 and abs(low.mean) < 0.3 and abs(high.mean - 6) < 0.8 and abs(low.weight - 0.75) < 0.06
    assert M.largest_move(model.components, M.em_step(counts, model.components)[1]) < 1e-3
    with pytest.raises(ValueError):
        M.fit_counts(counts.limit(0), 2)
