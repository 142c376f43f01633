"""Importance and attribution of forests that stay tables, against their own scores and against trees walked row by row."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from siftwright.operators import forest_effects as E
from siftwright.operators import many_trees as M
from siftwright.operators import models as L


def _refuse(self, *a, **b):
    raise AssertionError("a forest on the driver")


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    rows = [(i, int((x[i, 0] > 0) != (i % 9 == 0)), [float(v) for v in x[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, label int, x array<double>").repartition(3)
    return L.Matrix(df.select("k", "label", array_to_vector("x").alias("features")), "k", "label", ["signal", "noise"])


def test_importance_of_forests_grown_together(matrix, monkeypatch):
    monkeypatch.setattr(L.RandomForestClassifier, "fit", _refuse)
    found = {r["feature"]: r["perm_importance"] for r in L.cross_importance(matrix, lambda n: L.forest(10, depth=5), k=2, repeats=2).collect()}
    assert set(found) == {"signal", "noise"} and found["signal"] > 0.2 > abs(found["noise"])


def test_forest_scores_leave_no_trees_behind(matrix):
    """Only folds, scores and their union stay stored."""
    from siftwright.sources import scratch

    before = len(scratch._stored)
    assert L.oof_scores(matrix, {"forest": lambda n: L.forest(4, depth=3)}, k=2).count() == 300
    assert [p.split("/")[-1].rsplit("-", 1)[0] for p in scratch._stored[before:]] == ["folds", "forest-scores", "oof"]


def test_attribution_of_a_forest_that_is_a_table(matrix, monkeypatch):
    monkeypatch.setattr(L.RandomForestClassifier, "fit", _refuse)
    first, other = L.forest_shapley(matrix, L.forest(10, depth=5), repeats=2).collect()
    assert first["feature"] == "signal" and first["share"] > 0.7 and first["share"] + other["share"] == pytest.approx(1.0)


def test_effects_against_trees_walked_row_by_row(spark):
    """One tree in each of two folds, two features; every mixed vector is walked by itself."""
    rng = np.random.default_rng(1)
    g = M.Growth(2, 1, 4, 1, 3, [np.arange(31.0)] * 2)
    bins = rng.integers(0, 32, (200, 2)).astype(np.uint8)
    y = ((bins[:, 0] > 9) ^ (bins[:, 1] > 20)).astype(np.uint8)
    trees = [M._grow(g, f, 0, 1, bins, np.ones(200, np.uint8), y) for f in range(2)]
    stored = spark.createDataFrame([(f, 0, bytearray(M._pack(t))) for f, t in enumerate(trees)], "f int, t int, packed binary")

    def walk(fold, v):
        at = {int(r["node"]): r for r in trees[fold]}
        node = 1
        while at[node]["feature"] >= 0:
            node = 2 * node + int(v[at[node]["feature"]] > at[node]["cut"])
        return float(at[node]["value"])

    rows = [(i % 2, i % 3, int(y[i]), bytearray(bins[i].tobytes()), bytearray(bins[i - 7].tobytes())) for i in range(30)]
    pairs = spark.createDataFrame(rows, "fold int, rep int, label int, x binary, z binary")
    want = sorted((f, j, r, lab, walk(f, [z[c] if c == j else x[c] for c in range(2)])) for f, r, lab, x, z in rows for j in range(-1, 2) if j >= 0 or r == 0)
    assert sorted(map(tuple, E.swapped_scores(pairs, stored, g).collect())) == want

    one = M.Growth(1, 1, 4, 1, 3, [np.arange(31.0)] * 2)
    keyed = pairs.where("fold = 0").withColumn("k", F.monotonically_increasing_id()).select("k", F.lit(0).alias("rep"), "x", "z")
    found = {r["j"]: r for r in E.shapley_sums(keyed, "k", stored.where("f = 0"), one, repeats=1, seed=4).collect()}
    assert found[0]["rows"] == found[1]["rows"] == 15
    either = [sorted([(abs(walk(0, [x[0], z[1]]) - walk(0, z)), abs(walk(0, x) - walk(0, [x[0], z[1]]))),
                      (abs(walk(0, x) - walk(0, [z[0], x[1]])), abs(walk(0, [z[0], x[1]]) - walk(0, z)))]) for f, _, _, x, z in rows if f == 0]
    for j in range(2):
        assert sum(min(a[j], b[j]) for a, b in either) - 1e-9 <= found[j]["sum_abs"] <= sum(max(a[j], b[j]) for a, b in either) + 1e-9


def test_a_row_without_a_label_is_an_error(matrix):
    gap = L.Matrix(matrix.data.withColumn("label", F.when(F.col("k") != 5, F.col("label"))), "k", "label", matrix.names)
    with pytest.raises(Exception, match="MUST NOT be Null"):
        L.cross_importance(gap, lambda n: L.forest(2, depth=2), k=2, repeats=1).collect()
    with pytest.raises(Exception, match="MUST NOT be Null"):
        L.forest_shapley(gap, L.forest(2, depth=2), repeats=1).collect()
