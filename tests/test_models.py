"""Fits on small planted data: direction and range, not digits."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from siftwright.operators import models as L
from siftwright.plans import QUERIES
from siftwright.plans import model_queries as Q


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.3)
        rows.append((i, y, [float(rng.normal(2.0 * y, 1)), float(rng.normal()), float(rng.normal())]))
    df = spark.createDataFrame(rows, "k int, label int, x array<double>")
    return L.Matrix(df.select("k", "label", array_to_vector("x").alias("features")), "k", "label", ["signal", "noise1", "noise2"])


def test_signal_beats_the_null_and_noise_does_not(spark, matrix):
    found = L.label_signal(matrix, {"logistic": lambda n: L.logistic(n)}, draws=19, k=2).first()
    assert found["pooled_auc"] > 0.85 and found["signal"] and found["share_ge_model"] == 0.0 and found["p_adjusted"] == pytest.approx(0.05)
    shuffled = L.permute_labels(matrix.data.select("k", "label"), "k", "label", 1).select("k", "label")
    noise = L.Matrix(matrix.data.drop("label").join(shuffled, "k"), "k", "label", matrix.names)
    scores = L.oof_scores(noise, {"logistic": lambda n: L.logistic(n)}, k=2)
    assert scores.count() == scores.select("k").distinct().count() == 400
    assert 0.35 < L.model_comparison(scores).first()["roc_auc"] < 0.65


def test_importance_finds_the_planted_feature(spark, matrix):
    model = L.logistic(400.0).fit(matrix.data)
    perm = L.permutation_importance(model, matrix.data, "k", matrix.names, repeats=2).collect()
    assert perm[0]["feature"] == "signal" and perm[0]["perm_importance"] > 0.2
    shap = L.sampled_shapley(model, matrix.data.where("k < 100"), "k", matrix.names, repeats=2).collect()
    assert shap[0]["feature"] == "signal" and shap[0]["share"] > 0.7
    assert sum(r["share"] for r in shap) == pytest.approx(1.0)


def test_design_matrix_names_and_gaps(spark):
    df = spark.createDataFrame([(i, i % 2, None if i == 3 else float(i), "abc"[i % 3]) for i in range(12)], "k int, label int, v double, c string")
    m = L.design_matrix(df, "k", "label", ["v"], {"c": ["a", "b", "c"]})
    assert m.names == ["v", "v_nobase", "c_b", "c_c"]
    row = m.data.where("k = 3").first()
    assert list(row["features"].toArray()) == [6.0, 1.0, 0.0, 0.0]


def test_a_column_without_any_value_is_a_constant(spark):
    df = spark.createDataFrame([(i, i % 2, None, float(i)) for i in range(40)], "k int, label int, none double, v double")
    m = L.design_matrix(df, "k", "label", ["none", "v"])
    assert m.names == ["none", "v", "none_nobase"]
    assert list(m.data.where("k = 3").first()["features"].toArray()) == [0.0, 3.0, 1.0]
    assert L.oof_scores(m, {"logistic": lambda n: L.logistic(n)}, k=2).where("score > 0 and score < 1").count() == 40


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    got = df.select("label", L.balanced_weight(df, "label").alias("b"), L.cost_weight("label").alias("c")).collect()
    assert {r["label"]: (r["b"], r["c"]) for r in got} == {1: (2.0, 5.0), 0: (pytest.approx(2 / 3), 1.0)}


def test_queries_fit_full_forests(spark, folder, monkeypatch):
    asked = {}

    def stop(matrix, estimators, **kw):
        asked.update(estimators)
        raise InterruptedError

    monkeypatch.setattr(Q.L, "oof_scores", stop)
    for name in ("model_comparison", "label_signal_control"):
        asked.clear()
        with pytest.raises(InterruptedError):
            QUERIES[name](spark, folder)
        assert asked["forest"](400.0).getNumTrees() == 500, name


def test_importance_holds_one_model_at_a_time(matrix, monkeypatch):
    steps, store = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: (store(df, name), steps.append(name))[0])

    def estimator(n):
        steps.append("fit")
        return L.logistic(n)

    assert L.cross_importance(matrix, estimator, k=2, repeats=1).count() == 3
    assert [s for s in steps if s in ("fit", "importance")] == ["fit", "importance"] * 2


def test_logistic_scores_end_at_the_optimum(spark):
    """Two thousand rows; six of one class have thirty equal indicators, as customers without an order have."""
    rng = np.random.default_rng(2)
    rows = [(i, int(i >= 6 and rng.random() < 0.1), [float(i < 6)] * 30 + [float(rng.normal())]) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, label int, x array<double>").withColumn("features", array_to_vector("x"))
    m = L.Matrix(df.select("k", "label", "features"), "k", "label", [f"c{j}" for j in range(31)])
    got = {(r["k"]): (r["fold"], r["score"]) for r in L.oof_scores(m, {"logistic": lambda n: L.logistic(n)}, k=2).collect()}
    assert len(got) == 2000 and all(0 < s < 1 for _, s in got.values())
    folded = L.stratified_folds(df, "k", "label", 2)
    for f in range(2):
        train = folded.where(f"fold <> {f}")
        exact = L.logistic(train.count(), tol=1e-14).fit(train)
        for r in L.positive_probability(exact, folded.where(f"fold = {f}"), "k").collect():
            assert got[r["k"]] == (f, pytest.approx(r["score"], rel=1e-2, abs=1e-4))
