"""Fits that share their passes against single fits of Spark's own estimator."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from siftwright.operators import models as L
from siftwright.operators.evaluate import score_metrics
from siftwright.operators.many_fits import fit_many, held_out_scores


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    rows = [
        # different scales, a large offset, a feature without spread and one that only two rows have
        (i, int(rng.random() < 0.3), [float(rng.normal(1e4, 3)), float(rng.exponential(0.01)), 7.0, float(i in (3, 4)), float(rng.normal())])
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "k int, label int, x array<double>").repartition(3)
    return L.Matrix(df.select("k", "label", array_to_vector("x").alias("features")), "k", "label", list("abcde"))


@pytest.fixture(scope="module")
def drawn(matrix):
    return L.null_rows(matrix, draws=3, k=2, seed=42)


def test_each_fit_is_the_single_fit(drawn):
    fits = fit_many(drawn, 3, 2)
    assert fits.passes <= 12
    for draw in range(3):
        for fold in range(2):
            one = drawn.select("features", F.get("ys", F.lit(draw)).alias("label"), F.get("fs", F.lit(draw)).alias("fold"))
            scaler, lr = L.logistic(300 / 2, tol=1e-12).fit(one.where(F.col("fold") != fold)).stages
            sd = np.array(scaler.std)
            slope = np.where(sd > 0, lr.coefficients.toArray() / np.where(sd > 0, sd, 1), 0.0)
            start, raw = fits.raw(draw, fold)
            assert raw == pytest.approx(slope, rel=1e-4, abs=1e-6)
            assert start == pytest.approx(lr.intercept - slope @ np.array(scaler.mean), rel=1e-4, abs=1e-4)


def test_scores_are_held_out_and_auc_is_that_of_single_fits(matrix, drawn):
    scores = held_out_scores(drawn, fit_many(drawn, 3, 2), 3)
    assert scores.groupBy("draw").count().where("count <> 300").isEmpty()
    got = {r["draw"]: r["roc_auc"] for r in score_metrics(scores, "score", "label", ["draw"]).collect()}
    for draw in range(3):
        one = drawn.select("features", F.get("ys", F.lit(draw)).alias("label"), F.get("fs", F.lit(draw)).alias("fold"))
        parts = [
            L.positive_probability(L.logistic(300 / 2, tol=1e-12).fit(one.where(F.col("fold") != f)), one.where(F.col("fold") == f), "label")
            for f in range(2)
        ]
        want = score_metrics(parts[0].unionByName(parts[1]), "score", "label").first()["roc_auc"]
        assert got[draw] == pytest.approx(want, abs=1e-3)
    null = {r["draw"]: r["roc_auc"] for r in L.label_null(matrix, draws=3, k=2).collect()}
    assert null == pytest.approx(got)


def test_passes_do_not_grow_with_the_draws(matrix):
    few, many = (fit_many(L.null_rows(matrix, draws=n, k=3, seed=1), n, 3).passes for n in (1, 12))
    assert many <= few + 3


def test_separated_classes_end_at_the_penalised_optimum(spark):
    # a gap between the classes: without it both folds' fits put their middle on a held-out row
    rows = [(i, [float(i + 5 * (i >= 10))], [int(i >= 10)], [i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, x array<double>, ys array<int>, fs array<int>")
    rows = df.withColumn("features", array_to_vector("x"))
    fits = fit_many(rows, 1, 2)
    scores = held_out_scores(rows, fits, 1).toPandas()
    assert scores[scores.label == 1].score.min() > scores[scores.label == 0].score.max()


def test_no_rows_are_an_error(spark):
    rows = spark.createDataFrame([], "x array<double>, ys array<int>, fs array<int>").withColumn("features", array_to_vector("x"))
    with pytest.raises(ValueError):
        fit_many(rows, 1, 2)
