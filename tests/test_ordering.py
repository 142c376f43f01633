"""Bucketed order statistics against brute force, on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwright.functions.binning import bin_left_closed, bin_right_closed, edges_passed
from siftwright.operators.ordering import add_position, consecutive_gaps, ordered_counts, quantiles


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 6000
    # one group owns two thirds of the rows, one value a third of them; some values are missing
    group = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n))
    x = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.lognormal(3, 2, n), 2) - 5)
    x = np.where(rng.random(n) < 0.05, np.nan, x)
    return pd.DataFrame({"id": np.arange(n), "g": group, "x": x, "y": (rng.random(n) < 0.1).astype(int)})


@pytest.fixture(scope="module")
def frame(spark, skewed):
    df = spark.createDataFrame(skewed)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)


def test_quantiles_match_numpy(frame, skewed):
    probs = {"p0": 0.0, "p1": 0.013, "p2": 0.5, "p3": 0.77, "p4": 1.0}
    got = {r["g"]: r for r in quantiles(frame, "x", probs, ["g"]).collect()}
    for g, part in skewed.dropna().groupby("g"):
        for k, p in probs.items():
            assert got[g][k] == pytest.approx(np.quantile(part.x, p), abs=1e-9)


def test_quantile_of_whole_table_and_of_nothing(frame, skewed):
    assert quantiles(frame, "x", {"m": 0.5}).first()["m"] == pytest.approx(np.nanmedian(skewed.x))
    assert quantiles(frame.where("id < 0"), "x", {"m": 0.5}).collect()[0]["m"] is None


def test_approximate_quantile_is_close(frame, skewed):
    assert quantiles(frame, "x", {"m": 0.9}, approximate=True).first()["m"] == pytest.approx(np.nanquantile(skewed.x, 0.9), rel=0.02)


def test_ordered_counts_match_brute_force(frame, skewed):
    got = ordered_counts(frame, "x", ["g"], {"pos": F.col("y")}).toPandas()
    clean = skewed.dropna()
    assert len(got) == clean.groupby(["g", "x"]).ngroups
    for r in got.sample(200, random_state=1).itertuples():
        part = clean[clean.g == r.g]
        assert r.n == (part.x == r.x).sum() and r.n_before == (part.x < r.x).sum() and r.n_total == len(part)
        assert r.pos == part[part.x == r.x].y.sum() and r.pos_before == part[part.x < r.x].y.sum()


def test_positions_are_a_row_number(frame, skewed):
    got = add_position(frame.where("x is not null"), ["x", "id"], ["g"]).toPandas().sort_values("id")
    want = skewed.dropna().sort_values(["x", "id"]).groupby("g").cumcount().sort_index() + 1
    assert list(got.position) == list(want)


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    got = {r["g"]: r["m"] for r in quantiles(df, "x", {"m": 0.5}, ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_gaps_match_brute_force(frame, skewed):
    got = consecutive_gaps(frame, "x").toPandas().sort_values("lower")
    values = np.unique(skewed.x.dropna())
    assert np.allclose(got.lower, values[:-1]) and np.allclose(got.upper, values[1:])


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9, 31])
def test_edges_passed_equals_searchsorted(spark, size):
    edges = np.sort(np.random.default_rng(size).choice(40, size, replace=False)).astype(float)
    xs = [float(v) for v in np.arange(-2, 42, 0.5)]
    df = spark.createDataFrame([(v, [float(e) for e in edges]) for v in xs], "x double, e array<double>")
    got = df.select("x", edges_passed(F.col("e"), "x", 31).alias("r"), edges_passed(F.col("e"), "x", 31, inclusive=False).alias("l")).collect()
    for r in got:
        assert r["r"] == np.searchsorted(edges, r["x"], side="right") and r["l"] == np.searchsorted(edges, r["x"], side="left")


def test_bin_conventions(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 3.0, 4.0]] + [(None,)], "x double")
    edges = [1.0, 2.0, 3.0]
    got = df.select(bin_right_closed("x", edges).alias("r"), bin_left_closed("x", edges).alias("l")).collect()
    assert [r["r"] for r in got] == [None, None, 1, 2, None, None]
    assert [r["l"] for r in got] == [None, 1, 2, 2, None, None]


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_narrow_brackets_give_the_same_quantiles(frame, skewed, accuracy):
    probs = {"p0": 0.0, "p1": 0.013, "p2": 0.05, "p3": 0.5, "p4": 0.501, "p5": 0.99, "p6": 1.0}
    got = {r["g"]: r for r in quantiles(frame, "x", probs, ["g"], accuracy=accuracy).collect()}
    for g, part in skewed.dropna().groupby("g"):
        for k, p in probs.items():
            assert got[g][k] == pytest.approx(np.quantile(part.x, p), abs=1e-9), (g, k)


def test_brackets_store_a_share_of_the_values(spark):
    from siftwright.operators import ordering as O

    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    stored = O._bracketed_values(df, "x", [0.25, 0.5, 0.75], [], 1000)
    assert stored.count() <= 3 * 200_000 * 6 // 1000 + 4 * 8
    assert stored.agg(F.sum("n")).first()[0] == 200_000
    assert df.select("x").distinct().count() == 200_000
    want = np.quantile(np.arange(200_000) * 7919 % 200_003, [0.25, 0.5, 0.75])
    assert list(quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.75}, accuracy=1000).first()) == pytest.approx(list(want))


def test_a_missed_bracket_sends_the_whole_column_through(spark, frame, skewed, monkeypatch):
    from siftwright.operators import ordering as O

    def wrong(present, value, probs, by, accuracy):
        low = present.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(value).alias("lo0"), F.min(value).alias("hi0"))
        return low.select(*by, F.struct("rows", "lo0", "hi0").alias("__b"))

    monkeypatch.setattr(O, "_brackets", wrong)
    assert O._bracketed_values(frame, "x", [0.5], ["g"], 10) is None
    got = {r["g"]: r["m"] for r in quantiles(frame, "x", {"m": 0.5}, ["g"]).collect()}
    assert got == {g: pytest.approx(np.quantile(part.x, 0.5)) for g, part in skewed.dropna().groupby("g")}


def test_large_integers_are_not_rounded_by_the_sketch(spark):
    # next to 2^60 doubles are 128 apart, so the sketch's bounds are not values of the column
    df = spark.range(0, 3000).select((F.lit(1 << 60) + F.col("id")).alias("x"), F.lit(1).alias("g"))
    row = quantiles(df, "x", {"a": 0.0, "m": 0.5, "z": 1.0}, accuracy=50).first()
    assert [row["a"], row["m"], row["z"]] == [float(1 << 60), float((1 << 60) + 1500), float((1 << 60) + 2999)]
