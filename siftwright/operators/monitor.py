"""Drift of a panel against a reference window, and attribution of a linear score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import edges_passed
from .ordering import quantiles, unpivot
from .profile import long_stats, row_count

# Customary alarm levels of the population stability index.
MODERATE, MAJOR = 0.1, 0.25
# Fixed value: smallest share a bin may take in the index.
MIN_SHARE = 1e-6


def reference_bins(reference: DataFrame, metrics: Sequence[str], bins: int = 10) -> DataFrame:
    """Interior quantile edges and bin counts of the reference sample, one row per metric.

    Repeated edges are dropped; bins are ``[lo, hi)`` with open ends.
    """
    long = unpivot(reference, metrics).where("value is not null")
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    edges = quantiles(long, "value", probs, ["metric"]).select(
        "metric", F.array_distinct(F.array(*[F.col(k) for k in probs])).alias("edges"))
    counts = _binned(long, edges, bins).groupBy("metric").agg(bin_counts(bins).alias("ref_counts"))
    return edges.join(counts, "metric")


def _binned(long: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    # one row of fewer than ``bins`` edges per listed metric
    tagged = long.join(F.broadcast(edges), "metric")
    return tagged.withColumn("bin", edges_passed(F.col("edges"), F.col("value"), bins))


def bin_counts(bins: int) -> Column:
    return F.array(*[F.count_if(F.col("bin") == i) for i in range(bins)])


def psi_of_counts(edges: Column, base: Column, comp: Column) -> Column:
    """Index from two count arrays over the bins the edges make."""
    used = F.size(edges) + 1

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")

    def shares(c: Column) -> Column:
        n = total(c)
        return F.transform(F.slice(c, 1, used), lambda x: F.greatest(x / n, F.lit(MIN_SHARE)))

    terms = F.zip_with(shares(base), shares(comp), lambda b, c: (c - b) * F.ln(c / b))
    return F.when((total(base) > 0) & (total(comp) > 0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def psi(panel: DataFrame, period: str, metrics: Sequence[str], reference: Column, bins: int = 10) -> DataFrame:
    """Stability index per metric and period against the rows where ``reference`` holds.

    All periods and metrics in one grouped pass. ``in_reference`` marks periods compared with a
    sample they are part of.
    """
    base = reference_bins(panel.where(reference), metrics, bins)
    long = unpivot(panel.withColumn("__ref", reference), metrics, [period, "__ref"]).where("value is not null")
    counts = _binned(long, base.select("metric", "edges"), bins).groupBy("metric", period).agg(
        bin_counts(bins).alias("counts"), row_count().alias("n"), F.bool_or("__ref").alias("in_reference"))
    # back to the one reference row per metric, now on aggregated rows
    return counts.join(F.broadcast(base), "metric").select(
        "metric", period, "n", "in_reference", psi_of_counts(F.col("edges"), F.col("ref_counts"), F.col("counts")).alias("psi"))


def psi_wide(table: DataFrame, period: str, metrics: Mapping[str, str]) -> DataFrame:
    """One row per period with one column per metric; ``metrics`` maps metric to column name."""
    return table.groupBy(period).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("psi"))).alias(name) for m, name in metrics.items()
    ])


def step_change(table: DataFrame, period: str, last_before: Column) -> DataFrame:
    """Worst period, largest index up to the break, smallest after it, their ratio and the alarm class, per metric."""
    early = F.col(period) <= last_before
    s = table.groupBy("metric").agg(
        F.max("psi").alias("max_psi"), F.max_by(period, F.struct("psi", period)).alias("worst_period"),
        F.max(F.when(early, F.col("psi"))).alias("max_before"), F.min(F.when(~early, F.col("psi"))).alias("min_after"),
    )
    level = F.when(F.col("max_psi") >= MAJOR, "major").when(F.col("max_psi") >= MODERATE, "moderate").otherwise("stable")
    return s.select("*", F.try_divide("min_after", "max_before").alias("step_ratio"), level.alias("alarm"))


def worst_period(wide: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """The period whose largest index over all metrics is highest."""
    top = F.greatest(*[F.col(c) for c in columns])
    return wide.agg(F.max_by(period, F.struct(top, period)).alias("period"), F.max(top).alias("max_psi"))


def attribution_shares(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution ``w * (x - mean x)`` of each feature to a linear score, and its share."""
    names = list(weights)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    parts = df.select(*[(F.lit(float(weights[c])) * (F.col(c) - means.getField(c))).alias(c) for c in names])
    s = long_stats(parts, names, {"mean_abs": lambda c: F.avg(F.abs(F.col(c)))}, name="feature")
    total = s.agg(F.sum("mean_abs")).scalar()
    return s.select("feature", "mean_abs", F.try_divide("mean_abs", total).alias("share"))
