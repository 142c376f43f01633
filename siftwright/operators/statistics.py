"""Moments, rates, correlations and tests; sums over rows first, formulas on result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import bin_right_closed, edges_passed
from ..functions.scalars import adjusted_kurtosis, adjusted_skewness, safe_corr
from ..functions.tails import chi2_sf, kolmogorov_sf, norm_cdf, student_t_sf
from .ordering import ordered_counts, quantiles, unpivot
from .profile import long_stats, row_count


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, both standard deviations, and population and bias-corrected skewness and kurtosis."""
    return long_stats(df, columns, {
        "n": lambda c: F.count(c),
        "mean": lambda c: F.avg(c),
        "sd_samp": lambda c: F.stddev_samp(c),
        "sd_pop": lambda c: F.stddev_pop(c),
        "skew_pop": lambda c: F.skewness(c),
        "skew_adj": lambda c: adjusted_skewness(c),
        "kurt_pop": lambda c: F.kurtosis(c),
        "kurt_adj": lambda c: adjusted_kurtosis(c),
    }, by)


# ------------------------------------------------------------------ rates
def group_rate(df: DataFrame, label: str, dims: Sequence[str]) -> DataFrame:
    """Label mean and group size per combination of dimensions."""
    return df.groupBy(*dims).agg(F.avg(label).alias("rate"), row_count().alias("n"))


def rates_by_dimension(df: DataFrame, label: Column, dims: Sequence[str]) -> DataFrame:
    """The same rate over several dimensions, one at a time, in one grouping-sets pass."""
    tagged = df.select(*[F.col(d).cast("string").alias(d) for d in dims], label.cast("double").alias("__y"))
    grouped = tagged.groupingSets([[d] for d in dims], *dims).agg(
        F.avg("__y").alias("rate"), row_count().alias("n"),
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"__g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"__g_{d}") == 0, F.col(d)).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "rate", "n")


def crosstab(df: DataFrame, category: str, label: str, labels: Sequence[int]) -> DataFrame:
    """Rows per category and label value, one column per label value."""
    return df.groupBy(F.col(category).alias("category")).agg(
        *[F.count_if(F.col(label) == v).alias(f"label_{v}") for v in labels]
    )


def label_by_period(df: DataFrame, period: str, label: str, metrics: Sequence[str]) -> DataFrame:
    """Metric mean per period for label 0 and 1, their difference and relative difference."""
    long = unpivot(df, metrics, [period, label])
    wide = long.groupBy("metric", period).pivot(label, [0, 1]).agg(F.avg("value"))
    zero, one = F.col("0"), F.col("1")
    return wide.select(
        "metric", period, zero.alias("mean_0"), one.alias("mean_1"), (one - zero).alias("diff"),
        F.when(zero != 0, (one - zero) / zero * 100).alias("diff_pct"),
    )


def correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Correlation of every feature with the label; NULL for a constant."""
    return long_stats(df, features, {
        "n": lambda c: F.count_if(F.col(c).isNotNull() & F.col(label).isNotNull()),
        "r": lambda c: safe_corr(c, label),
    }, name="feature")


def _interior_edges(df: DataFrame, column: str, bins: int) -> Column:
    """Sorted distinct quantile edges between the lowest and the highest, as a scalar array."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    row = quantiles(df, column, probs)
    edges = F.array_distinct(F.array(*[F.col(k) for k in probs]))
    return row.select(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))).alias("e")).scalar()


def quantile_bin(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Quantile bin of every row over ``(lo, hi]`` intervals, repeated edges dropped."""
    tagged = df.withColumn("__edges", _interior_edges(df, column, bins))
    x = F.col(column).cast("double")
    return tagged.withColumn(name, edges_passed(F.col("__edges"), x, bins, inclusive=False)).drop("__edges")


def rate_by_quantile(df: DataFrame, column: str, label: str, bins: int) -> DataFrame:
    """Label mean and size per quantile bin of a column."""
    binned = quantile_bin(df.select(column, label).where(F.col(column).isNotNull()), column, bins)
    return binned.groupBy("bin").agg(
        row_count().alias("n"), F.min(column).cast("double").alias("lowest"),
        F.max(column).cast("double").alias("highest"), F.avg(label).alias("rate"),
    )


def rate_by_fixed_bin(df: DataFrame, column: str, label: str, edges: Sequence[float]) -> DataFrame:
    """Label mean and size per fixed ``(lo, hi]`` bin; bin 0 lies below the edges, the last above them."""
    x = F.col(column).cast("double")
    b = F.when(x <= float(edges[0]), 0).when(x > float(edges[-1]), len(edges)).otherwise(bin_right_closed(x, edges))
    return df.select(b.alias("bin"), F.col(label).alias("y")).where("bin is not null").groupBy("bin").agg(
        row_count().alias("n"), F.avg("y").alias("rate")
    )


def median_distance(df: DataFrame, column: str, distances: Sequence[float]) -> DataFrame:
    """Rows farther from the median than each distance."""
    median = quantiles(df, column, {"m": 0.5}).scalar()
    row = df.select(F.abs(F.col(column) - median).alias("d")).agg(*[
        F.count_if(F.col("d") > float(k)).alias(f"k{i}") for i, k in enumerate(distances)
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(float(k)).alias("distance"), F.col(f"k{i}").alias("n_beyond")) for i, k in enumerate(distances)
    ])))


def flagged_means(df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """Mean of each column over flagged rows beside the mean over all rows."""
    tagged = df.select(*columns, flag.alias("__f"))
    return long_stats(tagged, columns, {
        "n_flagged": lambda c: F.count_if("__f"),
        "mean_flagged": lambda c: F.avg(F.when(F.col("__f"), F.col(c))),
        "mean_all": lambda c: F.avg(c),
    })


def cohort_means(df: DataFrame, cohort: Column, columns: Sequence[str]) -> DataFrame:
    """Size and mean of many columns per cohort."""
    return long_stats(df.select(cohort.alias("cohort"), *columns), columns, {
        "n": lambda c: F.count(F.lit(1)), "mean": lambda c: F.avg(c),
    }, ["cohort"])


# ------------------------------------------------------------------ tests
def welch_tests(df: DataFrame, features: Sequence[str], label: str, *, alpha: float = 0.05) -> DataFrame:
    """Welch's t-test of every feature between label 1 and label 0, all from one aggregate."""
    def of(v: int, c: str) -> Column:
        return F.when(F.col(label) == v, F.col(c))

    s = long_stats(df, features, {
        "n0": lambda c: F.count(of(0, c)), "n1": lambda c: F.count(of(1, c)),
        "mean0": lambda c: F.avg(of(0, c)), "mean1": lambda c: F.avg(of(1, c)),
        "v0": lambda c: F.var_samp(of(0, c)), "v1": lambda c: F.var_samp(of(1, c)),
        "r": lambda c: safe_corr(c, label),
    }, name="feature")
    s = s.withColumn("a", F.try_divide("v0", "n0")).withColumn("b", F.try_divide("v1", "n1"))
    t = F.when(F.col("a") + F.col("b") > 0, (F.col("mean1") - F.col("mean0")) / F.sqrt(F.col("a") + F.col("b")))
    spread = F.col("a") ** 2 / (F.col("n0") - 1) + F.col("b") ** 2 / (F.col("n1") - 1)
    enough = (F.col("n0") > 1) & (F.col("n1") > 1)
    dof = F.when(enough & (F.col("a") + F.col("b") > 0), (F.col("a") + F.col("b")) ** 2 / spread)
    tested = s.select("feature", "n0", "n1", "mean0", "mean1", t.alias("t"), dof.alias("dof"), "r")
    return tested.withColumn("p", student_t_sf("t", "dof")).withColumn(
        "expected_false_positives", F.lit(len(features) * alpha)
    )


def chi2_tests(df: DataFrame, categories: Sequence[str], label: str) -> DataFrame:
    """Chi-square independence of each category and the label; Yates' correction at one degree.

    ``sum(o^2/e) - n`` equals the usual statistic and needs no empty cells; in a 2 x 2 table the
    deviation is the same in every cell, so the correction is a factor on that sum.
    """
    long = unpivot(df.where(F.col(label).isNotNull()), categories, [label], name="variable", dtype="string")
    cells = long.where("value is not null").groupBy("variable", "value", label).agg(row_count().alias("o"))
    rows = cells.groupBy("variable", "value").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("variable", label).agg(F.sum("o").alias("c"))
    size = cells.groupBy("variable").agg(
        F.sum("o").alias("n"), F.countDistinct("value").alias("k"), F.countDistinct(label).alias("l")
    )
    e = F.col("r") * F.col("c") / F.col("n")
    full = cells.join(rows, ["variable", "value"]).join(cols, ["variable", label]).join(size, "variable")
    s = full.groupBy("variable").agg(
        F.max("n").alias("n"), ((F.max("k") - 1) * (F.max("l") - 1)).alias("dof"),
        (F.sum(F.col("o") * F.col("o") / e) - F.max("n")).alias("raw"), F.max(F.abs(F.col("o") - e)).alias("dev"),
    )
    shrink = F.when(F.col("dev") > 0, 1 - F.least(F.lit(0.5), F.col("dev")) / F.col("dev")).otherwise(0.0)
    chi2 = F.when(F.col("dof") == 1, F.col("raw") * shrink * shrink).otherwise(F.col("raw"))
    return s.select("variable", "n", "dof", chi2.alias("chi2")).withColumn("p", chi2_sf("chi2", F.col("dof").cast("double")))


def ks_uniform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of each column from the uniform law over its own range."""
    long = unpivot(df, columns)
    counts = ordered_counts(long, "value", ["metric"])
    ends = long.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # one row per listed column
    placed = counts.join(F.broadcast(ends), "metric").where("hi > lo")
    u = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    upper = (F.col("n_before") + F.col("n")) / F.col("n_total") - u
    lower = u - F.col("n_before") / F.col("n_total")
    s = placed.groupBy("metric").agg(
        F.max("n_total").alias("n"), F.greatest(F.max(upper), F.max(lower)).alias("d")
    )
    return s.withColumn("p", kolmogorov_sf("d", F.col("n").cast("double")))


def normal_fit_bands(df: DataFrame, column: str, bound: float, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows a fitted Normal expects at or below ``bound`` against the rows found at and around it."""
    x = F.col(column)
    row = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"),
        F.count_if(x == bound).alias("at_bound"), F.count_if(x < bound).alias("below_bound"),
        *[F.count_if((x > lo) & (x < hi) if lo == bound else (x >= lo) & (x < hi)).alias(f"in_{lo:g}_{hi:g}") for lo, hi in bands],
    )
    return row.withColumn("expected_below", norm_cdf(F.try_divide(F.lit(float(bound)) - F.col("mu"), F.col("sd"))) * F.col("n"))


def label_plausibility(df: DataFrame, label: str, count_metric: str) -> DataFrame:
    """Label rate and positives, and mean, dispersion and label gap of a count metric."""
    m = F.col(count_metric)
    return df.agg(
        row_count().alias("n"), F.sum(label).cast("bigint").alias("positives"), F.avg(label).alias("rate"),
        F.avg(m).alias("mean_count"), F.try_divide(F.var_samp(m), F.avg(m)).alias("dispersion"),
        (F.avg(F.when(F.col(label) == 1, m)) - F.avg(F.when(F.col(label) == 0, m))).alias("mean_gap"),
    )
