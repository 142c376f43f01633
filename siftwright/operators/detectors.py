"""Defect detectors: column rules that flag rows and aggregates that judge a column's shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import norm_cdf
from .ordering import consecutive_gaps, quantiles, unpivot
from .profile import long_stats, row_count
from .statistics import rates_by_dimension


# ------------------------------------------------------------------ missing values
def missing_by_segment(df: DataFrame, column: str, segments: Sequence[str], n_se: float = 3.0) -> DataFrame:
    """Missing rate per segment against the overall rate, with two sampling bands.

    ``inside_total`` uses the standard error at the table's size, ``inside_segment`` the one at the
    segment's own size, which is the fair test for small segments.
    """
    overall = df.agg(F.struct(
        F.avg(F.col(column).isNull().cast("double")).alias("p"), row_count().alias("n")
    )).scalar()
    rates = rates_by_dimension(df, F.col(column).isNull().cast("int"), segments)
    s = rates.select(
        "dimension", "value", F.col("rate").alias("missing_rate"), "n",
        overall.getField("p").alias("overall_rate"), overall.getField("n").alias("__total"),
    )
    spread = F.col("overall_rate") * (1 - F.col("overall_rate"))
    s = s.withColumn("band_total", n_se * F.sqrt(spread / F.col("__total")))
    s = s.withColumn("band_segment", n_se * F.sqrt(spread / F.col("n"))).drop("__total")
    off = F.abs(F.col("missing_rate") - F.col("overall_rate"))
    return s.withColumn("inside_total", off <= F.col("band_total")).withColumn(
        "inside_segment", off <= F.col("band_segment"))


def impute_median(df: DataFrame, column: str, *, imputed: str, flag: str) -> DataFrame:
    """Fill gaps with the exact median in a new column, behind a flag; the raw column stays."""
    median = quantiles(df, column, {"m": 0.5}).scalar()
    return df.withColumn(imputed, F.coalesce(F.col(column).cast("double"), median)).withColumn(
        flag, F.col(column).isNull())


# ------------------------------------------------------------------ invalid values
def is_negative(c: str) -> Column:
    return F.coalesce(F.col(c) < 0, F.lit(False))


def is_implausibly_low(c: str, bound: float | Column) -> Column:
    return F.coalesce((F.col(c) >= 0) & (F.col(c) < bound), F.lit(False))


def null_out(c: str, *bad: Column) -> Column:
    """The value where none of the conditions holds, NULL otherwise."""
    ok = F.lit(True)
    for b in bad:
        ok = ok & ~b
    return F.when(ok, F.col(c))


def flag_values(df: DataFrame, column: str, flags: Mapping[str, Column], clean: str, invalid: Sequence[str]) -> DataFrame:
    """Add flag columns and a clean column that is NULL wherever a flag in ``invalid`` is set."""
    flagged = df.withColumns(dict(flags))
    return flagged.withColumn(clean, null_out(column, *[F.col(f) for f in invalid]))


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles and fences per column (one row each)."""
    q = quantiles(unpivot(df, columns, name="column"), "value", {"q1": 0.25, "q3": 0.75}, ["column"])
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower_fence", F.col("q1") - k * iqr).withColumn("upper_fence", F.col("q3") + k * iqr)


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows below and above the quartile fences, per column."""
    # one fence row per listed column
    long = unpivot(df, columns, name="column").join(F.broadcast(iqr_fences(df, columns, k)), "column")
    return long.groupBy("column", "q1", "q3", "lower_fence", "upper_fence").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") < F.col("lower_fence")).alias("n_below"),
        F.count_if(F.col("value") > F.col("upper_fence")).alias("n_above"),
    )


def zscore_outliers(df: DataFrame, columns: Sequence[str], limit: float = 4.0) -> DataFrame:
    """Rows more than ``limit`` sample standard deviations from the mean, per column."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns
    ])).scalar()
    z = df.select(*[
        F.when(stats.getField(c).getField("s") > 0, (F.col(c) - stats.getField(c).getField("m")) / stats.getField(c).getField("s")).alias(c)
        for c in columns
    ])
    return long_stats(z, columns, {
        "n": lambda c: F.count(c),
        "n_outside": lambda c: F.count_if(F.abs(F.col(c)) > limit),
        "largest": lambda c: F.max(F.abs(F.col(c))),
    })


def density_at(df: DataFrame, column: str, probes: Sequence[float], half_width: float) -> DataFrame:
    """Rows within ``half_width`` of each probe value; one aggregate, probes without rows included."""
    x = F.col(column)
    row = df.agg(*[
        F.count_if(x.between(float(v) - half_width, float(v) + half_width)).alias(f"p{i}") for i, v in enumerate(probes)
    ])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(float(v)).alias("probe"), F.col(f"p{i}").alias("n")) for i, v in enumerate(probes)
    ])))


def largest_gaps(df: DataFrame, column: str, low: float, high: float, n: int) -> DataFrame:
    """The n widest gaps between neighbouring values of a band; ties go to the lower value."""
    band = df.where(F.col(column).between(low, high))
    return consecutive_gaps(band, column).orderBy(F.desc("gap"), "lower").limit(n)


def decimal_shift(df: DataFrame, column: str, above: float, band: tuple[float, float], factor: float = 10.0) -> DataFrame:
    """Of the rows above a bound, the share that lands in the normal band once divided by ``factor``."""
    x = F.col(column)
    shifted = F.when(x > above, x / factor)
    return df.agg(
        F.count_if(x > above).alias("n_above"), F.min(F.when(x > above, x)).alias("lowest"),
        F.max(F.when(x > above, x)).alias("highest"),
        F.avg(F.when(shifted.isNotNull(), shifted.between(*band).cast("double"))).alias("share_in_band"),
    )


# ------------------------------------------------------------------ shapes
def zero_floor(df: DataFrame, column: str, companions: Sequence[str]) -> DataFrame:
    """Point mass at exactly 0 against what a fitted Normal expects, and the companions' activity there."""
    x = F.col(column)
    row = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"),
        F.count_if(x == 0).alias("at_zero"), F.count_if(x < 0).alias("below_zero"),
        *[a for c in companions for a in (
            F.avg(F.when(x == 0, F.col(c))).alias(f"{c}_at_zero"), F.avg(c).alias(f"{c}_all"))],
    )
    return row.withColumn("expected_below", norm_cdf(F.try_divide(-F.col("mu"), F.col("sd"))) * F.col("n")).withColumn(
        "zero_pct", F.try_divide(F.col("at_zero") * 100, F.col("n")))


def uniform_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments of integer-valued columns against a discrete uniform law over their own range."""
    counts = unpivot(df, columns, name="column").where("value is not null").groupBy("column", "value").agg(row_count().alias("n"))
    flat = counts.groupBy("column").agg(
        row_count().alias("n_values"), F.min("n").alias("rarest"), F.max("n").alias("commonest"),
        F.max(F.struct("value", "n")).getField("n").alias("n_at_max"),
    )
    s = long_stats(df, columns, {
        "n": lambda c: F.count(c), "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double"),
        "mean": lambda c: F.avg(c), "sd": lambda c: F.stddev_samp(c), "kurt_pop": lambda c: F.kurtosis(c),
    })
    m = F.col("hi") - F.col("lo") + 1
    return s.join(flat, "column").select(
        "*", ((F.col("lo") + F.col("hi")) / 2).alias("uniform_mean"),
        F.sqrt((m * m - 1) / 12).alias("uniform_sd"),
        F.try_divide(-6.0 / 5.0 * (m * m + 1), m * m - 1).alias("uniform_kurt"),
    )


def normal_shape(df: DataFrame, columns: Sequence[str], tolerance: float = 0.25) -> DataFrame:
    """Skewness and excess kurtosis near 0: the shape of a Normal draw."""
    s = long_stats(df, columns, {
        "n": lambda c: F.count(c), "skew_pop": lambda c: F.skewness(c), "kurt_pop": lambda c: F.kurtosis(c),
    })
    near = (F.abs("skew_pop") <= tolerance) & (F.abs("kurt_pop") <= tolerance)
    return s.withColumn("looks_normal", near)


def tail_excess(df: DataFrame, column: str, cutoffs: Sequence[float]) -> DataFrame:
    """Rows a log-normal fitted to all positive values expects above each cut-off, and rows found."""
    x = F.col(column).cast("double")
    pos = F.when(x > 0, x)
    row = df.agg(
        F.count(pos).alias("n"), F.avg(F.ln(pos)).alias("mu"), F.stddev_samp(F.ln(pos)).alias("sd"),
        *[F.count_if(x > float(c)).alias(f"c{i}") for i, c in enumerate(cutoffs)],
    )
    long = row.select("n", "mu", "sd", F.inline(F.array(*[
        F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"c{i}").alias("observed")) for i, c in enumerate(cutoffs)
    ])))
    z = F.try_divide(F.ln("cutoff") - F.col("mu"), F.col("sd"))
    return long.select("cutoff", "n", "mu", "sd", "observed", (norm_cdf(-z) * F.col("n")).alias("expected"))


def event_time_check(df: DataFrame, *, event: str | None, time: str | None) -> DataFrame:
    """Can time-to-event analysis be fitted at all? Verdict computed from the data.

    It needs a binary event column and a duration column with more than one distinct value.
    """
    has_event = event is not None and event in df.columns
    has_time = time is not None and time in df.columns
    events = F.count_distinct(F.col(event)) if has_event else F.lit(0).cast("bigint")
    times = F.count_distinct(F.col(time)) if has_time else F.lit(0).cast("bigint")
    row = df.agg(row_count().alias("n_rows"), events.alias("event_values"), times.alias("time_values"))
    return row.select(
        "n_rows", F.lit(has_event).alias("has_event"), F.lit(has_time).alias("has_time"), "event_values", "time_values",
        ((F.col("event_values") == 2) & (F.col("time_values") > 1)).alias("feasible"),
    )
