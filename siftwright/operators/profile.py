"""Table, column, key and period profiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import bin_right_closed
from ..functions.scalars import digit_mask
from .ordering import quantiles, unpivot

def row_count() -> Column:
    return F.count(F.lit(1))


def long_stats(
    df: DataFrame,
    columns: Sequence[str],
    stats: Mapping[str, Callable[[str], Column]],
    by: Sequence[str] = (),
    *,
    name: str = "column",
) -> DataFrame:
    """Many statistics of many columns in one aggregate, returned one row per (group, column)."""
    wide = df.groupBy(*by).agg(*[
        F.struct(*[fn(c).alias(k) for k, fn in stats.items()]).alias(f"__s{i}")
        for i, c in enumerate(columns)
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"__s{i}.{k}").alias(k) for k in stats])
        for i, c in enumerate(columns)
    ])
    return wide.select(*by, F.inline(rows))


def stack_row(row: DataFrame, pairs: Mapping[str, Column | str], *, name: str = "metric", value: str = "value", keep: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """Turn the columns of a (one-row) aggregate into (name, value) rows."""
    cells = F.array(*[
        F.struct(F.lit(k).alias(name), (F.col(c) if isinstance(c, str) else c).cast(dtype).alias(value))
        for k, c in pairs.items()
    ])
    return row.select(*keep, F.inline(cells))


def table_shape(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, columns, fully duplicated rows, surplus rows of repeated keys, distinct keys.

    Identical rows are combined first, so both counts come out of one pass over the data.
    """
    variants = df.groupBy(*df.columns).agg(row_count().alias("copies"))
    keys = variants.groupBy(*key).agg(F.sum("copies").alias("rows"), row_count().alias("variants"))
    return keys.agg(
        F.sum("rows").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        (F.sum("rows") - F.sum("variants")).alias("duplicate_rows"),
        (F.sum("rows") - row_count()).alias("surplus_key_rows"),
        row_count().alias("distinct_keys"),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count of every value of the named columns, NULL kept as its own value."""
    return unpivot(df, columns, name="column", dtype="string").groupBy("column", "value").agg(row_count().alias("n"))


def value_widths(df: DataFrame, columns: Sequence[str], max_distinct: int) -> DataFrame:
    """Distinct values of every column and whether there are too many to be listed one by one."""
    counts = value_counts(df, columns).groupBy("column").agg(F.count("value").alias("n_distinct"))
    return counts.withColumn("too_many", F.col("n_distinct") > max_distinct)


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """Type, nulls, null share, distinct values and the smallest value as example, per column."""
    columns = list(columns or df.columns)
    kinds = F.create_map(*[
        x for f in df.schema.fields if f.name in columns for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))
    ])
    if approximate:
        counts = long_stats(df, columns, {
            "n": lambda c: row_count(),
            "nulls": lambda c: F.count_if(F.col(c).isNull()),
            "n_distinct": lambda c: F.approx_count_distinct(c),
        })
    else:
        # texts are counted by digest, so that none is shuffled as a key
        short = df.select(*[
            F.sha2(F.encode(F.col(f.name), "UTF-8"), 256).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
            for f in df.schema.fields if f.name in columns])
        counts = value_counts(short, columns).groupBy("column").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("value").alias("n_distinct"),
        )
    # smallest strings in an aggregate without keys: no sort, unlike one grouped by column
    examples = long_stats(df, columns, {"example": lambda c: F.min(F.col(c).cast("string"))})
    flat = counts.join(examples, "column")
    return flat.select(
        "column", kinds[F.col("column")].alias("dtype"),
        "n", "nulls", (F.col("nulls") * 100.0 / F.col("n")).alias("null_pct"), "n_distinct", "example",
    )


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, mean, zeros and negatives per numeric column."""
    return long_stats(df, columns, {
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
        "mean": lambda c: F.avg(c),
        "zeros": lambda c: F.count_if(F.col(c) == 0),
        "negatives": lambda c: F.count_if(F.col(c) < 0),
    })


# Quartile names and probabilities.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe_scopes(df: DataFrame, column: str, subset: Column, *, name: str = "subset") -> DataFrame:
    """Count, mean, sd, range and quartiles of a column over all rows and over a subset."""
    scopes = F.explode(F.array_compact(F.array(F.lit("all"), F.when(subset, F.lit(name)))))
    tagged = df.select(scopes.alias("scope"), F.col(column).alias("x"))
    moments = tagged.groupBy("scope").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    return moments.join(quantiles(tagged, "x", QUARTILES, ["scope"]), "scope")


def quantile_profile(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, approximate: bool = False) -> DataFrame:
    """Long quantile table: one row per (column, probability)."""
    named = {f"q{i}": p for i, p in enumerate(probs)}
    wide = quantiles(unpivot(df, columns, name="column"), "value", named, ["column"], approximate=approximate)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(k).alias("quantile")) for k, p in named.items()])
    return wide.select("column", F.inline(rows))


def key_coverage(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Keys of one table that another lacks, for every ordered pair, in one pass over tagged keys."""
    names = list(tables)
    tagged = reduce(DataFrame.unionByName, [
        df.select(F.col(key).alias("key"), *[F.lit(n == m).alias(f"in_{m}") for m in names])
        for n, (df, key) in tables.items()
    ])
    seen = tagged.where("key is not null").groupBy("key").agg(*[F.bool_or(f"in_{m}").alias(f"in_{m}") for m in names])
    pairs = [(a, b) for a in names for b in names if a != b]
    row = seen.agg(
        *[F.count_if(F.col(f"in_{a}")).alias(f"k_{a}") for a in names],
        *[F.count_if(F.col(f"in_{a}") & ~F.col(f"in_{b}")).alias(f"m_{a}_{b}") for a, b in pairs],
    )
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(a).alias("left_table"), F.lit(b).alias("right_table"),
            F.col(f"k_{a}").alias("left_keys"), F.col(f"m_{a}_{b}").alias("missing_in_right"),
        ) for a, b in pairs
    ])))


def rows_per_entity(df: DataFrame, key: str) -> DataFrame:
    """Minimum, maximum and median number of rows per key."""
    sizes = df.groupBy(key).agg(row_count().alias("size"))
    ends = sizes.agg(row_count().alias("entities"), F.min("size").alias("min_rows"), F.max("size").alias("max_rows"))
    return ends.withColumn("median_rows", quantiles(sizes, "size", {"m": 0.5}).scalar())


def period_range(df: DataFrame, period: Column | str, unit: str = "month") -> DataFrame:
    """First and last period and how many distinct ones occur."""
    p = F.date_trunc(unit, F.col(period) if isinstance(period, str) else period).cast("date")
    return df.select(p.alias("p")).groupBy("p").agg(F.lit(1)).agg(
        F.min("p").alias("first_period"), F.max("p").alias("last_period"), F.count("p").alias("n_periods")
    )


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each label value, and the share relative to the rarest value."""
    counts = df.groupBy(F.col(label).alias("label")).agg(row_count().alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.min("n").alias("least"))).scalar()
    return counts.select(
        "label", "n", (F.col("n") / total.getField("n")).alias("share"),
        (F.col("n") / total.getField("least")).alias("ratio_to_rarest"),
    )


def shape_masks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each string shape (digits shown as 9) occurs, per column."""
    masked = df.select(*[digit_mask(c).alias(c) for c in columns])
    return value_counts(masked, columns).withColumnRenamed("value", "mask")


def histogram_fixed(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Counts over ``(lo, hi]`` bins, empty bins kept; one aggregate without a row shuffle.

    The first bin has no lower and the last no upper end, so every value is counted.
    """
    x = F.col(column)
    b = F.when(x <= float(edges[0]), 0).when(x > float(edges[-1]), len(edges)).otherwise(bin_right_closed(x, edges))
    bins = list(zip([None, *edges], [*edges, None]))
    row = df.select(b.alias("b")).agg(*[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(len(bins))])

    def end(v: float | None) -> Column:
        return F.lit(None if v is None else float(v)).cast("double")

    return row.select(F.inline(F.array(*[
        F.struct(end(lo).alias("lo"), end(hi).alias("hi"), F.col(f"b{i}").alias("n")) for i, (lo, hi) in enumerate(bins)
    ])))


def histogram_equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts and density over ``bins`` equal bins between minimum and maximum, empty bins kept."""
    x = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))).scalar()
    lo, width = ends.getField("lo"), (ends.getField("hi") - ends.getField("lo")) / bins
    # a constant column has bins of no width: everything falls into the first
    at = F.coalesce(F.least(F.floor(F.try_divide(x - lo, width)), F.lit(bins - 1)), F.lit(0))
    counts = df.where(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(row_count().alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return full.select(
        "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n",
        F.try_divide(F.col("n"), ends.getField("n") * width).alias("density"),
    )


def counts_by_period(df: DataFrame, period: Column | str, unit: str = "month") -> DataFrame:
    p = F.col(period) if isinstance(period, str) else period
    return df.groupBy(F.date_trunc(unit, p).cast("date").alias("period")).agg(row_count().alias("n"))


def sparse_periods(df: DataFrame, period: Column | str, unit: str, threshold: float) -> DataFrame:
    """Periods with fewer rows than ``threshold`` times the mean, beside mean and sd of all periods."""
    counts = counts_by_period(df, period, unit)
    s = counts.agg(F.struct(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), row_count().alias("periods")
    )).scalar()
    return counts.select(
        "period", "n", s.getField("mean").alias("mean_n"), s.getField("sd").alias("sd_n"),
        s.getField("periods").alias("n_periods"),
    ).where(F.col("n") < F.col("mean_n") * threshold)


def band_summary(df: DataFrame, column: str, low: Column | float, high: Column | float) -> DataFrame:
    """Rows below, inside and above two bounds: count, range, mean, share of rows."""
    lo, hi = (b if isinstance(b, Column) else F.lit(float(b)) for b in (low, high))
    x = F.col(column)
    band = F.when(x < lo, "below").when(x > hi, "above").otherwise("inside")
    total = df.where(x.isNotNull()).agg(row_count()).scalar()
    return df.where(x.isNotNull()).groupBy(band.alias("band")).agg(
        row_count().alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
    ).withColumn("share", F.col("n") / total)


def top_values(df: DataFrame, column: str, key: str, n: int, *, largest: bool = True) -> DataFrame:
    """The n rows with the largest (or smallest) value; ties go to the smaller key."""
    order = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
    return df.select(key, column).where(F.col(column).isNotNull()).orderBy(order, F.col(key)).limit(n)


def seeded_sample(df: DataFrame, key: Column | str, n: int, seed: int) -> DataFrame:
    """Exactly n rows without replacement, the same rows in any engine: smallest hashes first."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string")))
    return df.orderBy(h, k).limit(n)


def evidence_rows(df: DataFrame, key: Sequence[str], column: str, condition: Column) -> DataFrame:
    """Every flagged row: its key, the value and the value's text."""
    return df.where(condition).select(*key, F.col(column).alias("value"), F.format_string("%.2f", F.col(column)).alias("evidence"))


def evidence_top(df: DataFrame, column: str, condition: Column, n: int) -> DataFrame:
    """The ``n`` smallest flagged values as one line of text, with the count and range of all of them."""
    x = F.col(column)
    flagged = df.where(condition).select(x.alias("x"))
    listed = flagged.orderBy("x").limit(n).agg(F.array_sort(F.collect_list("x")).alias("v"))
    text = F.array_join(F.transform("v", lambda v: F.format_string("%.2f", v)), ", ")
    return flagged.agg(row_count().alias("n"), F.min("x").alias("lowest"), F.max("x").alias("highest")).withColumn(
        "listed", listed.select(text.alias("t")).scalar())
