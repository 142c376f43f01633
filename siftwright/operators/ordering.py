"""Order statistics over whole tables without a one-task sort.

A window without a partition key would pull every row into one task, and Spark's exact
``percentile`` keeps every distinct value of a group in one buffer. Both are avoided the same way:

1. collapse to distinct values first (a hot value becomes one row, combined map-side);
2. cut the value range into buckets at a small sorted sample of those values. The sample is chosen
   by the values' hashes, so it is the same on every run and after a lost task;
3. order inside each bucket, and add each bucket's offset from a table of bucket totals.

Cuts are taken on (group..., value) together, so a group that holds most of the rows spreads over
many buckets while small groups share one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import edges_passed
from ..sources.scratch import materialize

_BUCKET = "__bucket"


def bucket_count(df: DataFrame) -> int:
    """Buckets in proportion to the session's shuffle width, 32 at least."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(32, 4 * width)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which two NULL keys match; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _with_bucket(df: DataFrame, order: Column) -> DataFrame:
    """Add the bucket of ``order``."""
    n = bucket_count(df)
    # one distinct value in 256, by hash, is candidate for a cut: the pass shuffles next to nothing,
    # and a table with few distinct values needs few buckets anyway; no row is left out of a bucket
    candidates = df.select(order.alias("k")).where(F.xxhash64("k").bitwiseAND(F.lit(255)) == 0).distinct()
    sample = candidates.orderBy(F.xxhash64("k"), "k").limit(n - 1)
    cuts = sample.agg(F.array_sort(F.collect_list("k")).alias("cuts")).scalar()
    return (
        df.withColumn("__cuts", cuts)
        .withColumn(_BUCKET, edges_passed(F.col("__cuts"), order, n))
        .drop("__cuts")
    )


def _bucket_offsets(bucketed: DataFrame, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Per (group, bucket): the sums over the group's earlier buckets and over the whole group."""
    totals = bucketed.groupBy(*by, _BUCKET).agg(*[F.sum(c).alias(c) for c in counts])
    # at most bucket_count() rows per group reach this window
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by, _BUCKET,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}__off") for c in counts],
        *[F.sum(c).over(group).alias(f"{c}_total") for c in counts],
    )


def ordered_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    *,
    weight: str | None = None,
) -> DataFrame:
    """One row per distinct value with running totals in ascending order of the value.

    For ``n`` (rows) and every name in ``sums``: the value's own total, ``<name>_before`` (all
    smaller values of the group) and ``<name>_total`` (whole group). NULL values are left out.
    ``weight`` names a column of row counts when ``df`` is already aggregated. The input runs
    once: its distinct values are stored, and cuts, order and offsets read them from there.
    """
    by = list(by)
    sums = dict(sums or {})
    counts = ["n", *sums]
    present = df.where(F.col(value).isNotNull())
    per_value = (
        present.groupBy(*by, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    )
    return _running_totals(materialize(per_value, "values"), value, by, counts)


def _running_totals(per_value: DataFrame, value: str, by: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """:func:`ordered_counts` of a stored table with one row per (group, value)."""
    bucketed = _with_bucket(per_value, F.struct(*by, value))
    inside = (
        Window.partitionBy(*by, _BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = bucketed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}__in") for c in counts]
    )
    offsets = _bucket_offsets(bucketed, by, counts)
    joined = null_safe_join(local, offsets, [*by, _BUCKET])
    return joined.select(
        *by, value, *counts,
        *[(F.col(f"{c}__in") + F.col(f"{c}__off")).alias(f"{c}_before") for c in counts],
        *[F.col(f"{c}_total") for c in counts],
    )


def _brackets(present: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """Per group: rows and, for every probability, two values of which a sketch says that the quantile lies between them.

    The sketch errs by at most a share of 1 / ``accuracy`` of the ranks; the bounds are twice that away. Groups of fewer
    than 2 * ``accuracy`` rows, where that is less than four ranks, are bracketed whole.
    """
    margin = 2.0 / accuracy
    ends = [(max(0.0, p - margin), min(1.0, p + margin)) for p in probs]
    sketch = present.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile_approx(value, [q for pair in ends for q in pair], accuracy).alias("q"))
    few = F.col("rows") < 2 * accuracy
    columns = []
    for i, (lo, hi) in enumerate(ends):
        columns += [
            F.when(few | F.lit(lo <= 0), F.col("least")).otherwise(F.get("q", F.lit(2 * i))).alias(f"lo{i}"),
            F.when(few | F.lit(hi >= 1), F.col("most")).otherwise(F.get("q", F.lit(2 * i + 1))).alias(f"hi{i}"),
        ]
    return sketch.select(*by, F.struct("rows", *columns).alias("__b"))


def _bracketed_values(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame | None:
    """Stored (group, value, n) that gives the same quantiles as all distinct values, or None where a bracket has missed.

    Values inside a bracket keep their own row. All others between two brackets count for the least of them, so a
    group sends at most one row a task for each bracket besides the values inside, a share of at most
    6 / ``accuracy`` of its rows for each probability.
    """
    present = df.where(F.col(value).isNotNull()).select(*by, value)
    # one row per group, written so that its size is known when the join is planned
    found = materialize(_brackets(present, value, probs, by, accuracy), "brackets")
    if by:
        marked = null_safe_join(present, found, by)
    else:
        marked = present.withColumn("__b", found.scalar())
    x, b = F.col(value), F.col("__b")
    bounds = [(b.getField(f"lo{i}"), b.getField(f"hi{i}")) for i in range(len(probs))]
    inside = reduce(lambda a, c: a | c, [x.between(lo, hi) for lo, hi in bounds])
    passed = reduce(lambda a, c: a + c, [(x > hi).cast("int") for _, hi in bounds])
    cells = marked.select(*by, value, F.when(inside, x).alias("__own"), F.when(~inside, passed).alias("__region"))
    counted = cells.groupBy(*by, "__own", "__region").agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n"))
    values = materialize(counted.select(*by, value, "n", F.col("__own").isNotNull().alias("__exact")), "values")
    # whether each wanted rank falls inside its bracket: sums over the stored values, one flag comes back
    held = null_safe_join(values, found, by) if by else values.withColumn("__b", found.scalar())
    per = held.groupBy(*by).agg(F.first("__b").getField("rows").alias("rows"), *[
        agg for i, (lo, hi) in enumerate(bounds) for agg in (
            F.sum(F.when(x < lo, F.col("n")).otherwise(0)).alias(f"below{i}"),
            F.sum(F.when(F.col("__exact") & x.between(lo, hi), F.col("n")).otherwise(0)).alias(f"in{i}"))
    ])
    ranks = [(F.col("rows") - 1) * F.lit(float(p)) for p in probs]
    whole = reduce(lambda a, c: a & c, [
        (F.col(f"below{i}") <= F.floor(r)) & (F.ceil(r) < F.col(f"below{i}") + F.col(f"in{i}")) for i, r in enumerate(ranks)])
    return values.drop("__exact") if per.where(~whole).isEmpty() else None


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    *,
    approximate: bool = False,
    weight: str | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group, one column per name in ``probs``.

    Exact by default, in two passes: a mergeable sketch brackets each quantile, a second pass counts what lies below
    and orders only the values inside the brackets. A bracket that misses its rank (the count tells) sends the whole
    column through :func:`ordered_counts`, as does ``weight``. ``accuracy`` decides how narrow the brackets are, not
    the result. ``approximate`` trades exactness for the sketch alone.
    """
    by = list(by)
    if approximate:
        names = list(probs)
        sketch = df.groupBy(*by).agg(
            F.percentile_approx(value, [probs[k] for k in names], 10000).alias("q")
        )
        return sketch.select(*by, *[F.get("q", F.lit(i)).cast("double").alias(k) for i, k in enumerate(names)])
    values = None if weight else _bracketed_values(df, value, list(probs.values()), by, accuracy)
    counts = ordered_counts(df, value, by, weight=weight) if values is None else _running_totals(values, value, by, ["n"])
    x = F.col(value).cast("double")
    end = F.col("n_before") + F.col("n")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= position) & (position < end), x))

    wanted = []
    for name, p in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        wanted += [
            at(F.floor(position)).alias(f"{name}__lo"),
            at(F.ceil(position)).alias(f"{name}__hi"),
            F.max(position - F.floor(position)).alias(f"{name}__f"),
        ]
    found = counts.groupBy(*by).agg(*wanted)
    return found.select(*by, *[
        (F.col(f"{k}__lo") + (F.col(f"{k}__hi") - F.col(f"{k}__lo")) * F.col(f"{k}__f")).alias(k)
        for k in probs
    ])


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), *, name: str = "metric", value: str = "value", dtype: str = "double") -> DataFrame:
    """Wide to long: one row per (row, column)."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(dtype).alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells))


def add_position(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), *, name: str = "position", stored: bool = False) -> DataFrame:
    """1-based position of every row in the ascending ``order`` of its group.

    ``order`` must identify a row inside the group (end it with the key), otherwise tied rows are
    numbered arbitrarily. Equivalent to ``row_number`` but no group is sorted in one task. The
    input runs once: its rows are stored, and cuts, order and offsets read them from there; ``stored``
    says that ``df`` is such a table already.
    """
    by = list(by)
    bucketed = _with_bucket(df if stored else materialize(df, "positions"), F.struct(*by, *order))
    counted = bucketed.withColumn("__one", F.lit(1).cast("bigint"))
    offsets = _bucket_offsets(counted, by, ["__one"]).drop("__one_total")
    inside = Window.partitionBy(*by, _BUCKET).orderBy(*order)
    local = bucketed.withColumn("__rn", F.row_number().over(inside))
    joined = null_safe_join(local, offsets, [*by, _BUCKET])
    return joined.select(*df.columns, (F.col("__rn") + F.col("__one__off")).alias(name))


def consecutive_gaps(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the next larger value and the gap between them."""
    present = df.where(F.col(value).isNotNull()).select(F.col(value).alias("lower"))
    distinct = materialize(present.distinct(), "values")
    bucketed = _with_bucket(distinct, F.struct("lower"))
    firsts = bucketed.groupBy(_BUCKET).agg(F.min("lower").alias("__first"))
    # at most bucket_count() rows
    follow = firsts.select(
        _BUCKET, F.lead("__first").over(Window.partitionBy(F.lit(0)).orderBy(_BUCKET)).alias("__next")
    )
    inside = Window.partitionBy(_BUCKET).orderBy("lower")
    local = bucketed.withColumn("__lead", F.lead("lower").over(inside))
    joined = null_safe_join(local, follow, [_BUCKET]).select("lower", F.coalesce("__lead", "__next").alias("upper"))
    return joined.where("upper is not null").withColumn("gap", F.col("upper") - F.col("lower"))
