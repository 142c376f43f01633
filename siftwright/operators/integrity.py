"""Keys, duplicates, joins, calendars and text hygiene."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_month_end, normalised, swap_month_day
from ..sources.scratch import materialize
from .ordering import null_safe_join, quantiles
from .profile import row_count, value_counts


# ------------------------------------------------------------------ duplicates
def text_digest(c: Column | str) -> Column:
    """32-byte SHA-256 of the whole text: a key that shuffles instead of the text it stands for."""
    return F.unhex(F.sha2(F.col(c) if isinstance(c, str) else c, 256))


def differs(c: str) -> Column:
    """Whether a column takes more than one value in a group, NULL counted as a value (aggregate).

    Two values differ when minimum and maximum do, so no distinct set is kept and the partial
    results of a hot key stay one row per task.
    """
    gap = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
    return F.coalesce(F.min(c) != F.max(c), F.lit(False)) | gap


def _conflict(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether the rows of a group differ in any of the columns (aggregate over two 64-bit row hashes).

    Hashes are numbers, so minimum and maximum are kept in a hash table and no row is sorted.
    Two different rows go unnoticed with a chance of 2 ** -128. NULLs count through a mask.
    """
    if not columns:
        return F.lit(False)
    kinds = dict(df.dtypes)
    # 0.0 and -0.0 are one value
    values = [F.col(c) + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    hashes = [F.xxhash64(F.lit(seed), mask, *values) for seed in (1, 2)]
    return reduce(lambda a, b: a | b, [F.min(h) != F.max(h) for h in hashes])


def key_classes(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: its rows and the class unique / exact / conflict (two NULLs are equal)."""
    rest = [c for c in df.columns if c not in key]
    per_key = df.groupBy(*key).agg(row_count().alias("n_rows"), _conflict(df, rest).alias("__conflict"))
    return per_key.select(*key, "n_rows", (
        F.when(F.col("n_rows") == 1, "unique").when(F.col("__conflict"), "conflict").otherwise("exact")
    ).alias("dup_class"))


def duplicate_summary(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys and rows per duplicate class."""
    return key_classes(df, key).groupBy("dup_class").agg(
        row_count().alias("n_keys"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("largest_group")
    )


def classify_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every input row with the class and size of its key group.

    Only repeated keys travel to the join, one row each; a key holding a large part of the rows
    is split on the row side by adaptive skew handling.
    """
    repeated = key_classes(df, key).where("n_rows > 1").select(*key, "n_rows", "dup_class")
    joined = null_safe_join(df, repeated, list(key), "left")
    return joined.select(
        *df.columns, F.coalesce("n_rows", F.lit(1)).cast("bigint").alias("group_rows"),
        F.coalesce("dup_class", F.lit("unique")).alias("dup_class"),
    )


def keep_first(df: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the first in ``order_by``, with ``dq_dup_conflict`` and the group's size.

    The survivor is a minimum over a struct, which combines before the shuffle (Spark sorts a
    task's rows by key for it). Give a digest and a short row key where rows hold long texts, and
    fetch the survivors by that key. Without a declared order the remaining columns, left to right with NULL first, decide.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    lead = list(order_by or [])
    order = lead + [c for c in rest if c not in lead]
    agg = df.groupBy(*key).agg(
        F.min(F.struct(*order)).alias("first"), row_count().alias("dup_rows"), _conflict(df, rest).alias("dq_dup_conflict")
    )
    return agg.select(
        *[F.col(c) if c in key else F.col(f"first.{c}").alias(c) for c in df.columns], "dup_rows", "dq_dup_conflict"
    )


def differing_columns(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """For every conflicting key the columns on which its rows disagree (NULL counts as a value)."""
    rest = [c for c in df.columns if c not in key]
    per_key = df.groupBy(*key).agg(
        row_count().alias("n_rows"),
        F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in rest])).alias("cols"),
    )
    return per_key.where(F.size("cols") > 0).select(
        *key, "n_rows", F.size("cols").cast("bigint").alias("n_differing"),
        F.array_join("cols", ",").alias("differing_columns"),
    )


def date_swap_pairs(df: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    """Keys with several different dates, and whether two of them are each other with month and day swapped.

    A key keeps the set of its dates, at most one for each day of the calendar.
    """
    days = df.select(*key, F.to_date(date).alias("d")).where("d is not null").groupBy(*key).agg(F.array_sort(F.collect_set("d")).alias("days"))
    swapped = F.exists("days", lambda d: F.coalesce(F.array_contains("days", swap_month_day(d)) & (swap_month_day(d) != d), F.lit(False)))
    return days.where(F.size("days") > 1).select(
        *key, F.size("days").cast("bigint").alias("n_dates"), F.array_min("days").alias("first_date"), F.array_max("days").alias("last_date"),
        swapped.alias("has_swap"),
    )


# ------------------------------------------------------------------ keys across tables
def orphan_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    keys = left.select(F.col(left_key).alias("key")).where("key is not null").distinct()
    return keys.join(right.select(F.col(right_key).alias("key")), "key", "left_anti")


def key_set_equality(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys on each side only, and whether the two sets are equal."""
    tagged = left.select(F.col(left_key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(right_key).alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = tagged.where("key is not null").groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"),
        F.count_if(F.col("r") == 0).alias("left_only"),
        F.count_if(F.col("l") == 0).alias("right_only"),
    ).withColumn("equal_sets", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def fan_out(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows a join on these keys would return, without building it: products of per-key counts."""
    a = left.groupBy(F.col(left_key).alias("key")).agg(row_count().alias("a"))
    b = right.groupBy(F.col(right_key).alias("key")).agg(row_count().alias("b"))
    rows_in = left.agg(row_count()).scalar()
    out = a.join(b, "key").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("rows_out"))
    return out.select(
        rows_in.alias("rows_in"), "rows_out", F.try_divide("rows_out", rows_in).alias("fan_out")
    )


# ------------------------------------------------------------------ timelines and calendars
def flag_before_start(fact: DataFrame, entity: DataFrame, *, fact_key: str, entity_key: str, fact_date: str, start_date: str, flag: str = "dq_before_start") -> DataFrame:
    """Fact rows with the entity's start and a flag where the fact comes first; no row is dropped.

    ``entity`` holds one row per key. Rows whose entity is unknown keep a NULL start and no flag.
    """
    starts = entity.select(F.col(entity_key).alias("__k"), F.col(start_date).alias("start_date"))
    joined = fact.join(starts, fact[fact_key] == F.col("__k"), "left").drop("__k")
    early = F.coalesce(F.col(fact_date) < F.col("start_date"), F.lit(False))
    return joined.withColumn(flag, early).withColumn(
        "days_before_start", F.when(F.col(flag), F.datediff("start_date", fact_date))
    )


def date_counts(fact: DataFrame, key: str, date: str) -> DataFrame:
    """Rows per entity and date: what a hot entity brings to a join is its dates, not its rows."""
    return fact.groupBy(key, date).agg(row_count().alias("n_rows"))


def before_start_summary(flagged: DataFrame, key: str, flag: str = "dq_before_start", *, weight: str | None = None) -> DataFrame:
    """Rows and entities affected, and the median and largest lag in days.

    ``weight`` names the row count of a ``flagged`` made from :func:`date_counts`.

    The flagged rows are reduced once to counts per entity and lag and stored, so the join beneath
    runs a single time although entity counts and median read the result separately.
    """
    lag = F.when(F.col(flag), F.col("days_before_start")).alias("lag")
    lags = flagged.groupBy(F.col(key).alias("entity"), F.col(flag).alias("bad"), lag).agg(
        (F.sum(weight) if weight else row_count()).alias("n"))
    lags = materialize(lags, "lags")
    per_entity = lags.groupBy("entity").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("bad"), F.max("lag").alias("lag")
    )
    row = per_entity.agg(
        F.sum("n").alias("n_rows"), F.sum("bad").alias("affected_rows"),
        F.count_if(F.col("bad") > 0).alias("affected_entities"), row_count().alias("entities"),
        F.max("lag").alias("max_days"),
    )
    median = quantiles(lags, "lag", {"m": 0.5}, weight="n").scalar()
    return row.select("*", median.alias("median_days"), F.try_divide(F.col("affected_rows") * 100, F.col("n_rows")).alias("affected_pct"))


def calendar_gaps(df: DataFrame, period: Column | str, unit: str = "month") -> DataFrame:
    """Periods between the first and the last that hold no row at all."""
    p = F.date_trunc(unit, F.col(period) if isinstance(period, str) else period).cast("date")
    present = df.select(p.alias("period")).where("period is not null").distinct()
    step = F.expr(f"interval 1 {unit}")
    full = present.agg(F.min("period").alias("a"), F.max("period").alias("b")).select(
        F.explode(F.sequence("a", "b", step)).alias("period")
    )
    return full.join(present, "period", "left_anti")


def grid_missing_cells(df: DataFrame, entity: str, period: Column | str, unit: str = "month") -> DataFrame:
    """(entity, period) cells absent from the grid of known entities and occurring periods.

    Each entity's own periods are subtracted from the list of all periods - a list no longer than
    the calendar - so the full grid is never built.
    """
    p = F.date_trunc(unit, F.col(period) if isinstance(period, str) else period).cast("date")
    cells = df.select(F.col(entity).alias("entity"), p.alias("period")).where("period is not null").distinct()
    every = cells.select("period").distinct().agg(F.array_sort(F.collect_list("period"))).scalar()
    own = cells.groupBy("entity").agg(F.collect_list("period").alias("own"))
    return own.select("entity", F.explode(F.array_except(every, F.col("own"))).alias("period"))


def grid_missing_runs(df: DataFrame, entity: str, period: Column | str, unit: str = "month") -> DataFrame:
    """Runs of absent cells of the grid: (entity, first and last absent period, number of them).

    Periods that occur anywhere are numbered once; an entity's present numbers in order leave a
    run wherever two neighbours are more than one apart, and before the first and after the last.
    Rows of the result are gaps, not cells; an entity's own numbers are no more than the calendar.
    """
    p = F.date_trunc(unit, F.col(period) if isinstance(period, str) else period).cast("date")
    cells = materialize(df.select(F.col(entity).alias("entity"), p.alias("period")).where("period is not null").distinct(), "grid-cells")
    every = cells.select("period").distinct().agg(F.array_sort(F.collect_list("period"))).scalar()
    numbered = cells.withColumn("__all", every).select("entity", F.array_position("__all", F.col("period")).cast("int").alias("at"), F.size("__all").alias("last"))
    turn = Window.partitionBy("entity").orderBy("at")
    edges = numbered.select("entity", "at", "last", F.coalesce(F.lag("at").over(turn), F.lit(0)).alias("before"), F.lead("at").over(turn).isNull().alias("ends"))
    inner = edges.where("at - before > 1").select("entity", (F.col("before") + 1).alias("lo"), (F.col("at") - 1).alias("hi"))
    outer = edges.where("ends and at < last").select("entity", (F.col("at") + 1).alias("lo"), F.col("last").alias("hi"))
    return inner.unionByName(outer).withColumn("__all", every).select(
        "entity", F.get("__all", F.col("lo") - 1).alias("first_period"), F.get("__all", F.col("hi") - 1).alias("last_period"),
        (F.col("hi") - F.col("lo") + 1).cast("bigint").alias("n_periods"))


def grid_completeness(df: DataFrame, entity: str, period: Column | str, unit: str = "month") -> DataFrame:
    """Entities, periods, cells expected and present, and rows beyond one per cell."""
    p = F.date_trunc(unit, F.col(period) if isinstance(period, str) else period).cast("date")
    cells = df.select(F.col(entity).alias("e"), p.alias("p")).groupBy("e", "p").agg(row_count().alias("n"))
    periods = cells.groupBy("p").agg(F.lit(1)).agg(F.count("p")).scalar()
    per_entity = cells.groupBy("e").agg(row_count().alias("c"), F.sum("n").alias("n"))
    return per_entity.agg(
        row_count().alias("entities"), F.sum("c").alias("cells_present"), F.sum("n").alias("n_rows")
    ).select(
        "entities", periods.alias("periods"), (F.col("entities") * periods).alias("cells_expected"),
        "cells_present", (F.col("entities") * periods - F.col("cells_present")).alias("cells_missing"),
        (F.col("n_rows") - F.col("cells_present")).alias("surplus_rows"),
    )


def period_hygiene(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Month-end share, distinct and expected months, and repeated (entity, date) pairs."""
    d = F.to_date(date)
    pairs = df.groupBy(F.col(entity).alias("e"), d.alias("d")).agg(row_count().alias("n"))
    days = pairs.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra"))
    row = days.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(is_month_end("d"), F.col("n")).otherwise(0)).alias("month_end_rows"),
        F.sum("extra").alias("surplus_pairs"),
        F.min("d").alias("a"), F.max("d").alias("b"),
    )
    months = days.groupBy(F.date_trunc("month", "d")).agg(F.lit(1)).agg(row_count()).scalar()
    span = (F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a") + 1
    return row.select(
        "n_rows", "month_end_rows", (F.col("month_end_rows") == F.col("n_rows")).alias("all_month_end"),
        months.alias("months_present"), span.cast("bigint").alias("months_expected"), "surplus_pairs",
    )


def future_dated(df: DataFrame, date: str, end: Column) -> DataFrame:
    """Rows dated after the end of the observation window."""
    return df.agg(row_count().alias("n_rows"), F.count_if(F.col(date) > end).alias("after_end"))


# ------------------------------------------------------------------ text and number hygiene
def category_hygiene(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values raw and after trimming and lower-casing, and rows with outer blanks."""
    counts = value_counts(df, columns).where("value is not null")
    folded = counts.groupBy("column", normalised("value").alias("folded")).agg(
        row_count().alias("raw"), F.sum(F.when(F.col("value") != F.trim("value"), F.col("n")).otherwise(0)).alias("padded"),
    )
    return folded.groupBy("column").agg(
        F.sum("raw").alias("raw_values"), row_count().alias("folded_values"), F.sum("padded").alias("padded_rows")
    ).withColumn("has_variants", F.col("raw_values") != F.col("folded_values"))


def number_hygiene(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    """Non-integer values and values at or below ``low`` or above ``high`` (sentinels), per column."""
    from .profile import long_stats

    return long_stats(df, columns, {
        "n": lambda c: F.count(c),
        "non_integer": lambda c: F.count_if(F.col(c) != F.rint(F.col(c).cast("double"))),
        "sentinels": lambda c: F.count_if((F.col(c) <= low) | (F.col(c) > high)),
    })


def unparseable_dates(df: DataFrame, column: str) -> DataFrame:
    """Non-null strings that are no date, and those written with slashes."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("n"), F.count_if(c.isNotNull() & F.try_to_date(c).isNull()).alias("unparseable"),
        F.count_if(F.contains(c, F.lit("/"))).alias("with_slash"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
