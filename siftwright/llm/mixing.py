"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's part of the budget, but gives at most ``max_epochs`` times
its own size; what a clamped source cannot give is shared among the others by weight, until no
source is above its cap. A source's target is then met by whole repetitions of all its
documents and one fractional pass: its documents in seeded order, until the target is reached,
the last of them with its leading words only. The cut is a threshold in the seeded order, so
texts are never shuffled: sizes are summed per (source, hash range), and only the range that
holds the cut is ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

RANGE_ROWS = 20_000


def water_fill(sizes: DataFrame, *, share: float, max_epochs: float) -> DataFrame:
    """``target`` (double) for each row of ``sizes`` (source, source_size, weight; one row per source).

    Clamps all sources above their cap, hands their excess to the rest by weight, and repeats
    until none is above. Two sums reach the driver in each round. ``share`` may not exceed
    ``max_epochs``; a total of 0 gives targets of 0.
    """
    if share > max_epochs:
        raise ValueError("the caps cannot give that much")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = math.inf
    free = sizes.agg(F.sum("weight")).first()[0] or 0
    fixed, level = 0.0, (share * total / free if free else 0.0)
    clamped = -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        row = sizes.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("w"),
        ).first()
        if row["n"] == clamped or not row["w"]:
            break
        clamped, fixed = row["n"], row["caps"] or 0.0
        # a source once above its cap stays there: the level only rises
        level = (share * total - fixed) / row["w"]
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def weigh(sources: DataFrame, pattern: list[float]) -> DataFrame:
    """``weight`` by the source's place in code point order, null last; one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    return sources.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(pattern)))))


def mix(df: DataFrame, *, size: str, source: str, key: list[str], pattern: list[float], share: float = 1.5,
        max_epochs: float = 2.0, seed: int = 23) -> DataFrame:
    """All rows of ``df`` with ``source_size``, ``target``, ``whole`` (full repetitions) and ``part`` (words of one more).

    ``key`` columns seed the order. Rows alike in ``key`` stand at one place in it; if the cut
    falls there, they share what is left in proportion to their sizes, rounded down. A null
    source is a source; rows of size 0 take nothing. Input columns of those names are
    replaced. ``df`` is read three times: give a stored table where its columns are costly.
    """
    made = ["source_size", "target", "whole", "part"]
    df = df.drop(*[c for c in df.columns if c in made])
    n = df.count()
    bits = max(4, math.ceil(math.log2(max(1, n) / RANGE_ROWS)))
    order = F.xxhash64(F.lit(seed), *key)
    slim = df.select(F.col(source).alias("source"), F.col(size).alias("size"), order.alias("h")).withColumn(
        "part", F.shiftright("h", 64 - bits))
    ranges = materialize(slim.groupBy("source", "part").agg(F.sum("size").alias("words")), "mix-ranges")
    sizes = materialize(weigh(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), pattern), "mix-sources")
    targets = materialize(water_fill(sizes, share=share, max_epochs=max_epochs), "mix-targets")
    plan = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("left", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .where("before <= left and left < before + words")
        .select("of", "left", F.col("before").alias("range_before"), F.col("part").alias("range"))
    )
    inside = Window.partitionBy("of").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cut = materialize(
        slim.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("range")))
        .groupBy("of", "left", "range_before", "h").agg(F.sum("size").alias("words"))
        .withColumn("before", F.col("range_before") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .where("before <= left and left < before + words")
        .select("of", F.col("h").alias("cut"), (F.col("left") - F.col("before")).alias("rest"), F.col("words").alias("tied")),
        "mix-cuts",
    )
    plan = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.of")), "left").select(
        F.col("p.source").alias("plan_source"), "source_size", "target", "whole", "left", "cut", "rest", "tied")
    rows = df.withColumn("_h", order)
    taken = (
        # no cut: the fractional pass is empty or takes everything
        F.when(F.col("cut").isNull(), F.when(F.col("left") > 0, F.col(size)).otherwise(0))
        .when(F.col("_h") < F.col("cut"), F.col(size))
        .when(F.col("_h") == F.col("cut"), F.floor(F.col(size) * F.col("rest") / F.col("tied")))
        .otherwise(0).cast("long")
    )
    return (
        rows.join(plan, F.col(source).eqNullSafe(F.col("plan_source")))
        .withColumn("part", taken)
        .select(*df.columns, *made)
    )
