"""Reproducible shuffle of all rows into shards of equal row counts.

A row's place in the order of its key hash is its global row number; a Feistel permutation of
[0, N) turns that number into its place in the shuffled corpus, and shard and slot are
remainder and quotient of the place. Nothing is sorted as a whole: distinct rows are counted,
cut into hash ranges, numbered inside a range, and the ranges' totals are added up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import bind

ROUNDS = 6
RANGE_ROWS = 50_000
WALK = 64


def halves(n: int) -> tuple[int, int]:
    """Sides a, b of the permuted rectangle: a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def feistel(number: Column, n: int, seed: int) -> Column:
    """One pass of a permutation of [0, a * b) for the sides of :func:`halves`.

    Each round adds a keyed hash of one half to the other, modulo that half's range; rounds
    are undone by subtraction, so the pass is one-to-one on any rectangle.
    """
    a, b = halves(n)
    pair = F.struct((number % b).alias("r"), F.call_function("div", number, F.lit(b)).cast("long").alias("l"))
    for k in range(ROUNDS):
        key = F.lit(seed * 1000 + k)
        if k % 2:
            pair = bind(pair, lambda p, key=key: F.struct(
                F.pmod(p["r"] + F.pmod(F.xxhash64(p["l"], key), F.lit(b)), F.lit(b)).alias("r"), p["l"].alias("l")))
        else:
            pair = bind(pair, lambda p, key=key: F.struct(
                p["r"].alias("r"), F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], key), F.lit(a)), F.lit(a)).alias("l")))
    return bind(pair, lambda p: p["l"] * F.lit(b) + p["r"])


def shuffled_place(number: Column, n: int, seed: int) -> Column:
    """Place of row ``number`` in the seeded shuffle of [0, n), by cycle walking.

    Fewer than a = sqrt(n) of the rectangle's numbers lie outside [0, n). Up to n = 4096 the
    64 steps exceed that count, so the walk always ends; beyond, 64 misses in a row have a
    probability below n ** -32.
    """
    a, b = halves(n)
    once = feistel(number, n, seed)
    if a * b == n:
        return once
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once,
                       lambda at, _: F.when(at < n, at).otherwise(feistel(at, n, seed)))


def shard_rows(df: DataFrame, keys: list[str], shards: int, *, seed: int = 17) -> DataFrame:
    """``keys`` of every row with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most. Rows alike in all ``keys`` are counted before the
    shuffle and expanded after numbering, so any number of them costs one row each only at the
    end; they get different places. Nulls are keys like any other. Columns outside ``keys``,
    also ones named like the results, are not read. An empty table gives an empty result.
    """
    n = df.count()
    ranges = max(1, 1 << max(0, math.ceil(math.log2(max(1, n) / RANGE_ROWS))))
    bits = ranges.bit_length() - 1
    names = {k: f"k{i}" for i, k in enumerate(keys)}
    counted = (
        df.select(*[F.col(k).alias(v) for k, v in names.items()])
        .groupBy(*names.values()).agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("h", F.xxhash64(F.lit(seed), *names.values()))
        # the top bits of the hash, so that ranges follow each other in hash order
        .withColumn("part", (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)).cast("long"))
    )
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counted.groupBy("part").agg(F.sum("copies").alias("in_part"))
              .withColumn("before_part", F.coalesce(F.sum("in_part").over(order), F.lit(0))).drop("in_part"))
    inside = Window.partitionBy("part").orderBy("h", *names.values()).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        counted.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(starts, "part")
        .withColumn("first", F.col("before") + F.col("before_part"))
        .select(*names.values(), F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("number"))
        .withColumn("place", shuffled_place(F.col("number"), max(1, n), seed))
    )
    return numbered.select(
        *[F.col(v).alias(k) for k, v in names.items()],
        (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).cast("long").alias("slot"),
    )

