"""Near duplicates by SimHash: fingerprints of 64 bits, linked at RADIUS or fewer differing bits by multi-index hashing.

A fingerprint is cut into SEGMENTS of 32 bits. Two fingerprints that differ in at most three bits
differ in at most one bit of some segment, so a table of all segment values is asked for the small
Hamming ball around each segment: the value itself and the values with one bit less (the pair's
other member asks for the same pair's bit more). Complete distances confirm what the table gives.

A segment value that more than HOT distinct fingerprints share would give too many pairs, so its
members meet in the other segment instead: members of the value lay out the points at 0 to 2 bits
from their other half, askers (one bit off already) those at 0 and 1 bit. Everybody at a point
links to one member at most 1 bit from it. All these links are true ones (2 + 1 bits, or
1 + 1 + 1), and any two fingerprints that should be linked share such a point; the pairs that are
not given out join the same component. A point is shared by a bounded number of fingerprints.

Copies have one fingerprint and are one class; only distinct fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, settle
from .components import components
from .ship import ship
from .text import whole

SHINGLE = 3
SEED = 42
RADIUS = 3
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
HOT = 256
_CHUNK = 1 << 16


def fingerprint(text: str, *, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of each bit over the hashes of all shingles, repeats included; zero without a word."""
    words = text.encode().lower().split()
    last = max(len(words) - shingle + 1, 1) if words else 0
    ones = np.zeros(64, np.int64)
    for at in range(0, last, _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(at, min(last, at + _CHUNK))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``fingerprint`` as a signed long in place of ``text``."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return df.select(*[c for c in df.columns if c not in (text, "fingerprint")], of(whole(F.col(text))).alias("fingerprint"))


def _half(fp: Column, segment: int) -> Column:
    return F.shiftright(fp, WIDTH * segment).bitwiseAND((1 << WIDTH) - 1)


def _one_bit(value: Column, bit: str) -> Column:
    """``value`` with bit number ``bit`` (a column's name) turned over."""
    return value.bitwiseXOR(F.expr(f"shiftleft(cast(1 as bigint), {bit})"))


def _bits(df: DataFrame, name: str, start: Column | None = None) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0) if start is None else start, F.lit(WIDTH - 1))))


def segment_table(classes: DataFrame) -> DataFrame:
    """``bucket`` (segment number and value), ``fp`` and ``rest`` (the other segment) of each fingerprint and segment."""
    return classes.select("fp", F.explode(F.array(*[
        F.struct((_half(F.col("fp"), s) * SEGMENTS + s).alias("bucket"), _half(F.col("fp"), 1 - s).alias("rest"))
        for s in range(SEGMENTS)])).alias("s")).select("s.bucket", "fp", "s.rest")


def _askers(table: DataFrame) -> DataFrame:
    """The table with each set bit of the segment cleared in turn."""
    value = F.expr(f"bucket div {SEGMENTS}")
    return (_bits(table, "bit").where(F.expr(f"(shiftright(bucket div {SEGMENTS}, bit) & 1) = 1"))
            .select((_one_bit(value, "bit") * SEGMENTS + F.col("bucket") % SEGMENTS).alias("bucket"), "fp", "rest"))


def _hot_links(members: DataFrame, askers: DataFrame) -> DataFrame:
    """Star links through common points of the other segment."""
    none = F.lit(None).cast("long")
    near = [
        members.select("bucket", F.col("rest").alias("point"), "fp", F.col("fp").alias("centre")),
        _bits(members, "i").select("bucket", _one_bit(F.col("rest"), "i").alias("point"), "fp", F.col("fp").alias("centre")),
        _bits(_bits(members, "i").where(f"i < {WIDTH - 1}"), "j", F.col("i") + 1)
        .select("bucket", _one_bit(_one_bit(F.col("rest"), "i"), "j").alias("point"), "fp", none.alias("centre")),
        askers.select("bucket", F.col("rest").alias("point"), "fp", none.alias("centre")),
        _bits(askers, "i").select("bucket", _one_bit(F.col("rest"), "i").alias("point"), "fp", none.alias("centre")),
    ]
    points = near[0]
    for more in near[1:]:
        points = points.unionByName(more)
    met = points.groupBy("bucket", "point").agg(F.min("centre").alias("a"), F.collect_set("fp").alias("fps"))
    return met.where("a is not null and size(fps) > 1").select("a", F.explode("fps").alias("b")).where("a <> b").distinct()


def hamming_links(classes: DataFrame, *, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, each at most RADIUS bits apart.

    The components of the links are those of all pairs at that distance; pairs between members of a segment value
    of more than ``hot`` fingerprints may be left out where others connect them.
    """
    table = materialize(segment_table(classes), "segments")
    hot_buckets = materialize(table.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > hot).select("bucket"), "hot-segments")
    askers = _askers(table)
    plain = table.join(hot_buckets, "bucket", "left_anti").select("bucket", F.col("fp").alias("a"))
    asked = askers.select("bucket", F.col("fp").alias("b"), F.lit(True).alias("off")).unionByName(
        table.select("bucket", F.col("fp").alias("b"), F.lit(False).alias("off")))
    links = (plain.join(asked, "bucket").where("off or a < b")
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b"))
    if not hot_buckets.isEmpty():
        links = links.unionByName(_hot_links(table.join(hot_buckets, "bucket", "left_semi"), askers.join(hot_buckets, "bucket", "left_semi")))
    return links


def simhash_groups(df: DataFrame, key: str, text: str, *, hot: int = HOT) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest key reachable by links) for every row.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; the fingerprint is over shingles of
    SHINGLE words with repeats, or the whole sequence of fewer words. A text that is null, empty or without a word has
    fingerprint zero and is linked like any other. Rows alike stay apart and get one component. A row whose key is null
    takes part; its component is null only if no member has a key. Other columns are not read. ``hot`` bounds
    work for a segment value, not results. The result is a stored table.
    """
    def make() -> DataFrame:
        members = materialize(fingerprints(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text"), "fingerprints")
        classes = materialize(members.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "fingerprint-classes")
        links = materialize(hamming_links(classes.select("fp"), hot=hot), "fingerprint-links")
        roots = components(links).select(F.col("node").alias("fp"), "root")
        placed = materialize(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
        least = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        names = materialize(placed.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id"), "named")
        return members.join(names, "fingerprint").select(
            F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
    return settle(make, "simhash")
