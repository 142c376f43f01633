"""Near duplicates by exact Jaccard similarity of word shingles, found by a parity-sketch join.

Shingles are hashed and XORed into the words of a sketch, one word ("block") per shingle, chosen
by its hash. A shingle that only one of two documents has changes one word, so the number of
differing words never exceeds the symmetric difference. Similar documents of a size band differ
in at most d shingles; a sketch of d + 1 + e words therefore has e + 1 words in common
(pigeonhole). Documents meet by an equi-join on (band, word number, word), and whole texts
verify every candidate.

Hot words, without losing a pair:

* Words of at most one shingle are common to unrelated documents. A document that has at most e
  of them leaves them out: of the e + 1 common words one remains that neither side left out.
* In the same way words that more than ``hot`` documents share are left out where those and the
  former are at most e together. Documents with more belong to large groups of near copies.
* Documents that such words still join are compared by bit sketches, in tiles of bounded size:
  first with one document of the word, then with those of other components so far. Only the
  pairs that grow a component are given out, so a group of m documents gives m - 1 of them and
  unrelated documents none. The components of sketch-similar documents are the clusters: a link
  over a hot word lies inside one. A cluster is verified in tiles as well, and again only links
  between documents not connected yet are given out.
* Words of fewer documents give their pairs, bounded by ``hot`` for each document and word.
* Documents of one shingle set are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize, settle
from .components import components
from .ship import ship
from .text import whole

SHINGLE = 5
HOT = 16
TILE = 512
_RATIO = 1.4
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BATCH_BYTES = 1 << 18
_BATCH_TEXTS = 500


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_SYMBOLS = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOLS_LOWER = np.where(_BLANK, 0, _SYMBOLS[_LOWER]).astype(np.uint64)
_BASE = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z lower-cased, words parted by BLANKS.

    Fewer words than SHINGLE make one shingle of the whole sequence; no word makes none.
    """
    out: list[np.ndarray] = []
    for held in _batches(texts):
        data = np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)
        blank = _BLANK[data]
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        # text boundaries in words
        ends = np.cumsum([len(t) + 1 for t in held])
        bounds = np.searchsorted(starts, np.concatenate(([0], ends)) + 1).tolist()
        if len(starts):
            lengths = np.diff(np.append(starts, len(data)))
            place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64), dtype=np.uint64)
            word = _mix(np.add.reduceat(_SYMBOLS_LOWER[data[starts[0]:]] * powers[place], starts - starts[0], dtype=np.uint64))
            if len(word) >= SHINGLE:
                n = len(word) - SHINGLE + 1
                full = _mix(sum((word[j : j + n] * _C[j] for j in range(1, SHINGLE)), word[:n] * _C[0]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(full[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(_mix((word[a:b] * _C[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _batches(texts: list[str | None]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode()
        if held and size + len(data) > _BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def _set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bands(top: int) -> list[int]:
    """Lower size limits of the bands up to ``top``."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * _RATIO))))
    return out


def bands_of(n: int) -> list[tuple[int, int, int]]:
    """(band, d, e) of every band in which a set of ``n`` can meet a similar one.

    A pair meets in the band of its smaller set of a elements; the larger has at most 5a/4, and
    similar sets of a and b elements differ in at most (a + b) / 9.
    """
    limits = _bands(n)
    out = []
    for band in range(len(limits) - 2, -1, -1):
        most = limits[band + 1] - 1
        if 5 * most < 4 * n:
            break
        d = (most + 5 * most // 4) // 9
        out.append((band, d, d // 4))
    return out


def sketch_words(s: np.ndarray, band: int, d: int, e: int) -> tuple[np.ndarray, int]:
    """Join keys of the set's sketch words in this band and how many hot ones may still be left out (-1: none)."""
    m = d + 1 + e
    block = (s >> np.uint64(20)) % np.uint64(m)
    count = np.bincount(block.astype(np.int64), minlength=m)
    order = np.argsort(block, kind="stable")
    used = np.flatnonzero(count)
    xor = np.zeros(m, np.uint64)
    xor[used] = np.bitwise_xor.reduceat(s[order], (np.cumsum(count) - count)[used])
    keys = _mix(xor ^ _mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40) + np.uint64(1 << 60)))
    lone = int((count <= 1).sum())
    if lone <= e:
        return keys[count > 1], e - lone
    if m - len(used) <= e:
        return keys[count > 0], -1
    return keys, -1


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits, a power of two in number and at least two for each shingle; halves fold by XOR."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Differing parity bits at the smaller of both widths: at most the symmetric difference."""
    if len(a) > len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint64)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, len(x)), axis=0)).sum())


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), _BATCH_TEXTS):
            part = batch.iloc[at : at + _BATCH_TEXTS]
            sets = shingle_sets(part["text"].tolist())
            yield pd.DataFrame({
                "doc_id": part["doc_id"].array, "row_key": part["row_key"].array, "n": [len(s) for s in sets],
                "set_id": pd.array([_set_id(s) if len(s) else None for s in sets], "Int64"),
                "sketch": [bit_sketch(s) if len(s) else None for s in sets],
            })


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sketch words of every distinct set of a task; sets that other tasks have too come again."""
    seen: set[int] = set()
    for batch in batches:
        texts = batch["text"].tolist()
        for at in range(0, len(texts), _BATCH_TEXTS):
            keys, ids, rooms = [], [], []
            for s in shingle_sets(texts[at : at + _BATCH_TEXTS]):
                if not len(s) or (i := _set_id(s)) in seen:
                    continue
                seen.add(i)
                for band, d, e in bands_of(len(s)):
                    k, room = sketch_words(s, band, d, e)
                    keys.append(k)
                    ids.append(np.full(len(k), i, np.int64))
                    rooms.append(np.full(len(k), room, np.int32))
            if keys:
                yield pd.DataFrame({"word": np.concatenate(keys).view(np.int64), "set_id": np.concatenate(ids), "room": np.concatenate(rooms)})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by word, those whose word occurs with another set too, each with the first set of its word.

    A word's rows may run over batches; only its first set is kept meanwhile, so a set that
    several tasks gave may come twice. Counts over these rows are then higher, which keeps more.
    """
    held = None  # the last row of the batch before: word, set, room
    first = None  # the first set of its word
    given = False  # whether it has been given out
    for batch in batches:
        word, ids, room = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        order = np.lexsort((ids, word))
        word, ids, room = word[order], ids[order], room[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (ids[1:] != ids[:-1])
        if held is not None:
            new &= (word != held[0]) | (ids != held[1])
        word, ids, room = word[new], ids[new], room[new]
        if not len(word):
            continue
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sizes = np.diff(np.append(starts, len(word)))
        keep = np.repeat(sizes > 1, sizes)
        pivot = np.repeat(ids[starts], sizes)
        goes_on = held is not None and word[0] == held[0]
        if goes_on:
            keep[: sizes[0]] = True
            pivot[: sizes[0]] = first
        out = [word[keep], ids[keep], pivot[keep], room[keep]]
        if goes_on and not given:
            out = [np.append(x, y) for x, y in zip(out, (held[0], held[1], first, held[2]))]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                names=["word", "set_id", "pivot", "room"])
        held, first, given = (int(word[-1]), int(ids[-1]), int(room[-1])), int(pivot[-1]), bool(keep[-1])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of the sets of each word; a word has at most ``hot`` of them."""
    for batch in batches:
        sets, a, b = batch["sets"].to_numpy(), [], []
        sizes = np.array([len(s) for s in sets])
        # words of equally many sets at once
        for size in np.unique(sizes).tolist():
            x = np.sort(np.stack(sets[sizes == size].tolist()).astype(np.int64), axis=1)
            i, j = np.triu_indices(size, 1)
            a.append(x[:, i].ravel())
            b.append(x[:, j].ravel())
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()


@F.pandas_udf(T.BooleanType())
def _may_be_similar(n_a: pd.Series, n_b: pd.Series, s_a: pd.Series, s_b: pd.Series) -> pd.Series:
    return pd.Series([5 * p >= 4 * q and 5 * q >= 4 * p and 9 * hamming(x, y) <= p + q for p, q, x, y in zip(n_a, n_b, s_a, s_b)], dtype=bool)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), _BATCH_TEXTS):
            part = batch.iloc[at : at + _BATCH_TEXTS]
            left, right = shingle_sets(part["text_a"].tolist()), shingle_sets(part["text_b"].tolist())
            yield part.loc[[len(x) > 0 and similar(x, y) for x, y in zip(left, right)], ["a", "b"]]


class Sketches:
    """Sizes and bit sketches of some sets, ready for one-against-many comparison."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]):
        self.n = sizes
        words = [np.frombuffer(k, np.uint64) for k in sketches]
        self.width = np.array([len(w) for w in words])
        # halves fold by XOR to every narrower width that occurs
        self.folded = {w: np.stack([np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) if len(x) >= w else np.zeros(w, np.uint64) for x in words])
                       for w in np.unique(self.width).tolist()}

    def near(self, i: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``among`` that may be similar to set ``i`` by size and sketch, and their distances."""
        among = among[(5 * self.n[i] >= 4 * self.n[among]) & (5 * self.n[among] >= 4 * self.n[i])]
        common = np.minimum(self.width[among], self.width[i])
        js, away = [], []
        for w in np.unique(common).tolist():
            j = among[common == w]
            d = np.bitwise_count(self.folded[w][j] ^ self.folded[w][i]).sum(axis=1, dtype=np.int64)
            ok = 9 * d <= self.n[j] + self.n[i]
            js.append(j[ok])
            away.append(d[ok])
        return (np.concatenate(js), np.concatenate(away)) if js else (among, among)


def near_edges(ids: np.ndarray, label: np.ndarray, sketches: Sketches, side: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sketch-similar sets that join all labels such pairs join; two different sides: only pairs between them."""
    label = label.copy()
    apart = len(np.unique(side)) > 1
    out = []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        rest = rest[label[rest] != label[i]]
        js, _ = sketches.near(i, rest[side[rest] != side[i]] if apart else rest)
        for j in js[np.unique(label[js], return_index=True)[1]].tolist():
            out.append((int(ids[i]), int(ids[j])))
            label[label == label[j]] = label[i]
    return out


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links among the sets that connect all that links connect; two different sides: only links between them.

    Sketches rule out pairs; the rest are verified from the nearest on, unless connected by then.
    """
    sketches = Sketches(np.array([len(s) for s in sets]), [bit_sketch(s) for s in sets])
    apart = len(np.unique(side)) > 1
    near: list[np.ndarray] = [np.empty((3, 0), np.int32)]
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        js, away = sketches.near(i, rest[side[rest] != side[i]] if apart else rest)
        near.append(np.stack((away, np.full(len(js), i), js)).astype(np.int32))
    away, left, right = np.concatenate(near, axis=1)
    order = np.argsort(away, kind="stable")
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(left[order].tolist(), right[order].tolist()):
        x, y = find(i), find(j)
        if x != y and similar(sets[i], sets[j]):
            root[y] = x
            out.append((int(ids[i]), int(ids[j])))
    return out


def _near_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of the tiles and pairs of tiles in the rows."""
    for batch in batches:
        out: list[tuple[int, int]] = []
        for ids, label, n, sketches, split in zip(*[batch[c] for c in ("ids", "roots", "sizes", "sketches", "split")]):
            side = np.arange(len(ids)) >= split
            out += near_edges(np.asarray(ids, np.int64), np.asarray(label, np.int64), Sketches(np.asarray(n, np.int64), list(sketches)), side)
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _tile_links(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates("set_id")
    links = spanning_links(group["set_id"].to_numpy(), shingle_sets(group["text"].tolist()), group["tile"].to_numpy())
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by size and sketch."""
    return (
        pairs.join(classes.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        .join(classes.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
        .where(_may_be_similar("n_a", "n_b", "s_a", "s_b")).select("a", "b")
    )


def _hot_edges(hot_rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every pair of sketch-similar documents that share a hot word."""
    # a set's two bands may have the same room; their hot words then count together, which only keeps more
    kept = materialize(hot_rows.join(
        hot_rows.groupBy("set_id", "room").agg(F.count(F.lit(1)).alias("hot_words")), ["set_id", "room"]).where("room < hot_words"), "kept-words")
    stars = kept.where("set_id <> pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = materialize(_sketched(stars, classes), "stars")
    roots = components(stars).select(F.col("node").alias("set_id"), "root")
    placed = kept.select("word", "set_id").distinct().join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    open_words = materialize(placed.groupBy("word").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("held")).where("x <> y").select("word", "held"), "open-words")
    # words of many documents in tiles, documents of one component side by side
    placed = placed.join(open_words, "word").join(classes.select("set_id", "n", "sketch"), "set_id")
    big = F.col("held") > TILE
    place = F.row_number().over(Window.partitionBy("word").orderBy("root", "set_id")) - 1
    tiled = placed.where(~big).withColumn("tile", F.lit(0)).unionByName(placed.where(big).withColumn("tile", F.floor(place / TILE).cast("int")))
    tiles = materialize(tiled.groupBy("word", "tile").agg(
        F.collect_list(F.struct("set_id", "root", "n", "sketch")).alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")), "tiles")

    def parts(rows: Column, split: Column) -> list[Column]:
        named = {"ids": "set_id", "roots": "root", "sizes": "n", "sketches": "sketch"}
        return [*[rows.getField(c).alias(k) for k, c in named.items()], split.cast("int").alias("split")]

    own = tiles.where("lo <> hi").select(*parts(F.col("rows"), F.lit(0)))
    x, y = (tiles.select("word", F.col("tile").alias(f"{k}_tile"), F.col("lo").alias(f"{k}_lo"), F.col("hi").alias(f"{k}_hi")) for k in "xy")
    meet = (x.join(y, "word").where("x_tile < y_tile and not (x_lo = x_hi and y_lo = y_hi and x_lo = y_lo)").select("word", "x_tile", "y_tile"))
    across = (
        meet.join(tiles.select("word", F.col("tile").alias("x_tile"), F.col("rows").alias("left")), ["word", "x_tile"])
        .join(tiles.select("word", F.col("tile").alias("y_tile"), F.col("rows").alias("right")), ["word", "y_tile"])
        .select(*parts(F.concat("left", "right"), F.size("left")))
    )
    return materialize(stars.unionByName(own.unionByName(across).mapInPandas(_near_edges, "a long, b long")), "hot-edges")


def _clusters(hot_rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``set_id``, ``cluster`` and the cluster's number of tiles."""
    roots = components(_hot_edges(hot_rows, classes))
    nodes = roots.select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    nodes = materialize(nodes.unionByName(nodes.select(F.col("cluster").alias("set_id"), "cluster").distinct()), "clusters")
    sizes = materialize(nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "cluster-sizes")
    return materialize(nodes.join(sizes, "cluster"), "tiled")


def near_duplicates(df: DataFrame, key: str, text: str, *, hot: int = HOT) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) for every row.

    Linked: 100 * common shingles >= 80 * shingles of either; shingles are SHINGLE words, A-Z
    lower-cased, or the whole sequence of fewer words. Texts that are null, empty or without a
    word have no shingle and no link. Sets are compared by 64-bit shingle hashes and known by
    64-bit digests. Rows alike in all columns stay apart and get one component. A row whose
    key is null takes part; its component is null only if no member has a key. Other columns
    are not read. ``hot`` bounds work for each word, not results. The result is a stored table.
    """
    ship(df.sparkSession)
    return settle(lambda: _near_duplicates(df, key, text, hot).select(
        F.col("doc_id").alias(key), "n_shingles", "component_id"), "near-duplicates")


def row_key(key: Column, text: Column) -> Column:
    """Names a row by key and text together: rows that share a key but not the text have different names."""
    return F.xxhash64(key, whole(text))


def surplus_rows(df: DataFrame, key: str, text: str, *, hot: int = HOT) -> DataFrame:
    """``row_key`` of each row that goes if one row of each group of linked rows stays, and ``times``.

    Of a group the row of smallest key stays, null keys last; among rows of that key it is the one
    of smallest :func:`row_key`. The name of a row that stays comes out only if several rows alike
    in key and text bear it; ``stays`` is true then and one of them has to be kept. Rows without a
    word are linked with nothing and never come out. The result is a stored table.
    """
    ship(df.sparkSession)

    def make() -> DataFrame:
        rows = materialize(_near_duplicates(df, key, text, hot).where("root is not null").groupBy("root", "row_key", "component_id", "doc_id")
                           .agg(F.count(F.lit(1)).alias("times")), "named-rows")
        first = materialize(rows.where("doc_id <=> component_id").groupBy("root").agg(F.min("row_key").alias("first")), "first-rows")
        return rows.join(first, "root").withColumn("stays", F.col("row_key") == F.col("first")).where("not stays or times > 1").select("row_key", "stays", "times")
    return settle(make, "surplus-rows")


def _near_duplicates(df: DataFrame, key: str, text: str, hot: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``row_key`` and ``root`` (null without a word) of every row."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", whole(F.col("text")).alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    kind = df.schema[key].dataType.simpleString()
    members = materialize(rows.mapInPandas(_members, f"doc_id {kind}, row_key long, n long, set_id long, sketch binary"), "members")
    classes = materialize(members.where("set_id is not null").groupBy("set_id").agg(
        F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("row_key").alias("row_key")), "classes")
    words = rows.select("text").mapInPandas(_words, "word long, set_id long, room int")
    shared = materialize(
        words.repartition(F.col("word")).sortWithinPartitions("word").mapInArrow(_shared, "word long, set_id long, pivot long, room int"),
        "shared-words")
    held = materialize(shared.groupBy("word").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > hot).select("word"), "hot-words")
    clusters = _clusters(materialize(shared.join(held, "word", "left_semi").select("word", "set_id", "pivot", "room"), "hot-rows"), classes)
    cold = shared.join(held, "word", "left_anti").groupBy("word").agg(F.collect_set("set_id").alias("sets"))
    pairs = materialize(_sketched(cold.select("sets").mapInPandas(_pairs, "a long, b long").distinct(), classes), "pairs")
    asked = clusters.select("set_id").unionByName(pairs.select(F.col("a").alias("set_id"))).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    picked = classes.join(asked, "set_id", "left_semi").select("set_id", "row_key")
    texts = materialize(rows.join(picked, "row_key").select("set_id", "text"), "texts")
    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    plain = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a long, b long")
    tiled = (
        clusters.withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("set_id", "cluster", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
        .join(texts, "set_id")
        .groupBy("cluster", "x", "y").applyInPandas(_tile_links, "a long, b long")
    )
    links = materialize(plain.unionByName(tiled), "links")
    roots = materialize(components(links).select(F.col("node").alias("set_id"), "root"), "roots")
    placed = members.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = materialize(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return placed.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row_key", "root")
