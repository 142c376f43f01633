"""Removal of everything that lies in a string of ``width`` bytes, or words, which also starts elsewhere.

Whole suffixes of all documents cannot be sorted in one place, so the collection is first dealt
into small parts that provably hold all matches:

1. Every window of ``width`` bytes has an anchor, the least hashed ``core``-byte string in it
   (leftmost on ties). Equal windows have equal anchors at equal places. The windows that share
   one anchor occurrence form a piece of less than ``2 * width`` bytes.
2. Only pieces whose anchor string occurs twice can hold a repeated window. Equal pieces are
   collapsed by digest; what is repeated as a whole needs no further look.
3. The distinct pieces of one anchor string are aligned at it. The column-wise construction of
   the multi-document transform runs over them from the right: each round inserts the next
   symbol of every piece, re-sorts the suffixes stably by it and updates the common prefixes
   with their neighbours. Equal windows start in the same column, so the part of the
   collection's transform that belongs to one column holds all suffixes that must be compared;
   a window is repeated when a neighbour's common prefix reaches ``width``.

A round reads and rewrites three sequences front to back (order, common prefixes, symbols). A
part has a bounded number of pieces, so they are arrays in the task's memory where a
single-machine construction has files. Anchors with more distinct pieces than that (a passage
in very many contexts) are settled exactly by counting digests of their single windows.

The same steps run over words instead of bytes: a symbol is then a word's 64-bit hash, and blanks
between words do not count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, settle
from .ship import ship
from .text import whole

WIDTH = 400
CORE = 100
PART_PIECES = 20_000
#: A passage of over 50 words repeats if 51 words do, however short they are.
PASSAGE_WORDS, PASSAGE_CORE = 51, 13
_CHUNK = 1 << 18
_CUT_ROWS = 4096
_PLACE = np.uint64((1 << 21) - 1)
_PAD = -1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of a symbol by unit.
_SIZE = {"byte": 1, "word": 8}


def symbols_of(text: str, unit: str) -> np.ndarray:
    """The text as an array: bytes as they are, words as hashes."""
    if unit == "byte":
        return np.frombuffer(text.encode(), np.uint8)
    return hash_array(np.array(text.encode().split(), object), categorize=False)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    symbols = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    base = int(rng.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1
    def row(x: int) -> np.ndarray:
        out = np.full(_CHUNK + 1, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)
    return symbols, row(base), row(pow(base, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, in two running minima over blocks."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, bounds: list[tuple[int, int]], width: int, core: int) -> tuple[np.ndarray, ...]:
    """First and last window, anchor place and anchor hash of each run of windows with one anchor.

    ``data`` is at most _CHUNK symbols; ``bounds`` are the (start, end) of the texts in it, and
    windows lie inside one text.
    """
    none = np.empty(0, np.int64)
    n = len(data)
    if n < width:
        return none, none, none, none
    symbols, powers, inverse = _powers()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((symbols[data] if data.dtype == np.uint8 else data) * powers[:n], out=total[1:])
    h = _mix((total[core:] - total[:-core]) * inverse[: n - core + 1])
    least = sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width - core + 1)
    valid = np.zeros(len(least), bool)
    for start, end in bounds:
        valid[start : max(start, end - width + 1)] = True
    same = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    lo = np.flatnonzero(valid & ~np.concatenate(([False], same)))
    hi = np.flatnonzero(valid & ~np.concatenate((same, [False])))
    at = (least[lo] & _PLACE).astype(np.int64)
    return lo, hi, at, h[at].view(np.int64)


def _chunks(texts: list[np.ndarray], width: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (text number, offset, symbols) of at most _CHUNK symbols together; long texts overlap by width - 1."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) < width:
            continue
        for offset in range(0, len(text) - width + 1, _CHUNK - width + 1):
            part = text[offset : offset + _CHUNK]
            if size + len(part) > _CHUNK:
                yield held
                held, size = [], 0
            held.append((i, offset, part))
            size += len(part)
    if held:
        yield held


def _digest(piece: bytes, place: int) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8, salt=place.to_bytes(8, "little")).digest(), "little", signed=True)


def _pieces(rows: DataFrame, width: int, core: int, unit: str, *, digests: bool) -> DataFrame:
    """The pieces of every distinct text of a task; of copies in other tasks there are equal rows."""
    size = _SIZE[unit]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in batches:
            keys: list[bytes] = []
            texts: list[np.ndarray] = []
            for t, text in zip(batch["t"], batch["text"]):
                if t not in seen:
                    seen.add(t)
                    keys.append(t)
                    texts.append(symbols_of(text, unit))
            heads = np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64)
            for held in _chunks(texts, width):
                data = np.concatenate([x[2] for x in held])
                ends = np.cumsum([len(x[2]) for x in held])
                starts = ends - [len(x[2]) for x in held]
                lo, hi, at, anchor = anchor_runs(data, list(zip(starts.tolist(), ends.tolist())), width, core)
                of = np.searchsorted(ends, lo, side="right")
                text_no = np.array([x[0] for x in held])[of]
                shift = np.array([x[1] for x in held])[of] - starts[of]
                where = _mix(heads[text_no] + (lo + shift).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                out = {"anchor": anchor, "spot": where}
                if digests:
                    raw = data.tobytes()
                    out |= {
                        "piece": [_digest(raw[a * size : (b + width) * size], c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), at.tolist())],
                        "t": [keys[i] for i in text_no.tolist()], "lo": lo + shift, "windows": hi - lo + 1, "lead": at - lo,
                    }
                yield pd.DataFrame(out)

    schema = "anchor long, spot long" + (", piece long, t binary, lo long, windows long, lead long" if digests else "")
    return rows.select("t", "text").mapInPandas(run, schema)


def column_rounds(pieces: list[np.ndarray], leads: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Which windows of each piece also occur in another piece, as a boolean matrix (piece, window).

    Pieces are arrays of one signed type, without negative symbols, aligned at ``leads`` and differ from each other. Round by round, from the last
    column to the first, the symbols of one column are inserted: ``order`` lists the pieces by
    their suffix from this column on, ``prefix[i]`` is the common prefix of the i-th suffix
    with the one before it.
    """
    n = len(pieces)
    found = np.zeros((n, int(windows.max(initial=0))), bool)
    if n < 2:
        return found
    left = int(leads.max())
    right = max(len(p) - int(a) for p, a in zip(pieces, leads))
    matrix = np.full((left + right, n), _PAD, pieces[0].dtype)
    for i, (piece, lead) in enumerate(zip(pieces, leads.tolist())):
        matrix[left - lead : left - lead + len(piece), i] = piece
    first = left - leads
    order = np.arange(n)
    prefix = np.zeros(n + 1, np.int32)
    for column in range(left + right - 1, -1, -1):
        symbols = matrix[column][order]
        perm = np.argsort(symbols, kind="stable")
        symbols = symbols[perm]
        # the new neighbours share this symbol and what all suffixes between them shared
        edges = np.empty(2 * (n - 1), np.int64)
        edges[0::2], edges[1::2] = perm[:-1] + 1, perm[1:] + 1
        alike = symbols[1:] == symbols[:-1]
        span = edges.reshape(-1, 2)[alike]
        grown = np.zeros(n + 1, np.int32)
        if len(span):
            grown[1:n][alike] = np.minimum.reduceat(prefix, span.ravel())[0::2] + 1
        order, prefix = order[perm], grown
        offset = column - first
        inside = (offset >= 0) & (offset < windows)
        if column <= left and inside.any():
            long = prefix >= width
            repeated = (long[:-1] | long[1:]) & inside[order]
            hit = order[repeated]
            found[hit, offset[hit]] = True
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _numbered(blobs: list[bytes], unit: str) -> list[np.ndarray]:
    """The symbols as small numbers from 0, alike where the symbols are."""
    if unit == "byte":
        return [np.frombuffer(b, np.uint8).astype(np.int16) for b in blobs]
    arrays = [np.frombuffer(b, np.uint64) for b in blobs]
    numbers = np.unique(np.concatenate(arrays), return_inverse=True)[1].astype(np.int32)
    return np.split(numbers, np.cumsum([len(a) for a in arrays])[:-1])


def _settle(width: int, unit: str):
    """Function for one part: repeated runs of windows of the pieces that are not repeated as a whole."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["anchor", "piece"]).sort_values(["anchor", "piece"], ignore_index=True)
        found = column_rounds(_numbered(group["bytes"].tolist(), unit), group["lead"].to_numpy(), group["windows"].to_numpy(), width)
        out = [
            (a, p, lo, hi)
            for a, p, twice, flags in zip(group["anchor"].tolist(), group["piece"].tolist(), group["twice"].tolist(), found) if not twice
            for lo, hi in _runs(flags)
        ]
        return pd.DataFrame(out, columns=["anchor", "piece", "run_lo", "run_hi"]).astype("int64")
    return run


def _single_windows(width: int, unit: str):
    size = _SIZE[unit]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, piece, twice, windows, data in zip(*[batch[c].tolist() for c in ("anchor", "piece", "twice", "windows", "bytes")]):
                digests = [hashlib.blake2b(data[i * size : (i + width) * size], digest_size=16).digest() for i in range(windows)]
                yield pd.DataFrame({"anchor": anchor, "piece": piece, "twice": twice, "at": range(windows), "digest": digests})
    return run


def _covered(spans: list, size: int) -> list[tuple[int, int]]:
    """Union of [start, end) spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, min(b, size)) for a, b in out]


def _inside(spans: list | None, size: int, width: int) -> list[tuple[int, int]]:
    """Union of the spans of a text of ``size`` symbols; none if no string of ``width`` fits into it."""
    return [] if spans is None or size < width else _covered([(s["start"], s["end"]) for s in spans], size)


def text_key(text: Column) -> Column:
    """First 16 bytes of the SHA-256 digest; texts of equal key are taken as equal."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def repeated_spans(rows: DataFrame, *, width: int = WIDTH, core: int = CORE, unit: str = "byte", part_pieces: int = PART_PIECES) -> DataFrame:
    """``t`` and ``spans`` (array of start, end) for each text of ``rows`` (t, text) that holds repeated strings.

    Spans count symbols (bytes or words) and may overlap. ``rows`` holds every document, copies too; a text that occurs twice is
    repeated as a whole. Its span ends at its number of bytes also where words are counted, so spans are to be read by :func:`_inside`.
    """
    # the bytes of a text are a cheap bound of its words; texts of enough bytes with too few words give no piece
    length = F.octet_length("text").cast("long")
    long = rows.where(F.octet_length("text") >= (width if unit == "byte" else 2 * width - 1))
    # small tables that are joined by anchor are stored first: a join right above an aggregation cannot be split on a hot anchor
    twice_anchor = materialize(
        _pieces(long, width, core, unit, digests=False)
        .groupBy("anchor").agg(F.min("spot").alias("a"), F.max("spot").alias("b")).where("a <> b").select("anchor"), "anchors")
    found = materialize(_pieces(long, width, core, unit, digests=True).join(twice_anchor, "anchor", "left_semi"), "pieces")
    distinct = found.groupBy("anchor", "piece").agg(
        (F.min("spot") != F.max("spot")).alias("twice"), F.min(F.struct("t", "lo")).alias("rep"),
        F.min("windows").alias("windows"), F.min("lead").alias("lead"))
    distinct = materialize(distinct.select("anchor", "piece", "twice", "rep.t", "rep.lo", "windows", "lead"), "distinct-pieces")
    # a lone piece has nothing to be compared with; among pieces repeated as a whole nothing is open
    mixed = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("twice").alias("settled"))
                        .where("n > 1 and not settled").select("anchor", "n"), "open-anchors")
    asked = (distinct.join(mixed, "anchor").groupBy("t")
             .agg(F.collect_list(F.struct("anchor", "piece", "twice", "lo", "windows", "lead", "n")).alias("asked")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        columns = ["anchor", "piece", "twice", "windows", "lead", "n", "bytes"]
        out: list[tuple] = []
        for batch in batches:
            for t, text, asked_of in zip(batch["t"], batch["text"], batch["asked"]):
                if t in seen:
                    continue
                seen.add(t)
                data = symbols_of(text, unit)
                for x in asked_of:
                    piece = data[x["lo"] : x["lo"] + x["windows"] + width - 1].tobytes()
                    out.append((x["anchor"], x["piece"], x["twice"], x["windows"], x["lead"], x["n"], piece))
                    if len(out) == _CUT_ROWS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    cut_schema = "anchor long, piece long, twice boolean, windows long, lead long, n long, bytes binary"
    pieces = materialize(long.join(asked, "t").select("t", "text", "asked").mapInPandas(cut, cut_schema), "piece-bytes")
    parts = max(1, -(-pieces.count() // part_pieces) * 2)
    run_schema = "anchor long, piece long, run_lo long, run_hi long"
    runs = (pieces.where(F.col("n") <= part_pieces).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)))
            .groupBy("part").applyInPandas(_settle(width, unit), run_schema))
    single = (pieces.where(F.col("n") > part_pieces).select("anchor", "piece", "twice", "windows", "bytes")
              .mapInPandas(_single_windows(width, unit), "anchor long, piece long, twice boolean, at long, digest binary"))
    again = (single.groupBy("digest").agg(F.min("piece").alias("a"), F.max("piece").alias("b"), F.max("twice").alias("c"))
             .where("a <> b or c").select("digest"))
    runs = runs.unionByName(
        single.where("not twice").join(again, "digest", "left_semi")
        .select("anchor", "piece", F.col("at").alias("run_lo"), (F.col("at") + 1).alias("run_hi")))
    runs = runs.unionByName(distinct.where("twice").select("anchor", "piece", F.lit(0).cast("long").alias("run_lo"), F.col("windows").alias("run_hi")))
    spans = (
        found.select("anchor", "piece", "t", "lo").join(runs, ["anchor", "piece"])
        .select("t", (F.col("lo") + F.col("run_lo")).alias("start"), (F.col("lo") + F.col("run_hi") + (width - 1)).alias("end"))
        .unionByName(long.select("t", length.alias("end")).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"))
                     .where("n > 1").select("t", F.lit(0).cast("long").alias("start"), F.col("end").cast("long")))
    )
    return spans.groupBy("t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(df: DataFrame, text: str, *, width: int = WIDTH, core: int = CORE, unit: str = "byte", part_pieces: int = PART_PIECES,
                   decode: bool = False, passages: bool = False) -> DataFrame:
    """``df`` with ``kept`` (binary; with ``decode`` a string without the halves of characters at the cuts), ``n_bytes``, ``n_removed``, ``n_spans`` and ``removed`` (array of start, end).

    Every byte is removed that lies in a string of ``width`` bytes that also starts anywhere
    else in the table, in the same text too; overlapping starts count. Null texts count as
    empty. Rows of equal text are documents of their own, so both lose everything from
    ``width`` bytes on. With ``unit`` "word" the same is said of strings of ``width`` words (runs of
    other characters than ASCII white space): they go from the first byte of a run of such words to
    its last, whatever blanks are in it. ``passages`` adds ``n_passage_words``, the words that lie in a string of
    PASSAGE_WORDS words which also starts elsewhere; they are counted on the input, whatever ``unit`` is, and not removed for it.
    Columns of ``df`` named like results are replaced; no row is lost.
    """
    if unit not in _SIZE:
        raise ValueError(f"unit {unit!r}: byte or word")
    ship(df.sparkSession)
    made = ["kept", "n_bytes", "n_removed", "n_spans", "removed"] + ["n_passage_words"] * passages
    rest = [c for c in df.columns if c not in made]
    rows = df.select(*rest, whole(F.col(text)).alias("_text")).withColumn("_t", text_key(F.col("_text")))
    texts = rows.select(F.col("_t").alias("t"), F.col("_text").alias("text"))

    def spans() -> DataFrame:
        return repeated_spans(texts, width=width, core=core, unit=unit, part_pieces=part_pieces)

    def with_passages() -> DataFrame:
        words = settle(lambda: repeated_spans(texts, width=PASSAGE_WORDS, core=PASSAGE_CORE, unit="word", part_pieces=part_pieces), "passages")
        return settle(spans, "removed").join(words.withColumnRenamed("spans", "passages"), "t", "full")

    found = settle(with_passages, "spans") if passages else settle(spans, "spans").withColumn("passages", F.lit(None).cast("array<struct<start:long,end:long>>"))
    joined = rows.join(found, F.col("_t") == F.col("t"), "left")
    schema = f"kept {'string' if decode else 'binary'}, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>"

    @F.pandas_udf(schema + ", n_passage_words long" * passages)
    def keep(texts: pd.Series, spans_of: pd.Series, words_of: pd.Series) -> pd.DataFrame:
        out = []
        for text_, spans_, words_ in zip(texts, spans_of, words_of):
            data = text_.encode()
            cuts = []
            if spans_ is not None:
                if unit == "word":
                    places = [m.span() for m in _WORD.finditer(data)]
                    cuts = [(places[a][0], places[b - 1][1]) for a, b in _inside(spans_, len(places), width)]
                else:
                    cuts = _inside(spans_, len(data), width)
            parts, at = [], 0
            for a, b in cuts:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            left = b"".join(parts)
            row = (left.decode("utf-8", "ignore") if decode else left, len(data), len(data) - len(left), len(cuts), [{"start": a, "end": b} for a, b in cuts])
            if passages:
                n_words = 0 if words_ is None else len(data.split())
                row += (sum(b - a for a, b in _inside(words_, n_words, PASSAGE_WORDS)),)
            out.append(row)
        return pd.DataFrame(out, columns=made)

    return joined.select(*rest, keep("_text", "spans", "passages").alias("_r")).select(*rest, *[F.col(f"_r.{c}").alias(c) for c in made])
