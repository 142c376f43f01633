"""Packing tokenised documents into sequences of fixed length by first-fit decreasing.

Documents become token ids once, in Arrow batches. A document longer than a sequence is cut
into full sequences and one rest; pieces are dealt at random into groups of bounded size, and
each group is packed on its own: pieces in falling length, each into the first sequence with
room, which a tournament tree over the sequences' free room finds in logarithmic time. Only
piece lengths and check sums are shuffled, never ids or texts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize
from .ship import ship

GROUP_PIECES = 20_000
# Documents of a batch that are held as ids at once.
_ENCODE = 64


class TournamentTree:
    """Free room of ``n`` bins; each inner node holds the most room below it."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (max(1, n) - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Index of the first bin with room for ``size``, which is taken from it."""
        most, leaves = self.most, self.leaves
        if most[1] < size:
            raise ValueError("no bin has room")
        at = 1
        while at < leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        found = at - leaves
        at >>= 1
        while at:
            left, right = most[2 * at], most[2 * at + 1]
            now = left if left >= right else right
            if most[at] == now:
                break
            most[at] = now
            at >>= 1
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1 to ``capacity``), taken in falling size, ties in given order."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    full = int((sizes == capacity).sum())
    # these come first and fill a bin each
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    tree = TournamentTree(len(rest), capacity)
    used: dict[int, int] = {}
    for i, size in zip(rest.tolist(), sizes[rest].tolist()):
        b = tree.place(size)
        bins[i], offsets[i] = b + full, used.get(b, 0)
        used[b] = int(offsets[i]) + size
    return bins, offsets


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """A function from text to ids as ``tokenizers`` gives them for the byte-level BPE file ``vocabulary``.

    ``tiktoken`` merges by the same ranks several times faster; texts that hold the string of
    an added token, which only ``tokenizers`` treats as one, are left to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    added = [t["content"] for t in model.get("added_tokens", [])]
    # the file writes bytes as printable characters: the printable ones as themselves, the others in order from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(a in text for a in added):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


# Fixed value: how byte-level BPE parts a text into words.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PIECES = "{id} {type}, row long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenize(df: DataFrame, key: str, text: str, vocabulary: str, *, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece: ``key``, ``row`` (unique per input row), ``start``, ``length``, ``ids_crc32``, ``doc_tokens``.

    A document is its ids and ``end_id``; it is cut every ``capacity`` ids. Null and empty
    texts are ``end_id`` alone.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    whole_numbers = kind in ("bigint", "int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, len(batch), _ENCODE):
                out: list[tuple] = []
                part = batch.iloc[at : at + _ENCODE]
                for k, t in zip(part["k"].tolist(), part["t"].tolist()):
                    ids = np.array([*(encode(t) if t else ()), end_id], "<u4")
                    row += 1
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        out.append((k, row, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                made = pd.DataFrame(out, columns=["k", "row", "start", "length", "ids_crc32", "doc_tokens"])
                if whole_numbers:
                    made["k"] = made["k"].astype("Int64")
                yield made

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, _PIECES.format(id="k", type=kind)).withColumnRenamed("k", key)


def pack(pieces: DataFrame, *, capacity: int, group_pieces: int = GROUP_PIECES, seed: int = 3) -> DataFrame:
    """``pieces`` (with ``row``, ``start``, ``length``) plus ``sequence_id`` and ``offset``.

    Pieces are dealt into groups by a seeded hash of row and start, about ``group_pieces`` to
    each, so a group fits a task however large or skewed the table is. Sequence ids are
    unique, not gapless. Lengths run from 1 to ``capacity``. ``pieces`` is read twice and its
    ``row`` must not change between: give a stored table.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "start"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.drop(columns="pack_group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, schema)


def pack_documents(df: DataFrame, key: str, text: str, vocabulary: str, *, capacity: int = 1024, seed: int = 3) -> DataFrame:
    """All documents tokenised, cut and packed: one row per piece; see :func:`tokenize` and :func:`pack`.

    Rows with equal or null keys are documents of their own. Other columns are not read. An
    empty table gives no rows.
    """
    pieces = materialize(tokenize(df, key, text, vocabulary, capacity=capacity), "pieces")
    return pack(pieces, capacity=capacity, seed=seed)
