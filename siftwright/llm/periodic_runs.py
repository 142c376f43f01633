"""Maximal periodic runs of the words of each text, found by block convolution.

A run of period q and length n is a stretch of n - q >= q places at which the word equals the one
q places on. At scale B the words are cut into aligned blocks of B; each stretch of at least
2 * B - 1 places holds a whole block. So at scale B, for the distances from 2 * B to 4 * B - 1, it
is enough to know where each block occurs again in the window that these distances reach:

* words become small integers x, so small that B squared differences add up to less than the
  prime; then sum((x[i] - x[i + q])**2) is zero modulo the prime just where it is zero, and
* sum(x[i] * x[i + q]) of a block at all distances at once is one product of number-theoretic
  transforms. Transforms of 4 * B points are products with matrices of at most RADIX rows and
  twiddle factors between them; in double precision each sum stays below 2**53, so it is exact.
  The window's transform is put together from those of its three blocks.

Zero mismatch at neighbouring blocks and one distance is one seed; the words themselves are
compared from it to the first difference on either side, less than one block away. Shorter
periods come first, so a stretch inside a run of a period that divides its distance is skipped.

Texts are joined per task up to GROUP words, the longest first, so that a scale reads just the
texts that are long enough for it. A text is worked on by one task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .text import whole

# 7 * 2**20 + 1 has roots of unity of every order 2**k up to 2**20; 3 generates them all.
PRIME = 7 * (1 << 20) + 1
GENERATOR = 3
RADIX = 64
#: Blocks do not get longer; windows of longer distances are taken in pieces.
MAX_BLOCK = 1 << 18
MIN_LENGTH = 12
GROUP = 1 << 16
_SLICE = 1 << 16


def _powers(root: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * pow(root, have, PRIME) % PRIME
        have += more
    return out


def _residues(x: np.ndarray) -> np.ndarray:
    """``x`` (exact integers below 2**53) modulo the prime, in place; a multiple may come out as the prime itself."""
    whole_part = x * (1.0 / PRIME)
    np.floor(whole_part, out=whole_part)
    whole_part *= PRIME
    x -= whole_part
    return x


class Transform:
    """Number-theoretic transform of ``n`` points of each row; ``order`` is the frequency at each place of the result."""

    def __init__(self, n: int):
        self.n = n
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        back = pow(root, -1, PRIME)
        self.inner = None
        first = n
        if n > RADIX:
            bits = n.bit_length() - 1
            steps = -(-bits // (RADIX.bit_length() - 1))
            first = 1 << -(-bits // steps)
            self.inner = transform(n // first)
            turns = np.outer(np.arange(first), np.arange(n // first)) % n
            self.turn = _powers(root, n)[turns].astype(np.float64)
            self.unturn = _powers(back, n)[turns].astype(np.float64)
        self.first = first
        corners = np.outer(np.arange(first), np.arange(first)) % first
        self.matrix = _powers(pow(root, n // first, PRIME), first)[corners].astype(np.float64)
        self.inverse = (_powers(pow(back, n // first, PRIME), first)[corners] * pow(first, -1, PRIME) % PRIME).astype(np.float64)
        self.order = np.arange(n) if self.inner is None else (np.arange(first)[:, None] + first * self.inner.order[None, :]).ravel()
        place = np.argsort(self.order)
        self.opposite = place[-self.order % n]
        quarter = _powers(pow(root, n // 4, PRIME), 4)
        self.shift_one = quarter[self.order % 4].astype(np.float64)
        self.shift_two = (1 - 2 * (self.order % 2)).astype(np.float64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Rows of at most ``n`` values; the rest are zeros."""
        rows, width = x.shape
        if self.inner is None:
            return _residues(x @ self.matrix[:width])
        full = np.zeros((rows, self.first, self.n // self.first))
        full.reshape(rows, self.n)[:, :width] = x
        full = _residues(np.matmul(self.matrix, full))
        full *= self.turn
        return self.inner.forward(_residues(full).reshape(rows * self.first, -1)).reshape(rows, self.n)

    def backward(self, x: np.ndarray, wanted: int) -> np.ndarray:
        """The first ``wanted`` values of each row."""
        if self.inner is None:
            return _residues(x @ self.inverse[:, :wanted])
        rows, rest = len(x), self.n // self.first
        full = self.inner.backward(x.reshape(rows * self.first, rest), rest).reshape(rows, self.first, rest)
        full *= self.unturn
        return _residues(np.matmul(self.inverse, _residues(full))).reshape(rows, self.n)[:, :wanted]


@lru_cache(maxsize=32)
def transform(n: int) -> Transform:
    return Transform(n)


def block_matches(ids: np.ndarray, block: int, ahead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of blocks and distances, from ``ahead`` to ``ahead + 2`` blocks, at which the codes of a whole block occur again."""
    highest = int(((PRIME - 1) // block) ** 0.5)
    blocks = -(-len(ids) // block)
    codes = np.zeros((blocks + ahead + 3) * block)
    codes[: len(ids)] = ids % (highest + 1)
    rows = codes.reshape(-1, block)
    t = transform(4 * block)
    squares = np.concatenate(([0.0], np.cumsum(codes * codes)))
    windows = squares[block:] - squares[:-block]
    own = windows[::block]
    step = max(1, _SLICE // (4 * block))
    for at in range(0, blocks, step):
        to = min(blocks, at + step)
        if ahead <= 2:
            spectra = t.forward(rows[at : to + ahead + 2])
            here, there = spectra[: to - at], spectra[ahead:]
        else:
            here, there = t.forward(rows[at:to]), t.forward(rows[at + ahead : to + ahead + 2])
        n = to - at
        window = there[1 : n + 1] * t.shift_one
        window += there[:n]
        window += there[2 : n + 2] * t.shift_two
        window = _residues(window)
        window *= here[:, t.opposite]
        differ = t.backward(_residues(window), 2 * block)
        differ *= -2
        differ += windows[(at + ahead) * block : (to + ahead + 1) * block].reshape(-1, block)[np.arange(n)[:, None] + [0, 1]].reshape(n, 2 * block)
        differ += own[at:to, None]
        differ = _residues(differ)
        b, d = np.nonzero((differ == 0) | (differ == PRIME))
        yield (b + at) * block, d + ahead * block


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block length, distance in blocks and least text length of each step, by growing distance."""
    yield 2, 0, MIN_LENGTH
    yield 2, 2, MIN_LENGTH
    block = 4
    while 4 * block <= longest:
        if block <= MAX_BLOCK:
            yield block, 2, max(MIN_LENGTH, 4 * block)
        else:
            for ahead in range(2 * block // MAX_BLOCK, 4 * block // MAX_BLOCK, 2):
                yield MAX_BLOCK, ahead, max(4 * block, 2 * ahead * MAX_BLOCK)
        block *= 2


def _stretches(equal: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    yield from zip(edge[0::2].tolist(), edge[1::2].tolist())


def periodic_runs(texts: list[np.ndarray], *, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each sequence of ids, by start and period.

    A run is a maximal stretch of least period q and of length >= max(min_length, 2 * q);
    ``min_length`` is MIN_LENGTH at least.
    """
    by_size = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    found: list[dict[tuple[int, int, int], None]] = [{} for _ in texts]
    sizes = np.array([len(texts[i]) for i in by_size], np.int64)
    if not len(sizes) or sizes[0] < min_length:
        return [[] for _ in texts]
    ends = np.cumsum(sizes)
    ids = np.concatenate([texts[i] for i in by_size])
    for block, ahead, least in _scales(int(sizes[0])):
        some = int(np.searchsorted(-sizes, -least, side="right"))
        if not some:
            continue
        places, distances = [], []
        part = ids[: ends[some - 1]]
        for a, q in block_matches(part, block, ahead):
            inside = a < len(part)
            a, q = a[inside], q[inside]
            end = ends[np.searchsorted(ends, a, side="right")]
            good = (q > 0) & (a + q + block <= end)
            places.append(a[good])
            distances.append(q[good])
        a, q = np.concatenate(places), np.concatenate(distances)
        by = np.lexsort((a, q))
        a, q = a[by], q[by]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (a[1:] != a[:-1] + block)))[: len(a)]
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(a)]))[: len(first)] - 1
        # blocks of two texts can be neighbours only if their distance crosses the border, which is ruled out above
        text_no = np.searchsorted(ends, a[first], side="right")
        for x, y, d, k in zip(a[first].tolist(), (a[last] + block).tolist(), q[first].tolist(), text_no.tolist()):
            end = int(ends[k])
            start = end - int(sizes[k])
            runs = found[by_size[k]]
            if any(d % p == 0 and s <= x - start and y + d - start <= s + n for s, n, p in runs):
                continue
            lo, hi = max(start, x - block), min(end - d, y + block)
            for i, j in _stretches(ids[lo:hi] == ids[lo + d : hi + d]):
                s, n = lo + i - start, j - i + d
                if n >= max(min_length, 2 * d) and not any(d % p == 0 and p < d and u <= s and s + n <= u + m for u, m, p in runs):
                    runs[(s, n, d)] = None
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def planted_order(key: object, n: int) -> np.ndarray | None:
    """Places of the words after a tenth of the texts has been made periodic from a place on; None where nothing changes."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = longest or (None, None, None)
    kept = words
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    text = b" ".join(kept)
    return len(runs), start, length, period, None if period is None else 1000 * length // period, listed, text


def find_runs(df: DataFrame, key: str, text: str, *, plant: bool = False) -> DataFrame:
    """``key``, ``n_runs``, the longest run, all ``runs`` as lines and the text without repeats of periods, one row for each row.

    Words are the maximal runs of other characters than ASCII white space, compared exactly. A run
    is a stretch of least period q and length >= max(12, 2 * q) that no neighbour extends. The
    longest one (ties: smallest start, then period) is in ``start``, ``length``, ``period`` and
    ``exponent_milli``; they are null where there is none. ``collapsed`` drops every word that
    lies in a run after the run's first period and joins the others by a blank. A null text has
    no word; rows that are alike are described alike; other columns are not read. With ``plant``
    the words of a tenth of the texts, chosen by ``key``, are made periodic first.
    """
    ship(df.sparkSession)

    def described(keys: list, texts: list[list[bytes]]) -> pd.DataFrame:
        table: dict[bytes, int] = defaultdict(count().__next__)
        ids = []
        for i, (k, words) in enumerate(zip(keys, texts)):
            numbers = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
            order = planted_order(k, len(words)) if plant else None
            if order is not None:
                numbers = numbers[order]
                texts[i] = [words[j] for j in order.tolist()]
            ids.append(numbers)
        rows = [(k, *_describe(words, runs)) for k, words, runs in zip(keys, texts, periodic_runs(ids))]
        out = pd.DataFrame(rows, columns=["k", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])
        out["collapsed"] = [x.decode() for x in out["collapsed"]]
        return out.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: list = []
            texts: list[list[bytes]] = []
            held = 0
            for k, t in zip(batch["k"].astype(object), batch["t"]):
                keys.append(None if pd.isna(k) else int(k) if isinstance(k, float) else k)
                texts.append(t.encode().split())
                held += len(texts[-1])
                if held >= GROUP:
                    yield described(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield described(keys, texts)

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), whole(F.col(text)).alias("t")).mapInPandas(
        run, f"k {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string")
    return out.withColumnRenamed("k", key)
