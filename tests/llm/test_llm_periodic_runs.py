import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwright.llm import periodic_runs as R


def runs_of(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            part = w[i : i + n]
            if j > i and n >= max(12, 2 * q) and not any(all(part[x] == part[x + p] for x in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(key, words):
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def plain(key, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = planted(key, words) if plant else words
    runs = runs_of(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha(lines), sha(kept))


def some_words(rnd):
    k, n = rnd.choice([1, 2, 2, 3, 5, 50, 1000]), rnd.choice([0, 1, 11, 12, 13, 30, 100, 300, 700])
    w = [rnd.randrange(k) for _ in range(n)]
    if rnd.random() < 0.5 and n > 20:
        p = rnd.randint(1, n // 2)
        a = rnd.randrange(n - p)
        for i in range(a + p, rnd.randint(a, n)):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("longest_block", [8, R.MAX_BLOCK])
def test_runs_against_all_periods(monkeypatch, longest_block):
    monkeypatch.setattr(R, "MAX_BLOCK", longest_block)
    rnd = random.Random(longest_block)
    for _ in range(5):
        texts = [some_words(rnd) for _ in range(40)]
        assert R.periodic_runs([np.array(t, np.int64) for t in texts]) == [runs_of(t) for t in texts]


@pytest.mark.parametrize("n", [8, 64, 128, 4096, 1 << 13])
def test_transform_is_exact(n):
    rng = np.random.default_rng(n)
    t, x = R.transform(n), rng.integers(0, R.PRIME, (2, n)).astype(np.float64)
    spectrum = t.forward(x.copy())
    for k in rng.integers(0, n, 5).tolist():
        w = pow(R.GENERATOR, (R.PRIME - 1) // n * int(t.order[k]), R.PRIME)
        want, power = 0, 1
        for v in x[0].astype(int).tolist():
            want, power = (want + v * power) % R.PRIME, power * w % R.PRIME
        assert int(spectrum[0, k]) % R.PRIME == want
    assert (t.backward(spectrum, n) % R.PRIME == x % R.PRIME).all()


def test_matches_of_blocks_are_those_of_the_codes():
    rng = np.random.default_rng(4)
    for block in (2, 4, 32, 256):
        ids = rng.integers(0, 2 if block < 32 else 1, 6 * block + 3)
        ids[rng.integers(0, len(ids), 2)] = 5
        for ahead in (0, 2, 4):
            got = {(int(a), int(q)) for x, y in R.block_matches(ids, block, ahead) for a, q in zip(x, y)}
            for a in range(0, len(ids), block):
                for q in range(ahead * block, (ahead + 2) * block):
                    if a + q + block <= len(ids):
                        assert ((a, q) in got) == bool((ids[a : a + block] == ids[a + q : a + q + block]).all())


def rows_of(df):
    from pyspark.sql import functions as F

    return Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.a, r.b) for r in df.select(
        "*", F.sha2(F.col("runs"), 256).alias("a"), F.sha2(F.col("collapsed"), 256).alias("b")).collect())


def test_query(spark, folder):
    from siftwright.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect())
    short = [r for r in docs if len((r.text or "").split()) <= 1500]
    assert sum(got.values()) == len(docs) and len(short) > 100
    assert not Counter(plain(r.doc_id, r.text) for r in short) - got


def test_odd_rows(spark, odd, none):
    want = [(r.doc_id, r.text) for r in odd.collect()]
    for plant in (False, True):
        assert rows_of(R.find_runs(odd, "doc_id", "text", plant=plant)) == Counter(plain(k, t, plant) for k, t in want)
    assert R.find_runs(none, "doc_id", "text").count() == 0


def test_long_text_of_one_word_and_text_keys(spark):
    df = spark.createDataFrame([("k", "w " * 30_000, 1), ("l", "a b " * 20, 2)], "doc_id string, text string, n_runs int")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.collapsed) for r in R.find_runs(df, "doc_id", "text").collect()}
    assert got == {"k": (1, 0, 30_000, 1, "w"), "l": (1, 0, 40, 2, "a b")}
