import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwright.llm import jaccard_join as J
from siftwright.llm.components import components


def sets_of(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, len(sets[i]), (least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def result(df, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df, "doc_id", "text", **options).collect())


def test_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert result(df) == brute([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("hot", [2, 16])
def test_clusters_borderline_pairs_and_hot_words(spark, hot):
    rnd = random.Random(hot)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for c in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([4, 5, 6, 9, 30, 60, 200]))]
        for _ in range(rnd.randint(1, 14)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10_000)}"
            if rnd.random() < 0.3:
                words = words + passage
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(df, hot=hot) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd) == brute(rows)
    assert J.near_duplicates(none, "doc_id", "text").count() == 0


def test_shingles_are_those_of_the_words():
    texts = ["", None, "a", "A b\x0bc\tD", "a b c d e f a b c d e", "x " * 50, "é É ß  two  three\nfour five"]
    for got, want in zip(J.shingle_sets(texts), sets_of(texts)):
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()


@settings(deadline=None, max_examples=150)
@given(st.integers(1, 400), st.data())
def test_similar_sets_meet_and_bounds_hold(n, data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    drop = data.draw(st.integers(0, n // 5))
    add = data.draw(st.integers(0, n // 5))
    b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
    a = np.unique(a)
    if not len(b):
        return
    differ = len(np.setxor1d(a, b))
    assert J.hamming(J.bit_sketch(a), J.bit_sketch(b)) <= differ
    if J.similar(a, b):
        words = [{(band, k) for band, d, e in J.bands_of(len(s)) for k in J.sketch_words(s, band, d, e)[0].tolist()} for s in (a, b)]
        assert words[0] & words[1]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
