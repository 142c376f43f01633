import random
from collections import Counter

import numpy as np
import pytest

from siftwright.llm import suffix_dedup


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), kept))
    return out


def result(df, **options):
    rows = suffix_dedup.remove_repeats(df, "text", **options).select("n", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(rows, key=lambda r: r.n)]


@pytest.mark.parametrize("part_pieces", [3, 20_000])
def test_against_brute_force(spark, part_pieces):
    rnd = random.Random(part_pieces)
    base = ["".join(rnd.choice("ab cé") for _ in range(rnd.randint(0, 90))) for _ in range(20)]
    texts = [None, "", "a" * 120, "a" * 120, "a" * 24, "ab" * 40] + [
        rnd.choice(base) + rnd.choice(base)[rnd.randint(0, 20):] + rnd.choice(base)[: rnd.randint(0, 60)] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(5)
    assert result(df, width=24, core=6, part_pieces=part_pieces) == brute(texts, 24)


def test_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("doc_id", "n")
    texts = [r.text for r in df.orderBy("n").collect()]
    assert result(df) == brute(texts, 400)


def test_long_texts_over_several_chunks(spark, monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh") for _ in range(3_000_000))
    texts = [text, text[1_048_000:1_049_500] + "x" * 10, "y" + text[-700:]]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    assert [r[:3] for r in result(df)] == [(3_000_000, 2200, 2), (1510, 1500, 1), (701, 700, 1)]


def test_odd_rows(spark, odd, none):
    rows = suffix_dedup.remove_repeats(odd.withColumnRenamed("score", "kept"), "text", width=8, core=3).collect()
    assert len(rows) == odd.count()
    want = Counter(zip([r.text for r in odd.collect()], brute([r.text for r in odd.collect()], 8)))
    assert Counter((r.text, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rows) == want
    assert suffix_dedup.remove_repeats(none, "text").count() == 0


def test_cut_characters_go(spark):
    a = "é" * 30
    df = spark.createDataFrame([(0, "x" + a), (1, a + "z")], "n long, text string")
    assert [r.kept for r in suffix_dedup.remove_repeats(df, "text", width=21, core=4, decode=True).orderBy("n").collect()] == ["x", "z"]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 200):
        assert suffix_dedup.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def brute_words(texts, width):
    import re

    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    data = [(t or "").encode() for t in texts]
    words = [[d[a:b] for a, b in p] for d, p in zip(data, places)]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for d, p, w in zip(data, places, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept, n, i = d, 0, len(w)
        while i > 0:
            j = i
            while i > 0 and gone[i - 1]:
                i -= 1
            if j > i:
                kept, n = kept[: p[i][0]] + kept[p[j - 1][1] :], n + 1
            i -= 1
        out.append((len(d), len(d) - len(kept), n, kept))
    return out


@pytest.mark.parametrize("part_pieces", [2, 20_000])
def test_words_against_brute_force(spark, part_pieces):
    rnd = random.Random(part_pieces + 1)
    base = [" ".join(rnd.choice("a b cé d".split()) for _ in range(rnd.randint(0, 40))) for _ in range(20)]
    join = lambda *x: rnd.choice([" ", "\n", " \t"]).join(x)
    texts = [None, "", "a " * 60, "a\n" * 60, "a " * 9, "a b " * 12] + [
        join(rnd.choice(base), rnd.choice(base)[rnd.randint(0, 20):], f"u{rnd.randrange(5)}", rnd.choice(base)[: rnd.randint(0, 60)]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(5)
    assert result(df, width=9, core=3, unit="word", part_pieces=part_pieces) == brute_words(texts, 9)


def test_words_of_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("doc_id", "n")
    texts = [r.text for r in df.orderBy("n").collect()]
    assert result(df, width=51, core=13, unit="word") == brute_words(texts, 51)


def test_unknown_unit(none):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(none, "text", unit="line")


def test_passages_of_short_words_beside_the_bytes(spark):
    rnd = random.Random(7)
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    short, under, long = [f"{c}{d}" for c in "abcdef" for d in range(9)][:53], own(50), own(60)
    words = [own(9) + short + own(20), own(3) + short, own(80), under + own(5), own(2) + under, own(4) + long, long + own(40), own(52), None, []]
    few = own(45)  # over 400 bytes and a copy, but without 51 words
    words += [words[7], short[:20] + own(3), few, few]
    texts = [None if w is None else rnd.choice([" ", "\n"]).join(w) for w in words]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(3)
    rows = sorted(suffix_dedup.remove_repeats(df, "text", passages=True).collect(), key=lambda r: r.n)
    assert [r.n_passage_words for r in rows] == [53, 53, 0, 0, 0, 60, 60, 52, 0, 0, 52, 0, 0, 0]
    assert len(" ".join(short)) < 400
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == result(df)


def test_query_counts_words_of_passages(spark, folder):
    import re

    from siftwright.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + 51]) for w in words.values() for i in range(len(w) - 50))
    want = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                gone.update(range(i, i + 51))
        want[k] = len(gone)
    assert {r.doc_id: r.n_passage_words for r in QUERIES["op10_suffix_dedup"](spark, folder).collect()} == want
    assert any(want.values())
