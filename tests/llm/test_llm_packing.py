import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwright.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_decreasing_is_first_fit(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, room in enumerate(free) if room >= sizes[i]), None)
        if b is None:
            free.append(50)
            b = len(free) - 1
        want[i] = (b, 50 - free[b])
        free[b] -= sizes[i]
    assert [want[i] for i in range(len(sizes))] == list(zip(bins.tolist(), offsets.tolist()))


def test_ids_are_those_of_the_tokenizer():
    encode, slow = packing._encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in ["", "plain words", "a" * 5000, "x <|endoftext|> y", "漢字 ñ 🙂‍ 　 '\tS 12345", "\n\n  \n x"]:
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids


def check(spark, df, capacity):
    rows = packing.pack_documents(df, "doc_id", "text", VOCABULARY, capacity=capacity).toPandas()
    slow = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc_id, text in df.select("doc_id", "text").collect():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, s, len(p := ids[s : s + capacity]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = [tuple(None if v != v else int(v) for v in r) for r in rows[names].astype(object).itertuples(index=False)]
    assert sorted(map(str, got)) == sorted(str(tuple(None if x is None else int(x) for x in w)) for w in want)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= capacity
    return rows


def test_odd_rows(spark, odd, none):
    check(spark, odd, 16)
    assert packing.pack_documents(none, "doc_id", "text", VOCABULARY).count() == 0


def test_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = check(spark, df, 1024)
    assert rows["length"].sum() / (1024 * rows["sequence_id"].nunique()) > 0.9


def test_groups_are_packed_apart(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = packing.materialize(packing.tokenize(df, "doc_id", "text", VOCABULARY, capacity=1024), "pieces")
    packed = packing.pack(pieces, capacity=1024, group_pieces=50).toPandas()
    assert packed["sequence_id"].floordiv(1 << 32).nunique() > 2 and len(packed) == pieces.count()
    with pytest.raises(ValueError):
        packing.TournamentTree(2, 5).place(6)
