from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwright.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4099])
def test_places_are_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.shuffled_place(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))
    if n > 50:
        assert got != sorted(got)
    a, b = sharding.halves(n)
    assert a * b >= n and a * b - n < a


def test_odd_rows(spark, odd, none):
    keys = ["doc_id", "text"]
    rows = sharding.shard_rows(odd, keys, 4).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert sharding.shard_rows(none, keys, 4).count() == 0


def test_rerun_and_layout_do_not_matter(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    a = sharding.shard_rows(df, ["doc_id", "n_chars"], 16)
    b = sharding.shard_rows(df.repartition(7), ["doc_id", "n_chars"], 16)
    assert a.exceptAll(b).count() == 0 and a.count() == df.count()


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    df = spark.range(500).withColumn("k", F.col("id") % 3).select("k")
    rows = sharding.shard_rows(df, ["k"], 7).collect()
    assert len(rows) == 500 and len({(r.shard, r.slot) for r in rows}) == 500
