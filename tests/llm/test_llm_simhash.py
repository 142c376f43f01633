import random
import re
from collections import Counter

import pytest
import xxhash

from siftwright.llm import simhash as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = grouped(fps)
    least = {}
    for r, (k, _) in zip(root, rows):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return Counter((k, f"{f:016x}", least.get(r)) for (k, _), f, r in zip(rows, fps, root))


def result(df, **options):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_groups(df, "doc_id", "text", **options).collect())


def test_documents(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert result(df) == brute([tuple(r) for r in df.collect()])


def test_query(spark, folder):
    from siftwright.llm.queries import QUERIES

    df = QUERIES["op11_simhash"](spark, folder)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert df.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_odd_rows(spark, odd, none):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert S.simhash_groups(none, "doc_id", "text").count() == 0


def test_spark_hashes_alike(spark):
    text = "ä b c"
    h = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) AS h").first().h
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_blocks_of_shingles_add_up(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(S, "_CHUNK", 256)
    assert S.fingerprint(text) % (1 << 64) == want


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_links_keep_the_components_of_all_pairs(spark, hot):
    """Chains and balls around shared halves, all pairs at distance 3 or less by hand."""
    rnd = random.Random(hot)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(40):
        base = rnd.getrandbits(64)
        if rnd.random() < 0.5:
            base = base & ~0xFFFFFFFF | 0x12345678
        for _ in range(rnd.randint(1, 8)):
            x = base
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.choice([rnd.randrange(64), rnd.randrange(32), 32 + rnd.randrange(32)])
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = S.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot=hot).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links)
    at = {x: i for i, x in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in links:
        x, y = find(at[r.a]), find(at[r.b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == grouped(fps)
