import corpus_pipeline as P
from siftwright.llm.text import count_words


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.count()]
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append(docs.count())
        if name == "near_duplicates":
            groups = P.jaccard_join.near_duplicates(docs, "doc_id", "text")
            assert groups.where("doc_id <> component_id").count() == 0
        if name == "repeated_passages":
            assert seen[-1] == seen[-2]
    assert seen[0] >= seen[1] > seen[2]
    packed = P.STAGES[-1][1](spark, docs, folder).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert (packed["start"] == 0).sum() == seen[-1]
    assert docs.select(count_words(docs["text"]).alias("n")).where("n = 0").count() == 0


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text + " x", "en", "a", 3), (None, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.drop_near_duplicates(spark, docs, "").orderBy("doc_id").collect()] == [None, 1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    """Against a plain grouping: (2, near copy) goes, (2, other text) is a clean document and stays."""
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (2, text + " x"), (2, other), (3, other), (3, "third text of its own here"), (4, ""), (4, ""), (4, None),
            (None, other + " y"), (None, "no id " * 9), (None, "no id " * 9), (5, "fifth text of its own here")]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, "").collect()), key=str)
    want = [(1, text), (2, other), (3, "third text of its own here"), (4, ""), (4, ""), (4, None), (None, "no id " * 9), (5, "fifth text of its own here")]
    assert got == sorted(want, key=str)


def test_passages_of_51_short_words_go(spark):
    """51 words of one and two letters have less than 130 bytes; 50 repeated words stay."""
    passage = " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] + "xy"[: i // 26] for i in range(51))
    shorter = " ".join(f"s{i}" for i in range(50))
    docs = spark.createDataFrame([(i, f"own{i} words{i}\n{passage}\nend{i} {shorter} fin{i}", "en", "a", 0) for i in range(2)] + [(2, None, "en", "a", 0)], SCHEMA)
    got = {r.doc_id: r.text for r in P.drop_repeated_passages(spark, docs, "").collect()}
    assert got == {**{i: f"own{i} words{i}\n\nend{i} {shorter} fin{i}" for i in range(2)}, 2: ""}


def test_no_shared_window_of_51_words_is_left(spark, folder):
    docs = P.materialize(P.drop_near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), "docs")
    from collections import Counter

    def windows(rows):
        return Counter(tuple(w[i : i + 51]) for w in ((r.text or "").encode().split() for r in rows) for i in range(len(w) - 50))
    before = windows(docs.collect())
    repeated = {w for w, n in before.items() if n > 1}
    after = windows(P.drop_repeated_passages(spark, docs, folder).collect())
    assert repeated and not repeated & set(after)
    assert P.drop_repeated_passages(spark, docs.limit(0), folder).count() == 0
