import random

import pytest
from pyspark.sql import functions as F

from siftwright.llm import toxicity
from siftwright.llm.queries import QUERIES

BAD = ["grunk", "vlorb", "snarfx"]


def corpus(n, seed):
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        sentences = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 30))]
        bad = rnd.random() < 0.2
        if bad:
            at = rnd.randrange(len(sentences))
            sentences[at] = sentences[at] + " " + rnd.choice(BAD) + rnd.choice(["", "a", "er"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(bad) if rnd.random() > 0.03 else 1 - int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*corpus(800, 1))


def test_held_out_documents(spark, model):
    texts, _ = corpus(400, 2)
    truth = [any(b in t for b in BAD) for t in texts]
    df = spark.createDataFrame(list(zip(range(400), texts)), "n long, text string")
    rows = toxicity.score_toxicity(df, "text", model).orderBy("n").collect()
    assert sum(r.predicted == t for r, t in zip(rows, truth)) >= 392
    # the offending sentence is the one with the word
    for r, t in zip(rows, truth):
        for o in r.offending:
            assert any(b in texts[r.n][o.start : o.end].lower() for b in BAD)


def test_many_clean_sentences_do_not_add_up(model):
    assert model.score(model.sentences("w1 w2 w3. " * 50_000)) < 0.1


def test_odd_rows(spark, odd, none, model):
    rows = toxicity.score_toxicity(odd, "text", model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {round(r.score, 9) for r in rows if not r.text} == {round(model.leak, 9)}
    assert toxicity.score_toxicity(none, "text", model).count() == 0
    assert toxicity.fit([], []).weights == {} and toxicity.fit(["a", None], [0, 0]).weights == {}


def test_places_hold_where_lower_case_is_longer(model):
    text = "İİİ x. grunk here. end"
    assert [text[a:b] for a, b, _ in model.sentences(text)] == [" grunk here"]


def test_sample_is_bounded_and_leaves_out_held_rows(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    texts, _ = toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", F.col("_key") < 100, max_docs=50)
    assert 10 < len(texts) <= 50 and all(int(t[1:]) < 100 for t in texts)


def test_query(spark, folder):
    rows = QUERIES["op5_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
