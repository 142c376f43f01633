"""Columns of the documents that bear the names of results come through the stages as they were."""

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

NAMES = ["score", "predicted", "offending", "kept", "n_bytes", "n_removed", "n_spans", "removed", "size", "text_hash", "source_size",
         "target", "whole", "part", "copy", "license"]


def _own(docs):
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def _held(rows):
    return all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES)


def test_toxicity_keeps_columns_and_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = P.drop_toxic(spark, _own(docs), folder)
    rows = out.collect()
    assert out.columns == [*docs.columns, *NAMES] and rows and _held(rows)
    model = P.toxicity.fit(*P.toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", ~P.held_out(F.col("_key"))))
    plain = [d.doc_id for d in docs.collect() if not d.text or model.score(model.sentences(d.text, {})) < 0.7]
    assert Counter(r.doc_id for r in rows) == Counter(plain)


def test_passages_and_mix_keep_columns(spark):
    passage = " ".join(f"p{i}" for i in range(150))
    texts = [f"a{i} start {passage if i < 2 else 'plain'} end{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    cut = P.drop_repeated_passages(spark, _own(docs), "").orderBy("doc_id").collect()
    # the word before the passage is alike in both texts; blanks beside the words stay
    assert [r.text for r in cut] == [t.replace(f"start {passage}", "") for t in texts]
    assert [r.n_chars for r in cut] == [len(r.text) for r in cut] and _held(cut)
    out = P.mix_sources(spark, _own(docs), "")
    rows = out.collect()
    plain = P.mix_sources(spark, docs, "").collect()
    assert out.columns == [*docs.columns, *NAMES] and rows and _held(rows)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in rows) == Counter((r.doc_id, r.text, r.n_chars) for r in plain)
    assert all(r.text == texts[r.doc_id] or texts[r.doc_id].startswith(r.text + " ") for r in rows)
