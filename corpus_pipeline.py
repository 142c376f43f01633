"""Documents to packed training sequences in five stages, each one operator over all rows the stage before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from siftwright.llm.queries import held_out
from siftwright.llm.text import count_words, words
from siftwright.sources.scratch import materialize


def _carried(docs: DataFrame) -> DataFrame:
    """``text`` and all other columns as ``_row``, so that no operator's result can take the name of one."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def _restored(docs: DataFrame, **changed: Column) -> list[Column]:
    return [changed.get(c, F.col("text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of toxicity score 0.7 or more; learned from the labels of documents still there."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(*toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", ~held_out(F.col("_key"))))
    return toxicity.score_toxicity(_carried(docs), "text", model).where("predicted = 0").select(*_restored(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of smallest id, rows without an id last.

    Decided row by row, so rows that share an id but not the text are documents of their own.
    """
    gone = jaccard_join.surplus_rows(docs, "doc_id", "text")
    named = docs.withColumn("_row_key", jaccard_join.row_key(F.col("doc_id"), F.col("text")))
    kept = named.join(gone.where("not stays").select(F.col("row_key").alias("_row_key")), "_row_key", "left_anti")
    again = gone.where("stays").select(F.col("row_key").alias("_row_key"))
    if not again.isEmpty():  # rows alike in id and text
        kept = kept.join(again, "_row_key", "left_anti").unionByName(kept.join(again, "_row_key", "left_semi").dropDuplicates(["_row_key"]))
    return kept.select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE_WORDS words and more that occur elsewhere too, in the same text or in another."""
    cleaned = suffix_dedup.remove_repeats(_carried(docs), "text", width=suffix_dedup.PASSAGE_WORDS, core=suffix_dedup.PASSAGE_CORE, unit="word", decode=True)
    return cleaned.select(*_restored(docs, text=F.col("kept"), n_chars=F.length("kept").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of a document that the mix takes words of, the last one shortened where the source's target cuts it."""
    slim = materialize(_carried(docs).select("text", "_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"),
                                             count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-input")
    mixed = mixing.mix(slim, size="size", source="source", key=["doc_id", "text_hash"], pattern=[5, 2, 1])
    times = F.col("whole").cast("int") + (F.col("part") > 0).cast("int")
    copies = mixed.where((times > 0) & (F.col("size") > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    cut = (F.col("copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text).cast("long")).otherwise(F.col("_row.n_chars"))
    return copies.select(*_restored(docs, **changed))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place in it."""
    import public_tokenizers

    packed = packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Trained scores, similarity components and tokenisers have no SQL form; tests hold toxic decisions and a planted passage against plain Python,
# the other stages against counts and invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
