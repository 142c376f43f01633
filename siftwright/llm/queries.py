"""Queries of this folder over the given tables, each through its operator, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import html_text, jaccard_join, lexical_search, mixing, packing, periodic_runs, quality, sharding, simhash, suffix_dedup, topk, toxicity, url_rules
from .text import count_words, utf8_size, whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(
        table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


# The rules of the URL query.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
_URL_SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path,
       (SELECT rh || rp FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1) AS rule,
       coalesce((SELECT rv FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""


@query("op2_url_rules", _URL_SQL)
def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(pages, "url", rules).select("page_id", "host", "path", "rule", "verdict")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", utf8_size(F.col("text")).alias("bytes"), F.crc32(F.encode(whole(F.col("text")), "UTF-8")).alias("text_crc32"))
    return sharding.shard_rows(docs, ["doc_id", "bytes", "text_crc32"], 16).select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    slim = materialize(table(spark, folder, "documents").select(
        "doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    mixed = mixing.mix(slim, size="size", source="source", key=["doc_id", "text_hash"], pattern=[5, 2, 1])
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "source")


_QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(a) - 6)) AS i, a FROM w WHERE len(a) >= 8),
h AS (SELECT doc_id, i, array_to_string(a[i : i + 7], ' ') AS k FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, sum(least(8, nxt)) AS n FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""


@query("op8_quality_cascade", _QUALITY_SQL)
def op8_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # the contract's five measures are wanted of every text; what further rules need is left to the cascade
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.filter_quality(docs, "text", keep=wanted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, "text", passages=True).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"), F.col("removed").alias("removed_spans"), "n_passage_words")


def held_out(key) -> "F.Column":
    """Rows that no label is learned from; a row without an id is none."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.sample_labelled(
        docs, table(spark, folder, "labels"), "doc_id", "text", "toxic", ~held_out(F.col("_key"))))
    return toxicity.score_toxicity(docs, "text", model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


_TOPK_SQL = """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM g q JOIN g c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op7_exact_topk", _TOPK_SQL)
def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), topk.grid_vector(F.col("embedding")).alias("v"))
    return topk.exact_top_k(vectors.where("id % 50 = 0"), vectors, 5)


@query("op9_html_text")
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages").select("page_id", "html"), "html").select(
        "page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_simhash")
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


_SEARCH_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SEARCH_TERMS} AS a FROM documents),
c AS (SELECT count(*) FILTER (len(a) > 0) AS docs, sum(len(a))::BIGINT AS terms FROM d),
p AS (SELECT r, doc_id, len(a) AS n, unnest(a) AS term FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_SEARCH_TERMS}) AS a FROM benchmark),
q AS (SELECT item, item_id, unnest(a) AS term FROM i),
w AS (SELECT item, item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN f USING (term), c),
s AS (SELECT item, item_id, r, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
      FROM w JOIN t USING (term), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


@query("op12_lexical_search", _SEARCH_SQL)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "benchmark").select("item_id", "text"), "item_id", "text",
                                 table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", 50)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", plant=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(F.col("runs"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
