"""Profiles of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators import profile as P
from ..sources.tables import Tables
from .registry import query, rounded


@query("table_shape", sql="""
WITH v AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL),
     full_rows AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM lineitem))
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns,
       CAST(sum(c) - (SELECT d FROM full_rows) AS BIGINT) AS duplicate_rows,
       CAST(sum(c) - count(*) AS BIGINT) AS surplus_key_rows, count(*) AS distinct_keys
FROM v
""")
def table_shape(t: Tables) -> DataFrame:
    return P.table_shape(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("table_shape_texts", sql="""
SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS duplicate_rows,
       count(*) - count(DISTINCT text) AS surplus_key_rows, count(DISTINCT text) AS distinct_keys
FROM documents
""")
def table_shape_texts(t: Tables) -> DataFrame:
    return P.table_shape(t("documents").withColumn("text", I.text_digest("text")), ["text"])


_PROFILED = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


def _profile_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{d}' AS dtype, count(*) AS n, count(*) - count({c}) AS nulls, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(DISTINCT {c}) AS n_distinct, "
        f"min(CAST({c} AS VARCHAR)) AS example FROM {table}"
        for c, d in columns
    )


@query("profile_columns", sql=_profile_sql("customer", _PROFILED))
def profile_columns(t: Tables) -> DataFrame:
    return rounded(P.profile_columns(t("customer")))


@query("profile_columns_with_gaps", sql=_profile_sql(
    "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]))
def profile_columns_with_gaps(t: Tables) -> DataFrame:
    joined = t("documents").join(t("labels"), "doc_id", "left")
    return rounded(P.profile_columns(joined))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\", "
    f"round(avg({c}), 6) AS mean, count(*) FILTER (WHERE {c} = 0) AS zeros, "
    f"count(*) FILTER (WHERE {c} < 0) AS negatives FROM lineitem" for c in _NUMERIC))
def profile_numeric(t: Tables) -> DataFrame:
    return rounded(P.numeric_ranges(t("lineitem"), _NUMERIC))


@query("profile_values", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {tab} GROUP BY {c}"
    for tab, c in [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("lineitem", "l_linenumber")]))
def profile_values(t: Tables) -> DataFrame:
    return P.value_counts(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("value_widths", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 20 AS too_many FROM lineitem"
    for c in ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"]))
def value_widths(t: Tables) -> DataFrame:
    return P.value_widths(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"], 20)


@query("profile_values_nulls", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n "
    f"FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY {c}" for c in ["quality", "toxic", "lang"]))
def profile_values_nulls(t: Tables) -> DataFrame:
    joined = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return P.value_counts(joined, ["quality", "toxic", "lang"])


_DESCRIBE = """
SELECT '{scope}' AS scope, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd,
       min(n_chars) AS "min", max(n_chars) AS "max", round(quantile_cont(n_chars, 0.25), 6) AS q1,
       round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3
FROM documents WHERE {where}
"""


@query("describe_subset", sql=_DESCRIBE.format(scope="all", where="true") + " UNION ALL "
       + _DESCRIBE.format(scope="subset", where="lang = 'en'"))
def describe_subset(t: Tables) -> DataFrame:
    return rounded(P.describe_scopes(t("documents"), "n_chars", F.col("lang") == "en"))


_PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query("quantile_profile", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS quantile FROM lineitem"
    for c in ["l_quantity", "l_extendedprice"] for p in _PROBS))
def quantile_profile(t: Tables) -> DataFrame:
    return rounded(P.quantile_profile(t("lineitem"), ["l_quantity", "l_extendedprice"], _PROBS), 4)


@query("key_coverage", sql="""
WITH k AS (
  SELECT 'documents' AS tab, doc_id AS key FROM documents UNION SELECT 'labels', doc_id FROM labels
  UNION SELECT 'embeddings', vec_id FROM embeddings)
SELECT a.tab AS left_table, b.tab AS right_table,
       (SELECT count(*) FROM k x WHERE x.tab = a.tab) AS left_keys,
       (SELECT count(*) FROM k x WHERE x.tab = a.tab AND NOT EXISTS (SELECT 1 FROM k y WHERE y.tab = b.tab AND y.key = x.key)) AS missing_in_right
FROM (SELECT DISTINCT tab FROM k) a, (SELECT DISTINCT tab FROM k) b WHERE a.tab <> b.tab
""")
def key_coverage(t: Tables) -> DataFrame:
    return P.key_coverage({
        "documents": (t("documents"), "doc_id"), "labels": (t("labels"), "doc_id"),
        "embeddings": (t("embeddings"), "vec_id"),
    })


@query("rows_per_entity", sql="""
SELECT count(*) AS entities, min(c) AS min_rows, max(c) AS max_rows, median(c) AS median_rows
FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey)
""")
def rows_per_entity(t: Tables) -> DataFrame:
    return P.rows_per_entity(t("orders"), "o_custkey")


@query("period_range", sql="""
SELECT strftime(min(m), '%Y-%m-%d') AS first_period, strftime(max(m), '%Y-%m-%d') AS last_period, count(DISTINCT m) AS n_periods
FROM (SELECT date_trunc('month', o_orderdate) AS m FROM orders)
""")
def period_range(t: Tables) -> DataFrame:
    r = P.period_range(t("orders"), "o_orderdate")
    return r.select(F.col("first_period").cast("string"), F.col("last_period").cast("string"), "n_periods")


@query("label_distribution", sql="""
WITH c AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic)
SELECT label, n, round(n / (SELECT sum(n) FROM c), 6) AS share, round(n / (SELECT min(n) FROM c), 6) AS ratio_to_rarest FROM c
""")
def label_distribution(t: Tables) -> DataFrame:
    return rounded(P.label_distribution(t("labels"), "toxic"))


@query("string_shape_mask", sql="""
SELECT 'c_name' AS "column", regexp_replace(c_name, '[0-9]', '9', 'g') AS mask, count(*) AS n FROM customer GROUP BY mask
UNION ALL
SELECT 'c_mktsegment', regexp_replace(c_mktsegment, '[0-9]', '9', 'g') AS mask, count(*) FROM customer GROUP BY mask
""")
def string_shape_mask(t: Tables) -> DataFrame:
    return P.shape_masks(t("customer"), ["c_name", "c_mktsegment"])


@query("string_shape_urls", sql="""
SELECT 'url' AS "column", regexp_replace(url, '[0-9]', '9', 'g') AS mask, count(*) AS n FROM pages GROUP BY mask
""")
def string_shape_urls(t: Tables) -> DataFrame:
    return P.shape_masks(t("pages"), ["url"])


_EDGES = [0, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000]


@query("hist_fixed", sql=" UNION ALL ".join(
    f"SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, "
    f"count(*) FILTER (WHERE n_chars > coalesce({lo}, -1) AND n_chars <= coalesce({hi}, n_chars)) AS n FROM documents"
    for lo, hi in zip(["NULL", *_EDGES], [*_EDGES, "NULL"])))
def hist_fixed(t: Tables) -> DataFrame:
    return P.histogram_fixed(t("documents"), "n_chars", _EDGES)


@query("hist_equal_width", sql="""
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem),
     w AS (SELECT lo, (hi - lo) / 40 AS w, n AS total FROM e),
     c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 39) AS INTEGER) AS bin, count(*) AS n FROM lineitem, w GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * w, 6) AS lo, round(lo + (g.bin + 1) * w, 6) AS hi,
       coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (total * w), 12) AS density
FROM range(40) g(bin) CROSS JOIN w LEFT JOIN c ON c.bin = g.bin
""")
def hist_equal_width(t: Tables) -> DataFrame:
    h = P.histogram_equal_width(t("lineitem"), "l_extendedprice", 40)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", F.round("density", 12).alias("density"))


@query("counts_by_month", sql="""
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*) AS n FROM orders GROUP BY 1
""")
def counts_by_month(t: Tables) -> DataFrame:
    return P.counts_by_period(t("orders"), "o_orderdate").withColumn("period", F.col("period").cast("string"))


@query("counts_by_year", sql="""
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY 1
""")
def counts_by_year(t: Tables) -> DataFrame:
    return P.counts_by_period(t("lineitem"), "l_shipdate", "year").select(F.year("period").alias("year"), "n")


@query("sparse_periods", sql="""
WITH c AS (SELECT date_trunc('month', l_shipdate) AS period, count(*) AS n FROM lineitem GROUP BY 1),
     s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd, count(*) AS k FROM c)
SELECT strftime(period, '%Y-%m-%d') AS period, n, round(m, 6) AS mean_n, round(sd, 6) AS sd_n, k AS n_periods
FROM c, s WHERE n < m * 0.98
""")
def sparse_periods(t: Tables) -> DataFrame:
    s = P.sparse_periods(t("lineitem"), "l_shipdate", "month", 0.98)
    return rounded(s.withColumn("period", F.col("period").cast("string")))


@query("band_summary", sql="""
SELECT CASE WHEN c_acctbal < 0 THEN 'below' WHEN c_acctbal > 9000 THEN 'above' ELSE 'inside' END AS band,
       count(*) AS n, min(c_acctbal) AS "min", max(c_acctbal) AS "max", round(avg(c_acctbal), 6) AS mean,
       round(stddev_samp(c_acctbal), 6) AS sd, round(count(*) / (SELECT count(*) FROM customer), 6) AS share
FROM customer GROUP BY 1
""")
def band_summary(t: Tables) -> DataFrame:
    return rounded(P.band_summary(t("customer"), "c_acctbal", 0.0, 9000.0))


@query("top_values", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_values(t: Tables) -> DataFrame:
    return P.top_values(t("orders"), "o_totalprice", "o_orderkey", 10)


@query("bottom_values", sql="SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def bottom_values(t: Tables) -> DataFrame:
    return P.top_values(t("customer"), "c_acctbal", "c_custkey", 10, largest=False)


@query("seeded_sample", sql="""
SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100
""")
def seeded_sample(t: Tables) -> DataFrame:
    return P.seeded_sample(t("customer").select("c_custkey"), "c_custkey", 100, 42)


@query("category_hygiene", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS raw_values, count(DISTINCT lower(trim({c}))) AS folded_values, "
    f"count(*) FILTER (WHERE {c} <> trim({c})) AS padded_rows, count(DISTINCT {c}) <> count(DISTINCT lower(trim({c}))) AS has_variants FROM {tab}"
    for tab, c in [("documents", "lang"), ("documents", "source")]))
def category_hygiene(t: Tables) -> DataFrame:
    return I.category_hygiene(t("documents"), ["lang", "source"])


@query("number_hygiene", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (WHERE {c} <> round({c})) AS non_integer, "
    f"count(*) FILTER (WHERE {c} <= 0 OR {c} > 49) AS sentinels FROM lineitem" for c in ["l_quantity", "l_discount", "l_tax"]))
def number_hygiene(t: Tables) -> DataFrame:
    return I.number_hygiene(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], 0, 49)


@query("unparseable_dates", sql="""
SELECT count(s) AS n, count(*) FILTER (WHERE s IS NOT NULL AND try_cast(s AS DATE) IS NULL) AS unparseable,
       count(*) FILTER (WHERE s LIKE '%/%') AS with_slash
FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
""")
def unparseable_dates(t: Tables) -> DataFrame:
    written = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return I.unparseable_dates(t("orders").select(written.alias("s")), "s")


@query("evidence_list", sql="SELECT c_custkey, c_acctbal AS value, printf('%.2f', c_acctbal) AS evidence FROM customer WHERE c_acctbal < 0")
def evidence_list(t: Tables) -> DataFrame:
    return P.evidence_rows(t("customer"), ["c_custkey"], "c_acctbal", F.col("c_acctbal") < 0)


@query("evidence_top20", sql="""
SELECT count(*) AS n, min(c_acctbal) AS lowest, max(c_acctbal) AS highest,
  (SELECT string_agg(printf('%.2f', v), ', ' ORDER BY v) FROM (SELECT c_acctbal AS v FROM customer WHERE c_acctbal < 0 ORDER BY 1 LIMIT 20)) AS listed
FROM customer WHERE c_acctbal < 0
""")
def evidence_top20(t: Tables) -> DataFrame:
    return P.evidence_top(t("customer"), "c_acctbal", F.col("c_acctbal") < 0, 20)
