"""Shapes, rates and tests on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..sources.tables import Tables
from . import sqltext
from .registry import query, rounded


def _labelled(t: Tables) -> DataFrame:
    docs = t("documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return docs.join(t("labels"), "doc_id").withColumn("log_chars", F.ln("n_chars"))


_LABELLED = ("(SELECT d.doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars, ln(n_chars) AS log_chars, quality, toxic "
             "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


def _moments_sql(c: str, tab: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd_samp, "
        f"round(stddev_pop({c}), 6) AS sd_pop, "
        f"round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * CAST(count({c}) - 1 AS DOUBLE)), 6) AS skew_pop, "
        f"round(skewness({c}), 6) AS skew_adj, round(kurtosis_pop({c}), 6) AS kurt_pop, round(kurtosis({c}), 6) AS kurt_adj FROM {tab}"
    )


@query("moments_adjusted", sql=" UNION ALL ".join(
    _moments_sql(c, "lineitem") for c in ["l_quantity", "l_discount", "l_tax"]))
def moments_adjusted(t: Tables) -> DataFrame:
    return rounded(S.moments(t("lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("moments_events", sql=_moments_sql("value", "events"))
def moments_events(t: Tables) -> DataFrame:
    return rounded(S.moments(t("events"), ["value"]))


@query("label_rate_by_category", sql=f"SELECT lang, source, round(avg(toxic), 6) AS rate, count(*) AS n FROM {_LABELLED} GROUP BY ALL")
def label_rate_by_category(t: Tables) -> DataFrame:
    return rounded(S.group_rate(_labelled(t), "toxic", ["lang", "source"]))


@query("label_rate_by_dimension", sql=" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, round(avg(toxic), 6) AS rate, count(*) AS n FROM {_LABELLED} GROUP BY {d}"
    for d in ["lang", "source", "quality"]))
def label_rate_by_dimension(t: Tables) -> DataFrame:
    return rounded(S.rates_by_dimension(_labelled(t), F.col("toxic"), ["lang", "source", "quality"]))


@query("label_crosstab", sql=f"""
SELECT lang AS category, count(*) FILTER (WHERE toxic = 0) AS label_0, count(*) FILTER (WHERE toxic = 1) AS label_1 FROM {_LABELLED} GROUP BY 1
""")
def label_crosstab(t: Tables) -> DataFrame:
    return S.crosstab(_labelled(t), "lang", "toxic", [0, 1])


@query("label_by_period_pivot", sql=" UNION ALL ".join(f"""
SELECT '{m}' AS metric, y AS "year", round(avg({m}) FILTER (WHERE label = 0), 6) AS mean_0, round(avg({m}) FILTER (WHERE label = 1), 6) AS mean_1,
       round(avg({m}) FILTER (WHERE label = 1) - avg({m}) FILTER (WHERE label = 0), 6) AS diff,
       round((avg({m}) FILTER (WHERE label = 1) - avg({m}) FILTER (WHERE label = 0)) / avg({m}) FILTER (WHERE label = 0) * 100, 6) AS diff_pct
FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, sum(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS orders,
             max(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS label
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY y""" for m in ["spend", "orders"]))
def label_by_period_pivot(t: Tables) -> DataFrame:
    label = t("customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).cast("int").alias("label"))
    panel = t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("orders"))
    return rounded(S.label_by_period(panel.join(label, "o_custkey"), "year", "label", ["spend", "orders"]))


@query("point_biserial", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, round(corr({c}, toxic), 6) AS r FROM {_LABELLED}"
    for c in ["n_chars", "log_chars", "quality"]))
def point_biserial(t: Tables) -> DataFrame:
    return rounded(S.correlations(_labelled(t), ["n_chars", "log_chars", "quality"], "toxic"))


@query("label_rate_by_quantile", sql=f"""
WITH e AS (SELECT list_distinct([quantile_cont(n_chars, 0.2), quantile_cont(n_chars, 0.4), quantile_cont(n_chars, 0.6), quantile_cont(n_chars, 0.8)]) AS e FROM {_LABELLED}),
     b AS (SELECT CAST(len(list_filter(e, lambda z: z < n_chars)) AS INTEGER) AS bin, n_chars, toxic FROM {_LABELLED}, e)
SELECT bin, count(*) AS n, min(n_chars) AS lowest, max(n_chars) AS highest, round(avg(toxic), 6) AS rate FROM b GROUP BY bin
""")
def label_rate_by_quantile(t: Tables) -> DataFrame:
    return rounded(S.rate_by_quantile(_labelled(t), "n_chars", "toxic", 5))


_TIES = ", ".join(f"quantile_cont(l_discount, {i / 20})" for i in range(1, 20))


@query("quantile_bins_with_ties", sql=f"""
WITH q AS (SELECT [{_TIES}] AS q, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem),
     e AS (SELECT list_distinct(list_filter(q, lambda z: z > lo AND z < hi)) AS e FROM q),
     b AS (SELECT CAST(len(list_filter(e, lambda z: z < l_discount)) AS INTEGER) AS bin, l_discount, l_tax FROM lineitem, e)
SELECT bin, count(*) AS n, min(l_discount) AS lowest, max(l_discount) AS highest, round(avg(l_tax), 6) AS rate FROM b GROUP BY bin
""")
def quantile_bins_with_ties(t: Tables) -> DataFrame:
    # eleven distinct values under twenty bins: most edges repeat
    return rounded(S.rate_by_quantile(t("lineitem"), "l_discount", "l_tax", 20))


@query("label_rate_by_fixed_bin", sql=f"""
SELECT CASE WHEN n_chars <= 10 THEN 0 WHEN n_chars <= 500 THEN 1 WHEN n_chars <= 2000 THEN 2 WHEN n_chars <= 8000 THEN 3 ELSE 4 END AS bin,
       count(*) AS n, round(avg(toxic), 6) AS rate FROM {_LABELLED} GROUP BY 1
""")
def label_rate_by_fixed_bin(t: Tables) -> DataFrame:
    return rounded(S.rate_by_fixed_bin(_labelled(t), "n_chars", "toxic", [10, 500, 2000, 8000]))


@query("median_distance", sql=" UNION ALL ".join(
    f"SELECT CAST({k} AS DOUBLE) AS distance, count(*) FILTER (WHERE abs(c_acctbal - (SELECT median(c_acctbal) FROM customer)) > {k}) AS n_beyond FROM customer"
    for k in [1000, 2000, 3000, 4000, 5000]))
def median_distance(t: Tables) -> DataFrame:
    return S.median_distance(t("customer"), "c_acctbal", [1000, 2000, 3000, 4000, 5000])


@query("flagged_means", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE l_tax = 0) AS n_flagged, round(avg({c}) FILTER (WHERE l_tax = 0), 6) AS mean_flagged, round(avg({c}), 6) AS mean_all FROM lineitem"
    for c in ["l_quantity", "l_extendedprice"]))
def flagged_means(t: Tables) -> DataFrame:
    return rounded(S.flagged_means(t("lineitem"), F.col("l_tax") == 0, ["l_quantity", "l_extendedprice"]))


@query("welch_t", sql=f"""
WITH s AS ({' UNION ALL '.join(f'''
  SELECT '{c}' AS feature, count({c}) FILTER (WHERE toxic = 0) AS n0, count({c}) FILTER (WHERE toxic = 1) AS n1,
         avg({c}) FILTER (WHERE toxic = 0) AS mean0, avg({c}) FILTER (WHERE toxic = 1) AS mean1,
         var_samp({c}) FILTER (WHERE toxic = 0) AS v0, var_samp({c}) FILTER (WHERE toxic = 1) AS v1, corr({c}, toxic) AS r FROM {_LABELLED}'''
    for c in ['n_chars', 'log_chars', 'quality'])}),
  q AS (SELECT *, (mean1 - mean0) / sqrt(v0 / n0 + v1 / n1) AS t,
        pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)) AS dof FROM s)
SELECT feature, n0, n1, round(mean0, 5) AS mean0, round(mean1, 5) AS mean1, round(t, 5) AS t, round(dof, 5) AS dof, round(r, 5) AS r,
       round({sqltext.student_two_sided('t', 'dof')}, 5) AS p, CAST(0.15 AS DOUBLE) AS expected_false_positives FROM q
""")
def welch_t(t: Tables) -> DataFrame:
    return rounded(S.welch_tests(_labelled(t), ["n_chars", "log_chars", "quality"], "toxic"), 5)


@query("chi2_yates", sql=f"""
WITH l AS (SELECT 'lang' AS variable, CAST(lang AS VARCHAR) AS value, toxic FROM {_LABELLED} UNION ALL
           SELECT 'source', source, toxic FROM {_LABELLED} UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), toxic FROM {_LABELLED}),
  r AS (SELECT variable, value, count(*) AS r FROM l GROUP BY 1, 2), c AS (SELECT variable, toxic, count(*) AS c FROM l GROUP BY 1, 2),
  n AS (SELECT variable, count(*) AS n, (count(DISTINCT value) - 1) * (count(DISTINCT toxic) - 1) AS dof FROM l GROUP BY 1),
  g AS (SELECT r.variable, n, dof, r.r * c.c * 1.0 / n AS e, coalesce(o.o, 0) AS o FROM r JOIN c ON r.variable = c.variable JOIN n ON n.variable = r.variable
        LEFT JOIN (SELECT variable, value, toxic, count(*) AS o FROM l GROUP BY 1, 2, 3) o ON o.variable = r.variable AND o.value = r.value AND o.toxic = c.toxic),
  s AS (SELECT variable, max(n) AS n, max(dof) AS dof, sum(pow(CASE WHEN dof = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE o - e END, 2) / e) AS chi2 FROM g GROUP BY 1)
SELECT variable, n, dof, round(chi2, 5) AS chi2, round({sqltext.chi2_upper('chi2', 'dof')}, 5) AS p FROM s
""")
def chi2_yates(t: Tables) -> DataFrame:
    return rounded(S.chi2_tests(_labelled(t), ["lang", "source", "quality"], "toxic"), 5)


@query("ks_uniform", sql=f"""
WITH l AS (SELECT 'p_retailprice' AS metric, p_retailprice AS x FROM part UNION ALL SELECT 'p_size', CAST(p_size AS DOUBLE) FROM part),
  r AS (SELECT metric, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS u, rank() OVER (PARTITION BY metric ORDER BY x) - 1 AS before,
        count(*) OVER (PARTITION BY metric ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through, count(*) OVER w AS n
        FROM l WINDOW w AS (PARTITION BY metric)),
  s AS (SELECT metric, max(n) AS n, greatest(max(through * 1.0 / n - u), max(u - before * 1.0 / n)) AS d FROM r GROUP BY 1)
SELECT metric, n, round(d, 6) AS d, round({sqltext.kolmogorov_upper('d', 'n')}, 6) AS p FROM s
""")
def ks_uniform(t: Tables) -> DataFrame:
    return rounded(S.ks_uniform(t("part"), ["p_retailprice", "p_size"]))


@query("normal_fit_bands", sql=f"""
WITH s AS (SELECT count(l_tax) AS n, avg(l_tax) AS mu, stddev_samp(l_tax) AS sd, count(*) FILTER (WHERE l_tax = 0) AS at_bound, count(*) FILTER (WHERE l_tax < 0) AS below_bound,
  count(*) FILTER (WHERE l_tax > 0 AND l_tax < 0.02) AS "in_0_0.02", count(*) FILTER (WHERE l_tax >= 0.02 AND l_tax < 0.05) AS "in_0.02_0.05" FROM lineitem)
SELECT n, round(mu, 5) AS mu, round(sd, 5) AS sd, at_bound, below_bound, "in_0_0.02" AS band_1, "in_0.02_0.05" AS band_2,
       round({sqltext.normal_cdf('-mu / sd')} * n, 4) AS expected_below FROM s
""")
def normal_fit_bands(t: Tables) -> DataFrame:
    s = S.normal_fit_bands(t("lineitem"), "l_tax", 0.0, [(0.0, 0.02), (0.02, 0.05)])
    s = s.withColumnsRenamed({"in_0_0.02": "band_1", "in_0.02_0.05": "band_2"})
    return s.select(
        "n", F.round("mu", 5).alias("mu"), F.round("sd", 5).alias("sd"), "at_bound", "below_bound", "band_1", "band_2",
        F.round("expected_below", 4).alias("expected_below"))


@query("label_plausibility", sql="""
WITH m AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS label, CAST(count(o_orderkey) AS DOUBLE) AS k
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate, round(avg(k), 6) AS mean_count,
       round(var_samp(k) / avg(k), 6) AS dispersion, round(avg(k) FILTER (WHERE label = 1) - avg(k) FILTER (WHERE label = 0), 6) AS mean_gap FROM m
""")
def label_plausibility(t: Tables) -> DataFrame:
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    m = t("customer").join(counts, "c_custkey", "left").select(
        (F.col("c_acctbal") < 0).cast("int").alias("label"), F.coalesce("k", F.lit(0.0)).alias("k"))
    return rounded(S.label_plausibility(m, "label", "k"))


@query("cohort_means", sql="""
WITH c AS (SELECT date_trunc('month', o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1),
     s AS (SELECT p FROM c WHERE n < 0.9 * (SELECT avg(n) FROM c)),
     j AS (SELECT CASE WHEN date_trunc('month', o_orderdate) IN (SELECT p FROM s) THEN 'sparse' ELSE 'regular' END AS cohort, o_totalprice, c_acctbal
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT cohort, 'o_totalprice' AS "column", count(*) AS n, round(avg(o_totalprice), 5) AS mean FROM j GROUP BY 1
UNION ALL SELECT cohort, 'c_acctbal', count(*), round(avg(c_acctbal), 5) FROM j GROUP BY 1
""")
def cohort_means(t: Tables) -> DataFrame:
    from ..operators.profile import sparse_periods

    sparse = sparse_periods(t("orders"), "o_orderdate", "month", 0.9).select(
        F.col("period").alias("__p"), F.lit(True).alias("sparse"))
    joined = t("orders").withColumn("__p", F.date_trunc("month", "o_orderdate").cast("date")).join(sparse, "__p", "left").join(
        t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    cohort = F.when(F.col("sparse"), "sparse").otherwise("regular")
    return rounded(S.cohort_means(joined, cohort, ["o_totalprice", "c_acctbal"]), 5)
