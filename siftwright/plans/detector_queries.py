"""Defect detectors on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import mixture as M
from ..operators.profile import row_count
from ..sources.scratch import materialize
from ..sources.tables import Tables
from . import sqltext
from .registry import query, result, rounded


def _docs_with_labels(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id", "left")


_DOCS = "(SELECT d.doc_id, lang, source, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("missing_by_segment", sql=f"""
WITH o AS (SELECT avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM {_DOCS}),
  s AS (SELECT 'lang' AS dimension, lang AS value, avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM {_DOCS} GROUP BY lang
        UNION ALL SELECT 'source', source, avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END), count(*) FROM {_DOCS} GROUP BY source)
SELECT dimension, value, round(r, 6) AS missing_rate, s.n AS n, round(p, 6) AS overall_rate,
       round(3 * sqrt(p * (1 - p) / o.n), 6) AS band_total, round(3 * sqrt(p * (1 - p) / s.n), 6) AS band_segment,
       abs(r - p) <= 3 * sqrt(p * (1 - p) / o.n) AS inside_total, abs(r - p) <= 3 * sqrt(p * (1 - p) / s.n) AS inside_segment
FROM s, o
""")
def missing_by_segment(t: Tables) -> DataFrame:
    return rounded(D.missing_by_segment(_docs_with_labels(t), "quality", ["lang", "source"]))


@query("impute_median", sql=f"""
SELECT doc_id, quality, coalesce(CAST(quality AS DOUBLE), (SELECT median(quality) FROM labels)) AS quality_imputed, quality IS NULL AS quality_missing FROM {_DOCS}
""")
def impute_median(t: Tables) -> DataFrame:
    filled = D.impute_median(_docs_with_labels(t), "quality", imputed="quality_imputed", flag="quality_missing")
    return filled.select("doc_id", "quality", "quality_imputed", "quality_missing")


def _iqr_sql(c: str, tab: str) -> str:
    return f"""
SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence, count(*) AS n,
       count(*) FILTER (WHERE {c} < lo) AS n_below, count(*) FILTER (WHERE {c} > hi) AS n_above
FROM {tab}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
  quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {tab}) GROUP BY ALL"""


@query("iqr_outliers", sql=_iqr_sql("l_quantity", "lineitem") + " UNION ALL " + _iqr_sql("l_extendedprice", "lineitem"))
def iqr_outliers(t: Tables) -> DataFrame:
    return rounded(D.iqr_outliers(t("lineitem"), ["l_quantity", "l_extendedprice"]))


@query("iqr_outliers_events", sql=_iqr_sql("value", "events"))
def iqr_outliers_events(t: Tables) -> DataFrame:
    return rounded(D.iqr_outliers(t("events"), ["value"]))


@query("zscore_outliers", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (WHERE abs(({c} - m) / s) > 4) AS n_outside, round(max(abs(({c} - m) / s)), 6) AS largest "
    f"FROM {tab}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {tab})" for tab, c in [("events", "value"), ("events", "user_id")]))
def zscore_outliers(t: Tables) -> DataFrame:
    return rounded(D.zscore_outliers(t("events"), ["value", "user_id"]))


_PROBES = [-900, 0, 1000, 3000, 5000, 7000, 9000, 9990, 12000]


@query("density_scan", sql=" UNION ALL ".join(
    f"SELECT CAST({v} AS DOUBLE) AS probe, count(*) FILTER (WHERE c_acctbal BETWEEN {v} - 200 AND {v} + 200) AS n FROM customer" for v in _PROBES))
def density_scan(t: Tables) -> DataFrame:
    return D.density_at(t("customer"), "c_acctbal", _PROBES, 200.0)


@query("gap_scan", sql="""
WITH v AS (SELECT DISTINCT n_chars AS lower FROM documents WHERE n_chars BETWEEN 500 AND 20000),
     g AS (SELECT lower, lead(lower) OVER (ORDER BY lower) AS upper FROM v)
SELECT lower, upper, upper - lower AS gap FROM g WHERE upper IS NOT NULL ORDER BY gap DESC, lower LIMIT 8
""")
def gap_scan(t: Tables) -> DataFrame:
    return D.largest_gaps(t("documents"), "n_chars", 500, 20000, 8)


@query("negative_flags", sql="""
SELECT c_custkey, c_acctbal, c_acctbal < 0 AS dq_negative FROM customer
""")
def negative_flags(t: Tables) -> DataFrame:
    return t("customer").select("c_custkey", "c_acctbal", D.is_negative("c_acctbal").alias("dq_negative"))


@query("low_flags", sql="""
SELECT c_custkey, c_acctbal, c_acctbal >= 0 AND c_acctbal < (SELECT quantile_cont(c_acctbal, 0.15) FROM customer) AS dq_low FROM customer
""")
def low_flags(t: Tables) -> DataFrame:
    from ..operators.ordering import quantiles

    bound = quantiles(t("customer"), "c_acctbal", {"b": 0.15}).scalar()
    return t("customer").select("c_custkey", "c_acctbal", D.is_implausibly_low("c_acctbal", bound).alias("dq_low"))


@query("clean_column", sql="""
SELECT c_custkey, c_acctbal < 0 AS dq_negative, c_acctbal >= 0 AND c_acctbal < 100 AS dq_low,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal_clean FROM customer
""")
def clean_column(t: Tables) -> DataFrame:
    flagged = D.flag_values(
        t("customer"), "c_acctbal",
        {"dq_negative": D.is_negative("c_acctbal"), "dq_low": D.is_implausibly_low("c_acctbal", 100.0)},
        "c_acctbal_clean", ["dq_negative"])
    return flagged.select("c_custkey", "dq_negative", "dq_low", "c_acctbal_clean")


@query("decimal_shift", sql="""
SELECT count(*) FILTER (WHERE n_chars > 5000) AS n_above, min(n_chars) FILTER (WHERE n_chars > 5000) AS lowest, max(n_chars) FILTER (WHERE n_chars > 5000) AS highest,
       round(avg(CASE WHEN n_chars / 10.0 BETWEEN 200 AND 1000 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n_chars > 5000), 6) AS share_in_band FROM documents
""")
def decimal_shift(t: Tables) -> DataFrame:
    return rounded(D.decimal_shift(t("documents"), "n_chars", 5000, (200, 1000)))


_FIXED = (M.Component(0.9, 6.5, 0.8), M.Component(0.1, 9.0, 0.6))


@query("mixture_flags", sql="""
WITH x AS (SELECT doc_id, ln(n_chars) AS log_chars FROM documents),
     p AS (SELECT *, 0.9 / 0.8 * exp(-pow((log_chars - 6.5) / 0.8, 2) / 2) AS a, 0.1 / 0.6 * exp(-pow((log_chars - 9.0) / 0.6, 2) / 2) AS b FROM x)
SELECT doc_id, round(log_chars, 6) AS log_chars, round(b / (a + b), 6) AS posterior,
       b / (a + b) > 0.5 AND log_chars > 6.5 AS dq_contaminated FROM p
""")
def mixture_flags(t: Tables) -> DataFrame:
    x = t("documents").select("doc_id", F.ln("n_chars").alias("log_chars"))
    model = M.Mixture(0, 0.0, _FIXED)
    return rounded(x.select(
        "doc_id", "log_chars", M.high_component_posterior("log_chars", *_FIXED).alias("posterior"),
        M.is_contaminated("log_chars", model).alias("dq_contaminated")))


@result("mixture_bic_values")
def mixture_bic_values(t: Tables) -> DataFrame:
    x = t("documents").where("n_chars > 0").select(F.ln("n_chars").alias("log_chars"))
    return M.mixture_rows(t.spark, M.fit_mixtures(x, "log_chars", ks=(1, 2, 3), n_init=5))


@query("mixture_bic", sql="""
WITH x AS (SELECT ln(n_chars) AS v FROM documents WHERE n_chars > 0), m AS (SELECT count(*) AS n, var_pop(v) AS s FROM x)
SELECT k, CAST(k AS BIGINT) AS components, k > 1 AS below_one_component, round(n * (ln(2 * pi() * s) + 1) + 2 * ln(n), 4) AS bic_of_one, 1.0::DOUBLE AS total_weight
FROM m, (SELECT unnest([1, 2, 3])::INTEGER AS k)
""")
def mixture_bic(t: Tables) -> DataFrame:
    found = mixture_bic_values(t)
    one = found.where("k = 1").agg(F.max("bic")).scalar()
    return found.groupBy("k").agg(row_count().alias("components"), F.max("bic").alias("bic"), F.sum("weight").alias("w")).select(
        "k", "components", (F.col("bic") < one).alias("below_one_component"), F.round(one, 4).alias("bic_of_one"), F.round("w", 6).alias("total_weight"))


@result("mixture_fit_values")
def mixture_fit_values(t: Tables) -> DataFrame:
    x = t("documents").where("n_chars > 0").select("doc_id", F.ln("n_chars").alias("log_chars"))
    model = M.fit_counts(M.value_counts(x, "log_chars"), 2)
    return x.select("doc_id", "log_chars", M.high_component_posterior("log_chars", *model.components).alias("posterior"),
                    M.is_contaminated("log_chars", model).alias("dq_contaminated"))


@query("mixture_fit", sql="""
SELECT doc_id, true AS flag_follows_posterior, true AS flag_is_an_upper_part, true AS share_is_the_weight FROM documents WHERE n_chars > 0
""")
def mixture_fit(t: Tables) -> DataFrame:
    """Flags agree with the posteriors, nothing unflagged lies above a flagged value, and the posteriors' mean is a component's weight."""
    x = t("documents").where("n_chars > 0").select("doc_id", F.ln("n_chars").alias("log_chars"))
    model = M.fit_counts(M.value_counts(x, "log_chars"), 2)
    low, high = model.components
    apart = abs(high.mean - low.mean) / ((low.sd**2 + high.sd**2) / 2) ** 0.5 >= 2.0
    rows = materialize(x.select("doc_id", "log_chars", M.high_component_posterior("log_chars", low, high).alias("posterior"),
                                M.is_contaminated("log_chars", model).alias("flag")), "mixture-rows")
    facts = rows.agg(F.struct(F.avg("posterior").alias("share"), F.min(F.when(F.col("flag"), F.col("log_chars"))).alias("lowest"),
                              F.max(F.when(F.col("flag"), F.col("log_chars"))).alias("highest"))).scalar()
    expected = (F.col("posterior") > 0.5) & (F.col("log_chars") > low.mean) & F.lit(apart)
    # a narrow high component may leave the farthest values to the wide one, so the flagged part is an interval
    between = F.coalesce(F.col("log_chars").between(facts.getField("lowest"), facts.getField("highest")), F.lit(False))
    return rows.select("doc_id", (F.col("flag") == expected).alias("flag_follows_posterior"), (F.col("flag") == between).alias("flag_is_an_upper_part"),
                       (F.abs(facts.getField("share") - high.weight) < 1e-3).alias("share_is_the_weight"))


@query("mixture_fixed_point", sql="""
WITH x AS (SELECT ln(n_chars) AS v FROM documents WHERE n_chars > 0)
SELECT k, true AS fixed_point, true AS better_than_fewer, count(*) AS n, 1.0::DOUBLE AS total_weight, round(avg(v), 5) AS mean, round(avg(v * v), 5) AS second_moment
FROM x, (SELECT unnest([2, 3])::INTEGER AS k) GROUP BY k
""")
def mixture_fixed_point(t: Tables) -> DataFrame:
    """The fitted components are what follows from their own posteriors, and their mixture has the data's first two moments."""
    counts = M.value_counts(t("documents").where("n_chars > 0").select(F.ln("n_chars").alias("log_chars")), "log_chars")
    one, rows = M.fit_counts(counts, 1), []
    before = one.log_likelihood
    for k in (2, 3):
        model = M.fit_counts(counts, k)
        loglik, again = M.em_step(counts, model.components)
        rows.append((k, M.largest_move(model.components, again) <= 1e-3, loglik >= before - 1e-6, model.n, round(sum(c.weight for c in again), 9),
                     sum(c.weight * c.mean for c in again), sum(c.weight * (c.sd**2 + c.mean**2) for c in again)))
        before = loglik
    found = t.spark.createDataFrame(rows, "k int, fixed_point boolean, better_than_fewer boolean, n long, total_weight double, mean double, second_moment double")
    return found.withColumns({c: F.round(c, 5) for c in ("mean", "second_moment")})


@query("tail_excess_lognormal", sql=f"""
WITH s AS (SELECT count(*) AS n, avg(ln(n_chars)) AS mu, stddev_samp(ln(n_chars)) AS sd FROM documents WHERE n_chars > 0),
     c AS (SELECT unnest([2000.0, 5000.0, 10000.0, 20000.0]) AS cutoff)
SELECT CAST(cutoff AS DOUBLE) AS cutoff, n, round(mu, 6) AS mu, round(sd, 6) AS sd,
       (SELECT count(*) FROM documents WHERE n_chars > cutoff) AS observed,
       round({sqltext.normal_cdf('(mu - ln(CAST(cutoff AS DOUBLE))) / sd')} * n, 4) AS expected FROM c, s
""")
def tail_excess_lognormal(t: Tables) -> DataFrame:
    s = D.tail_excess(t("documents"), "n_chars", [2000, 5000, 10000, 20000])
    return rounded(s.withColumn("expected", F.round("expected", 4)))


@query("zero_floor", sql=f"""
WITH s AS (SELECT count(l_tax) AS n, avg(l_tax) AS mu, stddev_samp(l_tax) AS sd, count(*) FILTER (WHERE l_tax = 0) AS at_zero, count(*) FILTER (WHERE l_tax < 0) AS below_zero,
  avg(l_quantity) FILTER (WHERE l_tax = 0) AS l_quantity_at_zero, avg(l_quantity) AS l_quantity_all FROM lineitem)
SELECT n, round(mu, 4) AS mu, round(sd, 4) AS sd, at_zero, below_zero, round(l_quantity_at_zero, 4) AS l_quantity_at_zero, round(l_quantity_all, 4) AS l_quantity_all,
       round({sqltext.normal_cdf('-mu / sd')} * n, 4) AS expected_below, round(at_zero * 100 / n, 4) AS zero_pct FROM s
""")
def zero_floor(t: Tables) -> DataFrame:
    return rounded(D.zero_floor(t("lineitem"), "l_tax", ["l_quantity"]), 4)


@query("uniform_shape", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS "column", s.*, v.*, (lo + hi) / 2 AS uniform_mean, round(sqrt((pow(hi - lo + 1, 2) - 1) / 12), 6) AS uniform_sd,
       round(-6.0 / 5.0 * (pow(hi - lo + 1, 2) + 1) / (pow(hi - lo + 1, 2) - 1), 6) AS uniform_kurt
FROM (SELECT count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(kurtosis_pop({c}), 6) AS kurt_pop FROM {tab}) s,
     (SELECT count(*) AS n_values, min(k) AS rarest, max(k) AS commonest, arg_max(k, x) AS n_at_max FROM (SELECT {c} AS x, count(*) AS k FROM {tab} GROUP BY 1)) v
""" for tab, c in [("lineitem", "l_quantity"), ("lineitem", "l_linenumber")]))
def uniform_shape(t: Tables) -> DataFrame:
    return rounded(D.uniform_shape(t("lineitem"), ["l_quantity", "l_linenumber"]))


@query("normal_shape", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS "column", n, round(sk, 6) AS skew_pop, round(ku, 6) AS kurt_pop, abs(sk) <= 0.25 AND abs(ku) <= 0.25 AS looks_normal
FROM (SELECT count({c}) AS n, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * CAST(count({c}) - 1 AS DOUBLE)) AS sk, kurtosis_pop({c}) AS ku FROM {tab})
""" for tab, c in [("(SELECT n_chars, ln(n_chars) AS log_chars FROM documents)", "n_chars"), ("(SELECT n_chars, ln(n_chars) AS log_chars FROM documents)", "log_chars")]))
def normal_shape(t: Tables) -> DataFrame:
    docs = t("documents").select("n_chars", F.ln("n_chars").alias("log_chars"))
    return rounded(D.normal_shape(docs, ["n_chars", "log_chars"]))


@query("event_time_check", sql="""
SELECT count(*) AS n_rows, true AS has_event, false AS has_time, count(DISTINCT toxic) AS event_values, CAST(0 AS BIGINT) AS time_values, false AS feasible FROM labels
""")
def event_time_check(t: Tables) -> DataFrame:
    return D.event_time_check(t("labels"), event="toxic", time=None)


@query("event_time_check_orders", sql="""
SELECT count(*) AS n_rows, true AS has_event, true AS has_time, count(DISTINCT cancelled) AS event_values, count(DISTINCT days) AS time_values,
       count(DISTINCT cancelled) = 2 AND count(DISTINCT days) > 1 AS feasible
FROM (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS cancelled, date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) AS days FROM orders)
""")
def event_time_check_orders(t: Tables) -> DataFrame:
    first = t("orders").agg(F.min("o_orderdate")).scalar()
    timed = t("orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("cancelled"), F.datediff("o_orderdate", first).alias("days"))
    return D.event_time_check(timed, event="cancelled", time="days")
