"""The audit end to end: repaired tables, issue register, impact and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import norm_cdf
from ..operators import detectors as D
from ..operators import integrity as I
from ..operators import mixture as M
from ..operators import register as R
from ..operators import repair as X
from ..operators import statistics as S
from ..operators.profile import row_count
from ..sources import sinks
from ..sources.scratch import scratch_path
from ..sources.tables import Tables, malformed_cells, read_csv_cells, read_csv_table, read_summary
from . import sqltext
from .integrity_queries import _LINE_ORDER, LINE_KEY
from .registry import query, rounded

PRICE_CAP = 104000.0
CONTAMINATION = (M.Component(0.9, 6.5, 0.8), M.Component(0.1, 9.0, 0.6))


def audited_lines(t: Tables, *, impute: Sequence[str] = ()) -> DataFrame:
    """Order lines, one per key, with every defect behind a flag; ``impute`` names columns whose gaps are filled beside them."""
    first = X.repair_entities(
        t("lineitem"), LINE_KEY, order_by=["l_shipdate"],
        flags={"dq_price_high": F.col("l_extendedprice") > PRICE_CAP, "dq_tax_zero": F.col("l_tax") == 0},
        clean={"price_clean": ("l_extendedprice", ["dq_price_high"])}, impute=impute,
    )
    return X.repair_facts(
        first, t("orders").select("o_orderkey", "o_orderdate"),
        fact_key="l_orderkey", entity_key="o_orderkey", fact_date="l_shipdate", start_date="o_orderdate")


_AUDITED = f"""(
  SELECT f.*, l_extendedprice > {PRICE_CAP} AS dq_price_high, l_tax = 0 AS dq_tax_zero,
         CASE WHEN l_extendedprice > {PRICE_CAP} THEN NULL ELSE l_extendedprice END AS price_clean, o_orderdate,
         coalesce(l_shipdate < o_orderdate, false) AS dq_before_start
  FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS variants,
               row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn FROM (SELECT DISTINCT * FROM lineitem)) f
  LEFT JOIN orders ON o_orderkey = l_orderkey WHERE rn = 1)"""


@query("repaired_facts", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, variants > 1 AS dq_dup_conflict, dq_price_high, dq_tax_zero, price_clean, dq_before_start FROM {_AUDITED}
""")
def repaired_facts(t: Tables) -> DataFrame:
    return audited_lines(t).select(
        *LINE_KEY, "l_partkey", "dq_dup_conflict", "dq_price_high", "dq_tax_zero", "price_clean", "dq_before_start")


@query("repaired_panel_rows", sql="""
WITH s AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id, coalesce(ts < start, false) AS dq_before_start, value <= 0.05 AS dq_value_floor, coalesce(n_signups > 1, false) AS dq_dup_conflict
FROM events e LEFT JOIN s ON e.user_id = s.user_id
LEFT JOIN (SELECT user_id, count(*) AS n_signups FROM events WHERE event_type = 'signup' GROUP BY 1) n ON n.user_id = e.user_id
""")
def repaired_panel_rows(t: Tables) -> DataFrame:
    signups = t("events").where("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("ts").alias("start_ts"))
    entity = I.keep_first(signups, ["u"], ["start_ts"])
    fixed = X.repair_facts(
        t("events"), entity, fact_key="user_id", entity_key="u", fact_date="ts", start_date="start_ts",
        flags={"dq_value_floor": F.col("value") <= 0.05}, carry=["dq_dup_conflict"])
    return fixed.select(
        "event_id", "dq_before_start", "dq_value_floor", F.coalesce("dq_dup_conflict", F.lit(False)).alias("dq_dup_conflict"))


@query("impact_naive_audited", sql=f"""
WITH n AS (SELECT count(*) AS rows_joined, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS label_rate, avg(l_extendedprice) AS price, avg(l_quantity) AS quantity
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
     a AS (SELECT count(*) AS rows_joined, avg(CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS label_rate, avg(price_clean) AS price, avg(l_quantity) AS quantity
           FROM {_AUDITED} x JOIN orders o ON l_orderkey = o.o_orderkey)
SELECT 'rows_joined' AS metric, CAST(n.rows_joined AS DOUBLE) AS naive, CAST(a.rows_joined AS DOUBLE) AS audited, CAST(a.rows_joined - n.rows_joined AS DOUBLE) AS change FROM n, a
UNION ALL SELECT 'label_rate', round(n.label_rate, 6), round(a.label_rate, 6), round(a.label_rate - n.label_rate, 6) FROM n, a
UNION ALL SELECT 'mean_price', round(n.price, 6), round(a.price, 6), round(a.price - n.price, 6) FROM n, a
UNION ALL SELECT 'mean_quantity', round(n.quantity, 6), round(a.quantity, 6), round(a.quantity - n.quantity, 6) FROM n, a
""")
def impact_naive_audited(t: Tables) -> DataFrame:
    return impact_of(t, audited_lines(t))


def impact_of(t: Tables, audited: DataFrame) -> DataFrame:
    """The impact on prices and quantities of these audited lines."""
    return rounded(_impact(t, audited, {"price": ("l_extendedprice", "price_clean"), "quantity": ("l_quantity", "l_quantity")}))


def _impact(t: Tables, audited: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    labels = t("orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("closed"))
    return X.impact(t("lineitem"), audited, labels, key="l_orderkey", label_key="o_orderkey", label="closed", metrics=metrics)


@query("impact_filled", sql=f"""
WITH n AS (SELECT count(*) AS rows_joined, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS label_rate, avg(l_extendedprice) AS price
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
     a AS (SELECT count(*) AS rows_joined, avg(CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS label_rate,
                  avg(coalesce(price_clean, (SELECT median(price_clean) FROM {_AUDITED}))) AS price
           FROM {_AUDITED} x JOIN orders o ON l_orderkey = o.o_orderkey)
SELECT 'rows_joined' AS metric, CAST(n.rows_joined AS DOUBLE) AS naive, CAST(a.rows_joined AS DOUBLE) AS audited, CAST(a.rows_joined - n.rows_joined AS DOUBLE) AS change FROM n, a
UNION ALL SELECT 'label_rate', round(n.label_rate, 6), round(a.label_rate, 6), round(a.label_rate - n.label_rate, 6) FROM n, a
UNION ALL SELECT 'mean_filled_price', round(n.price, 6), round(a.price, 6), round(a.price - n.price, 6) FROM n, a
""")
def impact_filled(t: Tables) -> DataFrame:
    """The impact on prices when the median of the clean ones stands in for those taken out."""
    return rounded(_impact(t, audited_lines(t, impute=["price_clean"]), {"filled_price": ("l_extendedprice", "price_clean_imputed")}))


_FLAGS = ["dq_dup_conflict", "dq_price_high", "dq_tax_zero", "dq_before_start"]


@query("flag_counts", sql=" UNION ALL ".join(
    f"SELECT '{f}' AS \"column\", count(*) FILTER (WHERE {e}) AS n_rows, count(*) AS total_rows FROM {_AUDITED}"
    for f, e in [("dq_dup_conflict", "variants > 1"), ("dq_price_high", "dq_price_high"), ("dq_tax_zero", "dq_tax_zero"),
                 ("dq_before_start", "dq_before_start"), ("price_clean", "price_clean IS NULL")]))
def flag_counts(t: Tables) -> DataFrame:
    return X.flag_counts(audited_lines(t), _FLAGS, ["price_clean"])


# ------------------------------------------------------------------ register
# The scales of severity and resolution.
SEVERITIES = ("Critical", "High", "Medium", "Low")
RESOLUTIONS = ("auto-fixed", "auto-fixed-with-flag", "flagged-for-review", "informational")

# What each entry is about and what this library does with the rows it counts.
ENTRIES = {
    "DQ-01": ("documents", "text", "Texts stored in several rows", "High",
              "dup_keep_first_texts leaves the row with the smallest doc_id", "auto-fixed"),
    "DQ-02": ("lineitem", "l_orderkey, l_linenumber", "Order lines that disagree on one order and line number", "High",
              "repaired_facts leaves the earliest shipment, with dq_dup_conflict set", "flagged-for-review"),
    "DQ-03": ("documents x labels", "quality", "Documents nobody has rated", "High",
              "The document stays unrated; fills come with an indicator column", "auto-fixed-with-flag"),
    "DQ-04": ("documents", "n_chars", "Lengths nearer to the upper of two modes", "High",
              "mixture_flags names the documents; the length stands", "flagged-for-review"),
    "DQ-05": ("customer", "c_acctbal", "Balances in debt", "High",
              "clean_column empties a copy of the balance, negative_flags names the customer", "auto-fixed-with-flag"),
    "DQ-06": ("customer", "c_acctbal", "Balances from 0 to below 100", "Medium",
              "low_flags names the customer; the balance stands", "flagged-for-review"),
    "DQ-07": ("lineitem x orders", "l_shipdate vs o_orderdate", "Shipments earlier than the order they belong to", "High",
              "dq_before_start is set on the line; days between the two dates are negative there", "flagged-for-review"),
    "DQ-08": ("lineitem", "l_tax", "Tax piled up on zero and never below", "Low",
              "dq_tax_zero is set on the line; the tax stands", "flagged-for-review"),
    "DQ-09": ("lineitem", "l_quantity", "Quantities as flat as drawn lots", "Medium",
              "uniform_shape reports it; no row changes", "informational"),
    "DQ-10": ("documents", "log n_chars", "Log lengths shaped like a bell", "Medium",
              "normal_shape reports it; no row changes", "informational"),
    "DQ-11": ("labels", "toxic", "Length tells toxic documents from others in no test", "Critical",
              "label_signal has to find a signal before scores are used", "informational"),
}


def _entry(issue_id: str, affected: Column, total: Column, evidence: Column) -> Column:
    table, fields, issue, severity, rule, resolution = ENTRIES[issue_id]
    return R.issue(issue_id=issue_id, table=table, fields=fields, issue=issue, severity=severity, rule=rule,
                   resolution=resolution, affected=affected, total=total, evidence=evidence)


def issue_register_rows(t: Tables) -> DataFrame:
    """Eleven rules over the given tables; rules on one table read the same aggregate."""
    c = F.col

    def some(flag: Column) -> Column:
        return F.count_if(flag)

    def count_text(bad: str, n: str) -> Column:
        return F.format_string("%d of %d rows", c(bad), c(n))

    texts = t("documents").groupBy(I.text_digest("text")).agg(row_count().alias("k")).agg(
        row_count().alias("keys"), some(c("k") > 1).alias("bad"), F.sum("k").alias("n"))
    lines = I.key_classes(t("lineitem"), LINE_KEY).agg(
        some(c("dup_class") == "conflict").alias("bad_keys"), F.sum("n_rows").alias("n"),
        F.coalesce(F.sum(F.when(c("dup_class") == "conflict", c("n_rows"))), F.lit(0)).alias("bad"))
    gaps = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").agg(
        row_count().alias("n"), some(c("quality").isNull()).alias("bad"))
    log_chars = t("documents").select(F.ln("n_chars").alias("x")).agg(
        row_count().alias("n"), some(M.is_contaminated("x", M.Mixture(0, 0.0, CONTAMINATION))).alias("bad"),
        F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
    balance = t("customer").agg(
        row_count().alias("n"), some(D.is_negative("c_acctbal")).alias("negative"), F.min("c_acctbal").alias("lowest"),
        some(D.is_implausibly_low("c_acctbal", 100.0)).alias("low"))
    early = I.before_start_summary(I.flag_before_start(
        I.date_counts(t("lineitem"), "l_orderkey", "l_shipdate"), t("orders").select("o_orderkey", "o_orderdate"),
        fact_key="l_orderkey", entity_key="o_orderkey", fact_date="l_shipdate", start_date="o_orderdate"), "l_orderkey", weight="n_rows")
    values = t("lineitem").agg(
        row_count().alias("n"), some(c("l_tax") == 0).alias("at_zero"), some(c("l_tax") < 0).alias("below_zero"),
        F.avg("l_tax").alias("mu"), F.stddev_samp("l_tax").alias("sd"), F.avg("l_quantity").alias("mean"),
        F.kurtosis("l_quantity").alias("kurt"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    span2 = (c("hi") - c("lo") + 1) * (c("hi") - c("lo") + 1)
    values = values.withColumn("expected_below", norm_cdf(F.try_divide(-c("mu"), c("sd"))) * c("n")).withColumn(
        "flat_kurt", F.try_divide(-1.2 * (span2 + 1), span2 - 1))
    labelled = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id").withColumn("log_chars", F.ln("n_chars"))
    tests = S.welch_tests(labelled, ["n_chars", "log_chars"], "toxic").agg(
        F.max(c("n0") + c("n1")).alias("n"), F.min("p").alias("p"), row_count().alias("k"))

    return R.build_register([
        R.register_rows(texts, [_entry("DQ-01", c("bad"), c("keys"), F.format_string(
            "%d rows for %d distinct texts; %d texts repeat", c("n"), c("keys"), c("bad")))]),
        R.register_rows(lines, [_entry("DQ-02", c("bad"), c("n"), F.format_string(
            "%d keys hold %d different rows", c("bad_keys"), c("bad")))]),
        R.register_rows(gaps, [_entry("DQ-03", c("bad"), c("n"), count_text("bad", "n"))]),
        R.register_rows(log_chars, [
            _entry("DQ-04", c("bad"), c("n"), count_text("bad", "n")),
            _entry("DQ-10", F.when((F.abs("skew") <= 0.25) & (F.abs("kurt") <= 0.25), c("n")).otherwise(0), c("n"),
                   F.format_string("skewness %.3f, kurtosis %.3f", c("skew"), c("kurt")))]),
        R.register_rows(balance, [
            _entry("DQ-05", c("negative"), c("n"), F.format_string("lowest %.2f", c("lowest"))),
            _entry("DQ-06", c("low"), c("n"), count_text("low", "n"))]),
        R.register_rows(early, [_entry("DQ-07", c("affected_rows"), c("n_rows"), F.format_string(
            "%d rows of %d orders, median %.1f and up to %d days", c("affected_rows"), c("affected_entities"), c("median_days"), c("max_days")))]),
        R.register_rows(values, [
            _entry("DQ-08", c("at_zero"), c("n"), F.format_string(
                "%d at 0, %d below; a Normal expects %.0f below", c("at_zero"), c("below_zero"), c("expected_below"))),
            _entry("DQ-09", F.when(F.abs(c("kurt") - c("flat_kurt")) < 0.05, c("n")).otherwise(0), c("n"), F.format_string(
                "mean %.3f vs %.3f, kurtosis %.3f vs %.3f", c("mean"), (c("lo") + c("hi")) / 2, c("kurt"), c("flat_kurt")))]),
        R.register_rows(tests, [_entry("DQ-11", F.when(c("p") * c("k") >= 0.05, c("n")).otherwise(0), c("n"), F.format_string(
            "smallest p %.3f in %d tests", c("p"), c("k")))]),
    ])


_LAB = "(SELECT CAST(n_chars AS DOUBLE) AS n_chars, ln(n_chars) AS log_chars, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _reg(iid, body):
    table, fields, issue, severity, rule, resolution = ENTRIES[iid]
    return (f"SELECT '{iid}' AS issue_id, '{table}' AS \"table\", '{fields}' AS fields, '{issue}' AS issue, CAST(bad AS BIGINT) AS affected_rows, "
            f"round(bad * 100.0 / total, 3) AS affected_pct, '{severity}' AS severity, evidence, '{rule}' AS rule, '{resolution}' AS resolution FROM ({body})")


_REGISTER_SQL = " UNION ALL ".join([
    _reg("DQ-01", "SELECT count(*) FILTER (WHERE c > 1) AS bad, count(*) AS total, printf('%d rows for %d distinct texts; %d texts repeat', CAST(sum(c) AS BIGINT), count(*), count(*) FILTER (WHERE c > 1)) AS evidence FROM (SELECT text, count(*) AS c FROM documents GROUP BY text)"),
    _reg("DQ-02", "SELECT coalesce(sum(c) FILTER (WHERE v > 1), 0) AS bad, sum(c) AS total, printf('%d keys hold %d different rows', count(*) FILTER (WHERE v > 1), CAST(coalesce(sum(c) FILTER (WHERE v > 1), 0) AS BIGINT)) AS evidence "
         "FROM (SELECT l_orderkey, l_linenumber, sum(c) AS c, count(*) AS v FROM (SELECT *, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1, 2)"),
    _reg("DQ-03", "SELECT count(*) FILTER (WHERE quality IS NULL) AS bad, count(*) AS total, printf('%d of %d rows', count(*) FILTER (WHERE quality IS NULL), count(*)) AS evidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    _reg("DQ-04", "SELECT count(*) FILTER (WHERE f) AS bad, count(*) AS total, printf('%d of %d rows', count(*) FILTER (WHERE f), count(*)) AS evidence FROM (SELECT 0.1 / 0.6 * exp(-pow((x - 9.0) / 0.6, 2) / 2) > 0.9 / 0.8 * exp(-pow((x - 6.5) / 0.8, 2) / 2) AND x > 6.5 AS f FROM (SELECT ln(n_chars) AS x FROM documents))"),
    _reg("DQ-05", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS bad, count(*) AS total, printf('lowest %.2f', min(c_acctbal)) AS evidence FROM customer"),
    _reg("DQ-06", "SELECT count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 100) AS bad, count(*) AS total, printf('%d of %d rows', count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 100), count(*)) AS evidence FROM customer"),
    _reg("DQ-07", "SELECT count(*) FILTER (WHERE b) AS bad, count(*) AS total, printf('%d rows of %d orders, median %.1f and up to %d days', count(*) FILTER (WHERE b), count(DISTINCT l_orderkey) FILTER (WHERE b), median(lag) FILTER (WHERE b), max(lag) FILTER (WHERE b)) AS evidence FROM (SELECT l_orderkey, l_shipdate < o_orderdate AS b, date_diff('day', l_shipdate, o_orderdate) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"),
    _reg("DQ-08", f"SELECT z AS bad, n AS total, printf('%d at 0, %d below; a Normal expects %.0f below', z, b, {sqltext.normal_cdf('-mu / sd')} * n) AS evidence FROM (SELECT count(*) FILTER (WHERE l_tax = 0) AS z, count(*) FILTER (WHERE l_tax < 0) AS b, count(*) AS n, avg(l_tax) AS mu, stddev_samp(l_tax) AS sd FROM lineitem)"),
    _reg("DQ-09", "SELECT CASE WHEN abs(k - u) < 0.05 THEN n ELSE 0 END AS bad, n AS total, printf('mean %.3f vs %.3f, kurtosis %.3f vs %.3f', m, (lo + hi) / 2, k, u) AS evidence FROM (SELECT *, -1.2 * (pow(hi - lo + 1, 2) + 1) / (pow(hi - lo + 1, 2) - 1) AS u FROM (SELECT count(*) AS n, avg(l_quantity) AS m, kurtosis_pop(l_quantity) AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem))"),
    _reg("DQ-10", "SELECT CASE WHEN abs(s) <= 0.25 AND abs(k) <= 0.25 THEN n ELSE 0 END AS bad, n AS total, printf('skewness %.3f, kurtosis %.3f', s, k) AS evidence FROM (SELECT count(*) AS n, skewness(ln(n_chars)) * (count(*) - 2) / sqrt(count(*) * CAST(count(*) - 1 AS DOUBLE)) AS s, kurtosis_pop(ln(n_chars)) AS k FROM documents)"),
    _reg("DQ-11", f"SELECT CASE WHEN p * k >= 0.05 THEN n ELSE 0 END AS bad, n AS total, printf('smallest p %.3f in %d tests', p, k) AS evidence FROM (SELECT min({sqltext.student_two_sided('t', 'dof')}) AS p, count(*) AS k, max(n0 + n1) AS n FROM (SELECT *, (m1 - m0) / sqrt(v0 / n0 + v1 / n1) AS t, pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)) AS dof FROM ("
         + " UNION ALL ".join(f"SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1, avg({c}) FILTER (WHERE toxic = 0) AS m0, avg({c}) FILTER (WHERE toxic = 1) AS m1, var_samp({c}) FILTER (WHERE toxic = 0) AS v0, var_samp({c}) FILTER (WHERE toxic = 1) AS v1 FROM {_LAB}" for c in ["n_chars", "log_chars"])
         + ")))"),
])


@query("issue_register", sql=_REGISTER_SQL)
def issue_register(t: Tables) -> DataFrame:
    return issue_register_rows(t)


@query("severity_rollup", sql=f"SELECT severity, count(*) AS issues, CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM ({_REGISTER_SQL}) GROUP BY 1")
def severity_rollup(t: Tables) -> DataFrame:
    return R.roll_up(issue_register_rows(t), "severity")


@query("resolution_rollup", sql=f"SELECT resolution, count(*) AS issues, CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM ({_REGISTER_SQL}) GROUP BY 1")
def resolution_rollup(t: Tables) -> DataFrame:
    return R.roll_up(issue_register_rows(t), "resolution")


# ------------------------------------------------------------------ sources and sinks
@query("csv_scan", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    sinks.write_table(t("customer"), path, fmt="csv")
    return read_csv_table(t.spark, path, t("customer").schema)


_SPOILED = """CASE WHEN c_custkey % 50 = 0 THEN 'n/a' WHEN c_custkey % 50 = 1 THEN 'NaN' WHEN c_custkey % 50 = 2 THEN NULL ELSE CAST(c_acctbal AS {text}) END"""


@query("csv_malformed_cells", sql="""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 50 = 0) AS bad, count(*) FILTER (WHERE c_custkey % 50 = 1) AS nan, count(*) FILTER (WHERE c_custkey % 50 = 2) AS gone,
                  count(*) FILTER (WHERE c_custkey % 30 = 7) AS words FROM customer)
SELECT 'c_custkey' AS "column", n AS n_rows, 0::BIGINT AS empty, 0::BIGINT AS malformed, 0::BIGINT AS not_a_number, 0::BIGINT AS in_bad_rows, NULL AS first_bad FROM s
UNION ALL SELECT 'c_acctbal', n, gone, bad, nan, 0, CASE WHEN bad > 0 THEN 'n/a' END FROM s
UNION ALL SELECT 'c_nationkey', n, 0, words, 0, 0, CASE WHEN words > 0 THEN 'seven' END FROM s
""")
def csv_malformed_cells(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "spoiled-csv")
    spoiled = t("customer").select("c_custkey", F.expr(_SPOILED.format(text="string")).alias("c_acctbal"),
                                   F.expr("CASE WHEN c_custkey % 30 = 7 THEN 'seven' ELSE CAST(c_nationkey AS string) END").alias("c_nationkey"))
    sinks.write_table(spoiled, path, fmt="csv")
    declared = t("customer").select("c_custkey", "c_acctbal", "c_nationkey").schema
    return malformed_cells(read_csv_cells(t.spark, path, declared))


@query("results_by_run_date", sql="""
SELECT o_orderpriority, n, run_date FROM (
  SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate < '1998-01-01') AS n, '2024-01-31' AS run_date FROM orders GROUP BY 1
  UNION ALL SELECT o_orderpriority, count(*), '2024-02-29' FROM orders GROUP BY 1)
""")
def results_by_run_date(t: Tables) -> DataFrame:
    """Two runs, and a rerun of the second date over other rows: only that date's results are replaced."""
    path = scratch_path(t.spark, "results")
    early = F.count_if(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("n")
    first = t("orders").groupBy("o_orderpriority").agg(early)
    sinks.write_dated(first, path, "2024-01-31")
    sinks.write_dated(first, path, "2024-02-29")
    return sinks.write_dated(t("orders").groupBy("o_orderpriority").agg(row_count().alias("n")), path, "2024-02-29").select(
        "o_orderpriority", "n", F.col("run_date").cast("string"))


_CONFLICTS = "(SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) > 1 AS bad FROM lineitem GROUP BY 1, 2)"


def _routed(t: Tables) -> dict[str, DataFrame]:
    return sinks.write_routed(X.route_conflicts(t("lineitem"), LINE_KEY), scratch_path(t.spark, "routed-lines"))


@query("quarantined_keys", sql=f"SELECT l_orderkey, l_linenumber, n AS n_rows FROM {_CONFLICTS} WHERE bad")
def quarantined_keys(t: Tables) -> DataFrame:
    held = _routed(t).get(X.QUARANTINED)
    return (held if held is not None else X.route_conflicts(t("lineitem"), LINE_KEY).limit(0)).groupBy(*LINE_KEY).agg(row_count().alias("n_rows"))


@query("kept_rows", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM {_CONFLICTS} WHERE NOT bad)
""")
def kept_rows(t: Tables) -> DataFrame:
    """The routed table's other part; no key is in both, and none of its rows is lost (see routed_account)."""
    return _routed(t).get(X.KEPT, t("lineitem").limit(0)).select(*LINE_KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("routed_account", sql=f"""
SELECT CASE WHEN bad THEN 'quarantined' ELSE 'kept' END AS route, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, max(n) AS largest_key, (SELECT count(*) FROM lineitem) AS input_rows
FROM {_CONFLICTS} GROUP BY bad
""")
def routed_account(t: Tables) -> DataFrame:
    parts = [part.withColumn("route", F.lit(name)) for name, part in _routed(t).items()]
    account = X.routed_account(I.union_all(parts), LINE_KEY)
    return account.withColumn("input_rows", t("lineitem").agg(row_count()).scalar())


@query("partitioned_write", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders
""")
def partitioned_write(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders-by-year")
    sinks.write_table(t("orders").withColumn("order_year", F.year("o_orderdate")), path, partition_by=["order_year"])
    return t.spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "order_year")


@query("register_sink", sql=f"SELECT issue_id, severity, affected_rows FROM ({_REGISTER_SQL})")
def register_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "register")
    register = issue_register_rows(t)
    sinks.write_register(register, path)
    return read_csv_table(t.spark, path, register.schema).select("issue_id", "severity", "affected_rows")


@query("summary_sink", sql="""
SELECT count(*) AS n_rows, min(c_acctbal) AS lowest, max(c_acctbal) AS highest, count(*) FILTER (WHERE c_acctbal < 0) AS n_negative FROM customer
""")
def summary_sink(t: Tables) -> DataFrame:
    summary = t("customer").agg(
        row_count().alias("n_rows"),
        F.struct(F.min("c_acctbal").alias("lowest"), F.max("c_acctbal").alias("highest"), F.count_if(D.is_negative("c_acctbal")).alias("n_negative")).alias("balance"))
    path = scratch_path(t.spark, "summary")
    sinks.write_summary(summary, path)
    return read_summary(t.spark, path, summary.schema).select("n_rows", "balance.*")


@query("unique_after_write", sql="SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2")
def unique_after_write(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lines-clean")
    sinks.write_table(audited_lines(t), path)
    return sinks.assert_unique_key(t.spark, path, LINE_KEY).select(*LINE_KEY)


@query("repeated_keys", sql="SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    return sinks.duplicate_keys(t("lineitem"), LINE_KEY)
