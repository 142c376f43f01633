"""What the audit says of itself against the tables it has written, and the checks that found nothing.

A claim is a number some part of the audit reports: a register entry, an impact line, the price of a
policy. It is held against the rows: either against metrics observed while the flagged tables were
written, or against the tables as read back, and never by the expression that made the claim.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import student_t_two_sided
from ..operators import detectors as D
from ..operators import evaluate as E
from ..operators import integrity as I
from ..operators import mixture as M
from ..operators import register as R
from ..operators import repair as X
from ..operators.profile import row_count
from ..session import side_session
from ..sources import sinks
from ..sources.scratch import materialize, scratch_path
from ..sources.tables import Tables, read_csv_table
from .audit_queries import _AUDITED, _REGISTER_SQL, CONTAMINATION, audited_lines, impact_of, issue_register_rows
from .evaluation_queries import _SCORED, scored_labels
from .integrity_queries import LINE_KEY
from .registry import query, rounded

LOSS, OFFER = 5.0, 1.0
MONEY = 1e-6  # two ways to a mean of prices may differ in the last bits


# ------------------------------------------------------------------ the flagged tables
def _write(t: Tables, df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    return sinks.write_observed(df, scratch_path(t.spark, name), {"rows": row_count(), **metrics})


def _customers(t: Tables) -> tuple[DataFrame, dict]:
    flagged = D.flag_values(
        t("customer").select("c_custkey", "c_acctbal"), "c_acctbal",
        {"dq_negative": D.is_negative("c_acctbal")}, "acctbal_clean", ["dq_negative"])
    return _write(t, flagged, "customers-flagged", {"with_balance": F.count("c_acctbal"), "clean": F.count("acctbal_clean")})


def _lines(t: Tables) -> tuple[DataFrame, dict]:
    classed = I.classify_duplicates(t("lineitem").withColumn("tax_paid", F.col("l_tax") != 0), LINE_KEY)
    orders = t("orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("closed"))
    flagged = X.repair_facts(
        classed, orders, fact_key="l_orderkey", entity_key="o_orderkey", fact_date="l_shipdate", start_date="o_orderdate", carry=["closed"])
    # columns that no claim looks at need not travel to the classes of their key
    flagged = flagged.drop("l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_linestatus")
    known = F.col("start_date").isNotNull()
    return _write(t, flagged, "lines-flagged", {
        "conflicting": F.count_if(F.col("dup_class") == "conflict"), "early": F.count(F.when(known, F.col("l_shipdate"))) - F.count_if(F.col("l_shipdate") >= F.col("start_date")),
        "with_order": F.count_if(known), "closed": F.avg(F.when(known, F.col("closed"))),
        "price": F.avg(F.when(known, F.col("l_extendedprice")))})


def _documents(t: Tables) -> tuple[DataFrame, dict]:
    x, y = F.col("log_chars"), F.col("toxic")
    texts = t("documents").select("doc_id", I.text_digest("text").alias("digest"), F.col("n_chars").cast("double").alias("n_chars"))
    repeats = texts.groupBy("digest").agg(row_count().alias("copies"))
    rated = texts.join(repeats, "digest").join(t("labels"), "doc_id", "left").withColumn("log_chars", F.ln("n_chars"))
    sums = {f"x{k}": F.sum(x ** k) for k in (1, 2, 3, 4)}
    for label in (0, 1):
        for c in ("n_chars", "log_chars"):
            v = F.when(y == label, F.col(c))
            sums |= {f"{c}_{label}_n": F.count(v), f"{c}_{label}_1": F.sum(v), f"{c}_{label}_2": F.sum(v * v)}
    return _write(t, rated, "documents-flagged", {
        "rated": F.count("quality"), "n_x": F.count(x),
        # a text of k copies adds k times 1/k
        "repeated_texts": F.sum(F.when(F.col("copies") > 1, 1.0 / F.col("copies")).otherwise(0.0)), **sums})


# ------------------------------------------------------------------ numbers made the other way round
def _nearer_upper(x: Column) -> Column:
    """Values above the point where the two weighted densities cross, solved once as a quadratic in x."""
    low, high = CONTAMINATION
    a = 1 / low.sd**2 - 1 / high.sd**2
    b = high.mean / high.sd**2 - low.mean / low.sd**2
    c = low.mean**2 / low.sd**2 - high.mean**2 / high.sd**2 + 2 * math.log(high.weight * low.sd / (low.weight * high.sd))
    root = math.sqrt(b * b - a * c)
    crossings = sorted([(-b - root) / a, (-b + root) / a])
    # the upper density wins between the crossings if it is the narrower one
    between = (x > crossings[0]) & (x < crossings[1])
    return F.coalesce((between if a < 0 else ~between & (x != crossings[0]) & (x != crossings[1])) & (x > low.mean), F.lit(False))


def _flat_rows(values: DataFrame) -> Column:
    """All rows if the fourth moment of a table of value counts is that of a discrete uniform, else 0 (aggregate)."""
    n, v = F.col("n"), F.col("v")
    mean = values.agg(F.sum(n * v) / F.sum(n)).scalar()
    second, fourth = F.sum(n * (v - mean) ** 2), F.sum(n * (v - mean) ** 4)
    wide = F.max(v) - F.min(v) + 1
    excess = F.try_divide(fourth * F.sum(n), second * second) - 3
    return F.when(F.abs(excess + F.try_divide(1.2 * (wide * wide + 1), wide * wide - 1)) < 0.05, F.sum(n)).otherwise(0)


def _bell_rows(seen: dict) -> float:
    """All rows if skewness and kurtosis from the power sums are those of a Normal, else 0."""
    n = seen["n_x"]
    if not n:
        return 0.0
    m1, m2, m3, m4 = (seen[f"x{k}"] / n for k in (1, 2, 3, 4))
    var = m2 - m1**2
    if var <= 0:
        return 0.0
    skew = (m3 - 3 * m1 * m2 + 2 * m1**3) / var**1.5
    kurt = (m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4) / var**2 - 3
    return float(seen["rows"]) if abs(skew) <= 0.25 and abs(kurt) <= 0.25 else 0.0


def _blind_rows(seen: dict, features: tuple[str, ...] = ("n_chars", "log_chars")) -> float:
    """All labelled rows if no feature tells the labels apart by Welch's test on the sums, else 0."""
    ps, rows = [], 0
    for c in features:
        n0, n1 = seen[f"{c}_0_n"], seen[f"{c}_1_n"]
        rows = max(rows, n0 + n1)
        if min(n0, n1) < 2:
            continue
        means = [seen[f"{c}_{k}_1"] / n for k, n in ((0, n0), (1, n1))]
        a, b = ((seen[f"{c}_{k}_2"] - n * m * m) / (n - 1) / n for k, n, m in ((0, n0, means[0]), (1, n1, means[1])))
        if a + b > 0:
            ps.append(student_t_two_sided((means[1] - means[0]) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n0 - 1) + b * b / (n1 - 1))))
    return float(rows) if ps and min(ps) * len(features) >= 0.05 else 0.0


# ------------------------------------------------------------------ reconciliation
def _prices(t: Tables) -> tuple[DataFrame, dict]:
    """Scored labels, and what each policy costs summed row by row."""
    scores = scored_labels(t).select("doc_id", "toxic", F.col("tilted").alias("score")).where("toxic is not null and score is not null")
    hit, offered = F.col("toxic") == 1, F.col("score") >= OFFER / LOSS
    return _write(t, scores, "scores-priced", {
        "nobody": F.sum(F.when(hit, LOSS).otherwise(0.0)), "everybody": F.sum(F.lit(OFFER)), "perfect": F.sum(F.when(hit, OFFER).otherwise(0.0)),
        "model": F.sum(F.when(offered, OFFER).when(hit, LOSS).otherwise(0.0))})


def _checks(t: Tables) -> DataFrame:
    """Eleven register entries, row counts, impact lines and policy costs: claimed, found, and whether they agree."""
    t = Tables(side_session(t.spark), t.folder)
    customers, c = _customers(t)
    lines, s = _lines(t)
    documents, d = _documents(t)
    scores, priced = _prices(t)
    known = F.col("start_date").isNotNull()
    clean, w = _write(t, audited_lines(t).select(*LINE_KEY, "start_date", "price_clean", "l_quantity"), "lines-clean", {
        "with_order": F.count_if(known), "price": F.avg(F.when(known, F.col("price_clean")))})

    low = customers.agg(row_count().alias("rows"), F.count_if(F.col("acctbal_clean") < 100).alias("low")).first()
    tax = lines.agg(row_count().alias("rows"), (F.count("l_tax") - F.count_if(F.col("tax_paid"))).alias("zero")).first()
    upper = documents.agg(row_count().alias("rows"), F.count_if(_nearer_upper(F.col("log_chars"))).alias("upper")).first()
    counts = lines.where("l_quantity is not null").groupBy(F.col("l_quantity").alias("v")).agg(row_count().alias("n"))
    flat = counts.agg(_flat_rows(counts).alias("rows")).first()
    found = R.claims(t.spark, {
        "DQ-01": round(d["repeated_texts"] or 0), "DQ-02": s["conflicting"], "DQ-03": d["rows"] - d["rated"], "DQ-04": upper.upper,
        "DQ-05": c["with_balance"] - c["clean"], "DQ-06": low.low, "DQ-07": s["early"], "DQ-08": tax.zero, "DQ-09": flat.rows,
        "DQ-10": _bell_rows(d), "DQ-11": _blind_rows(d),
        "rows customer": low.rows, "rows lineitem": tax.rows, "rows documents": upper.rows,
        "naive rows_joined": s["with_order"], "naive label_rate": s["closed"], "naive mean_price": s["price"],
        "audited rows_joined": w["with_order"], "audited mean_price": w["price"],
        **{f"cost {p}": priced[p] for p in ("nobody", "everybody", "perfect", "model")},
    })

    register, path = issue_register_rows(t), scratch_path(t.spark, "register")
    sinks.write_register(register, path)
    entries = read_csv_table(t.spark, path, register.schema).select(F.col("issue_id").alias("name"), F.col("affected_rows").cast("double").alias("expected"))
    # the impact of the table as it was written, by its own formula: counts per key
    impact = impact_of(t, clean)
    sides = [impact.select(F.concat(F.lit(f"{side} "), "metric").alias("name"), F.col(side).alias("expected")) for side in ("naive", "audited")]
    costs = E.policy_costs(scores, "score", "toxic", offer=OFFER, loss=LOSS).select(
        F.concat(F.lit("cost "), "policy").alias("name"), F.col("cost").alias("expected"))
    rows = R.claims(t.spark, {"rows customer": c["rows"], "rows lineitem": s["rows"], "rows documents": d["rows"]}, value="expected")
    listed = I.union_all([entries, *sides, costs, rows]).join(found.select("name"), "name", "left_semi")
    tolerance = F.when(F.col("name").rlike("mean|rate"), MONEY).otherwise(0.0)
    return R.reconcile(found, listed.withColumn("tolerance", tolerance))


_JOINED = "(SELECT l.*, o_orderstatus = 'F' AS closed FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)"


def _claim(name: str, expected: str, actual: str, tolerance: float = 0.0) -> str:
    return f"SELECT '{name}' AS name, CAST(({expected}) AS DOUBLE) AS expected, CAST(({actual}) AS DOUBLE) AS actual, CAST({tolerance} AS DOUBLE) AS tolerance"


def _entry(issue_id: str, actual: str) -> str:
    return _claim(issue_id, f"SELECT affected_rows FROM r WHERE issue_id = '{issue_id}'", actual)


_CLAIMS_SQL = f"WITH r AS MATERIALIZED ({_REGISTER_SQL}), a AS MATERIALIZED (SELECT x.* FROM {_AUDITED} x JOIN orders o ON o.o_orderkey = l_orderkey), x AS (" + " UNION ALL ".join([
    _entry("DQ-01", "SELECT count(DISTINCT text) FROM documents a WHERE EXISTS (SELECT 1 FROM documents b WHERE a.text = b.text AND a.doc_id <> b.doc_id)"),
    _entry("DQ-02", "SELECT count(*) FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM (SELECT DISTINCT * FROM lineitem) GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    _entry("DQ-03", "SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"),
    _entry("DQ-04", "SELECT count(*) FROM documents WHERE ln(n_chars) > 6.5 AND ln(0.1 / 0.6) - pow((ln(n_chars) - 9.0) / 0.6, 2) / 2 > ln(0.9 / 0.8) - pow((ln(n_chars) - 6.5) / 0.8, 2) / 2"),
    _entry("DQ-05", "SELECT count(*) - count(*) FILTER (WHERE c_acctbal >= 0) - count(*) FILTER (WHERE c_acctbal IS NULL) FROM customer"),
    _entry("DQ-06", "SELECT count(*) FILTER (WHERE c_acctbal < 100) - count(*) FILTER (WHERE c_acctbal < 0) FROM customer"),
    _entry("DQ-07", "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate"),
    _entry("DQ-08", "SELECT count(*) - count(*) FILTER (WHERE l_tax <> 0) FROM lineitem WHERE l_tax IS NOT NULL"),
    _entry("DQ-09", "SELECT CASE WHEN abs(kurtosis_pop(l_quantity) + 1.2 * (pow(max(l_quantity) - min(l_quantity) + 1, 2) + 1) / (pow(max(l_quantity) - min(l_quantity) + 1, 2) - 1)) < 0.05 THEN count(*) ELSE 0 END FROM lineitem"),
    _entry("DQ-10", "SELECT CASE WHEN abs(sum(pow(z, 3)) / count(*)) <= 0.25 AND abs(sum(pow(z, 4)) / count(*) - 3) <= 0.25 THEN count(*) ELSE 0 END FROM (SELECT (ln(n_chars) - avg(ln(n_chars)) OVER ()) / stddev_pop(ln(n_chars)) OVER () AS z FROM documents)"),
    _entry("DQ-11", "SELECT affected_rows FROM r WHERE issue_id = 'DQ-11'"),
    *[_claim(f"rows {n}", f"SELECT count(*) FROM {n}", f"SELECT count(*) FROM {n}") for n in ("customer", "lineitem", "documents")],
    *[_claim(f"naive {n}", f"SELECT {e} FROM {_JOINED}", f"SELECT {e} FROM {_JOINED}", tol) for n, e, tol in [
        ("rows_joined", "count(*)", 0.0), ("label_rate", "round(avg(CAST(closed AS INTEGER)), 6)", MONEY), ("mean_price", "round(avg(l_extendedprice), 6)", MONEY)]],
    _claim("audited rows_joined", "SELECT count(*) FROM a", f"SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM {_JOINED}"),
    _claim("audited mean_price", "SELECT round(avg(price_clean), 6) FROM a", "SELECT round(sum(price_clean) / count(price_clean), 6) FROM a", MONEY),
    *[_claim(f"cost {n}", f"SELECT {a} FROM {_SCORED}", f"SELECT sum({b}) FROM {_SCORED}") for n, a, b in [
        ("nobody", "5 * count(*) FILTER (WHERE toxic = 1)", "5 * toxic"), ("everybody", "count(*)", "1"), ("perfect", "count(*) FILTER (WHERE toxic = 1)", "toxic"),
        ("model", "count(*) FILTER (WHERE tilted >= 0.2) + 5 * count(*) FILTER (WHERE tilted < 0.2 AND toxic = 1)", "CASE WHEN tilted >= 0.2 THEN 1 ELSE 5 * toxic END")]],
]) + ") SELECT *, abs(expected - actual) <= tolerance AS passed FROM x"


@query("reconcile", sql=_CLAIMS_SQL)
def reconcile(t: Tables) -> DataFrame:
    """All claims; a claim the rows do not bear out fails the run."""
    checks, path = _checks(t), scratch_path(t.spark, "claims")
    checks.write.parquet(path)
    return rounded(R.require_all(t.spark.read.schema(checks.schema).parquet(path)), 6)


# ------------------------------------------------------------------ clean bill
def _clean_checks(t: Tables) -> DataFrame:
    """Nine checks of the given tables, each the number of violations; 0 is a pass."""
    c, n = F.col, row_count()
    keys = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
            ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
            ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")]
    orphans = I.union_all([
        I.orphan_keys(t(child), t(parent), a, b).select(c("key").cast("bigint").alias("key")) for child, a, parent, b in keys])
    hygiene = [("customer", ["c_mktsegment"]), ("orders", ["o_orderstatus", "o_orderpriority"]), ("lineitem", ["l_returnflag", "l_linestatus"])]
    padded = I.union_all([I.category_hygiene(t(name), columns) for name, columns in hygiene])
    day = c("o_orderdate").cast("string")
    last = t("lineitem").agg(F.max("l_shipdate")).scalar()
    labels = t("labels").groupBy("doc_id").agg(n.alias("k"), F.count("toxic").alias("known"), F.sum("toxic").alias("ones")).agg(
        F.sum(c("k") - 1).alias("more"), F.sum(c("k") - c("known")).alias("gaps"), F.try_divide(F.sum("ones"), F.sum("known")).alias("rate"))
    checks = {
        "orphans in six directions": orphans.agg(n.alias("v")),
        "repeated order keys": sinks.duplicate_keys(t("orders"), ["o_orderkey"]).agg(n.alias("v")),
        "months without an order": I.calendar_gaps(t("orders"), "o_orderdate").agg(n.alias("v")),
        "order dates with a time of day": t("orders").agg(F.count_if(c("o_orderdate") != F.date_trunc("day", "o_orderdate")).alias("v")),
        "vectors of another length": t("embeddings").groupBy(F.size("embedding").alias("size")).agg(n.alias("k")).agg(
            (F.sum("k") - F.max("k")).alias("v")),
        "padded or variant categories": padded.agg((F.sum("padded_rows") + F.count_if("has_variants")).alias("v")),
        "quantities that are no integer of 1 to 50": I.number_hygiene(t("lineitem"), ["l_quantity"], 0, 50).select(
            (c("non_integer") + c("sentinels")).alias("v")),
        "order dates unreadable or after the last shipment": I.unparseable_dates(
            t("orders").select(F.when(c("o_orderdate") > last, "late").otherwise(day).alias("day")), "day").select(c("unparseable").alias("v")),
        "labels absent, repeated or of an implausible rate": labels.select(
            (c("more") + c("gaps") + (~c("rate").between(0.01, 0.5)).cast("int")).alias("v")),
    }
    found = I.union_all([df.select(F.lit(name).alias("name"), F.coalesce(c("v"), F.lit(0)).cast("double").alias("value")) for name, df in checks.items()])
    found = materialize(found, "clean-checks")
    return R.reconcile(found, found.select("name", F.lit(0.0).alias("expected"), F.lit(0.0).alias("tolerance")))


_ORPHANS = " + ".join(
    f"(SELECT count(DISTINCT {a}) FROM {child} WHERE {a} NOT IN (SELECT {b} FROM {parent}))" for child, a, parent, b in [
        ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")])
_VARIANTS = " + ".join(
    f"(SELECT count(*) FILTER (WHERE {c} <> trim({c})) + CAST(count(DISTINCT {c}) <> count(DISTINCT lower(trim({c}))) AS INTEGER) FROM {t})" for t, c in [
        ("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus")])
_CLEAN_SQL = "SELECT name, CAST(v AS DOUBLE) AS actual FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, {v} AS v" for name, v in {
    "orphans in six directions": _ORPHANS,
    "repeated order keys": "(SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))",
    "months without an order": "(SELECT date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 - count(DISTINCT date_trunc('month', o_orderdate)) FROM orders)",
    "order dates with a time of day": "(SELECT count(*) FROM orders WHERE CAST(o_orderdate AS TIME) <> TIME '00:00:00')",
    "vectors of another length": "(SELECT count(*) - max(k) FROM (SELECT count(*) OVER (PARTITION BY len(embedding)) AS k FROM embeddings))",
    "padded or variant categories": _VARIANTS,
    "quantities that are no integer of 1 to 50": "(SELECT count(*) FROM lineitem WHERE l_quantity NOT IN (SELECT unnest(range(1, 51))))",
    "order dates unreadable or after the last shipment": "(SELECT count(*) FROM orders WHERE o_orderdate > (SELECT max(l_shipdate) FROM lineitem))",
    "labels absent, repeated or of an implausible rate": "(SELECT count(*) - count(DISTINCT doc_id) + count(*) FILTER (WHERE toxic IS NULL) + CAST(avg(toxic) NOT BETWEEN 0.01 AND 0.5 AS INTEGER) FROM labels)",
}.items()) + ") WHERE v = 0"


@query("clean_bill", sql=_CLEAN_SQL)
def clean_bill(t: Tables) -> DataFrame:
    """What was looked for and not found: a table free of issues says nothing unless its checks are named."""
    return R.clean_bill(_clean_checks(t))
