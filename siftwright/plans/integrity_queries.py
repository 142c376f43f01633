"""Keys, duplicates and timelines of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators import profile as P
from ..sources.tables import Tables
from .registry import query, rounded

LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query("dup_classes", sql="""
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS r, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS v
           FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN r = 1 THEN 'unique' WHEN v = 1 THEN 'exact' ELSE 'conflict' END AS dup_class,
       count(*) AS n_keys, CAST(sum(r) AS BIGINT) AS n_rows, max(r) AS largest_group FROM g GROUP BY 1
""")
def dup_classes(t: Tables) -> DataFrame:
    return I.duplicate_summary(t("lineitem"), LINE_KEY)


@query("dup_classes_texts", sql="""
WITH g AS (SELECT text, count(*) AS r, count(DISTINCT (lang, source, n_chars)) AS v FROM documents GROUP BY text)
SELECT CASE WHEN r = 1 THEN 'unique' WHEN v = 1 THEN 'exact' ELSE 'conflict' END AS dup_class,
       count(*) AS n_keys, CAST(sum(r) AS BIGINT) AS n_rows, max(r) AS largest_group FROM g GROUP BY 1
""")
def dup_classes_texts(t: Tables) -> DataFrame:
    keyed = t("documents").select(I.text_digest("text").alias("digest"), "lang", "source", "n_chars")
    return I.duplicate_summary(keyed, ["digest"])


@query("dup_row_flags", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER w AS group_rows,
       CASE WHEN count(*) OVER w = 1 THEN 'unique'
            WHEN (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber)) = 1 THEN 'exact'
            ELSE 'conflict' END AS dup_class
FROM lineitem x WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)
""")
def dup_row_flags(t: Tables) -> DataFrame:
    flagged = I.classify_duplicates(t("lineitem"), LINE_KEY)
    return flagged.select(*LINE_KEY, "l_partkey", "l_suppkey", "group_rows", "dup_class")


@query("dup_keep_first", sql=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dup_rows,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dq_dup_conflict,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn
  FROM (SELECT DISTINCT * FROM lineitem)) WHERE rn = 1
""")
def dup_keep_first(t: Tables) -> DataFrame:
    first = I.keep_first(t("lineitem"), LINE_KEY, ["l_shipdate"])
    return first.select(
        *LINE_KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"), "dup_rows", "dq_dup_conflict",
    )


@query("dup_keep_first_texts", sql="""
SELECT text, arg_min(doc_id, doc_id) AS doc_id, count(*) AS dup_rows, count(*) > 1 AS dq_dup_conflict
FROM documents GROUP BY text
""")
def dup_keep_first_texts(t: Tables) -> DataFrame:
    # one digest and one id per text decide; the survivors' texts are fetched by id
    first = I.keep_first(t("documents").select(I.text_digest("text").alias("digest"), "doc_id"), ["digest"], ["doc_id"])
    return t("documents").select("text", "doc_id").join(first.drop("digest"), "doc_id")


_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("dup_diff_columns", sql=f"""
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n_rows,
  list_filter([{', '.join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' END" for c in _REST)}], lambda x: x IS NOT NULL) AS cols
  FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, n_rows, CAST(len(cols) AS BIGINT) AS n_differing, array_to_string(cols, ',') AS differing_columns
FROM g WHERE len(cols) > 0
""")
def dup_diff_columns(t: Tables) -> DataFrame:
    li = t("lineitem").select(*LINE_KEY, *_REST)
    return I.differing_columns(li, LINE_KEY)


@query("date_swap_pairs", sql="""
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem),
     s AS (SELECT DISTINCT x.l_orderkey, x.l_linenumber FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber
           AND x.d < y.d AND year(x.d) = year(y.d) AND month(x.d) = day(y.d) AND day(x.d) = month(y.d))
SELECT d.l_orderkey, d.l_linenumber, count(*) AS n_dates, strftime(min(d), '%Y-%m-%d') AS first_date, strftime(max(d), '%Y-%m-%d') AS last_date,
       bool_or(s.l_orderkey IS NOT NULL) AS has_swap
FROM d LEFT JOIN s ON s.l_orderkey = d.l_orderkey AND s.l_linenumber = d.l_linenumber GROUP BY 1, 2 HAVING count(*) > 1
""")
def date_swap_pairs(t: Tables) -> DataFrame:
    pairs = I.date_swap_pairs(t("lineitem"), LINE_KEY, "l_shipdate")
    return pairs.withColumn("first_date", F.col("first_date").cast("string")).withColumn(
        "last_date", F.col("last_date").cast("string"))


@query("orphan_keys", sql="""
SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def orphan_keys(t: Tables) -> DataFrame:
    return I.orphan_keys(t("documents"), t("labels"), "doc_id", "doc_id")


@query("key_set_equality", sql="""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer),
     s AS (SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS in_both,
                  (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS left_only,
                  (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS right_only)
SELECT *, left_only = 0 AND right_only = 0 AS equal_sets FROM s
""")
def key_set_equality(t: Tables) -> DataFrame:
    return I.key_set_equality(t("orders"), t("customer"), "o_custkey", "c_custkey")


@query("join_fan_out", sql="""
SELECT (SELECT count(*) FROM orders) AS rows_in, count(*) AS rows_out,
       round(count(*) / (SELECT count(*) FROM orders), 6) AS fan_out
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def join_fan_out(t: Tables) -> DataFrame:
    return rounded(I.fan_out(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey"))


def _lines_with_start(t: Tables) -> DataFrame:
    return I.flag_before_start(
        t("lineitem"), t("orders").select("o_orderkey", "o_orderdate"),
        fact_key="l_orderkey", entity_key="o_orderkey", fact_date="l_shipdate", start_date="o_orderdate",
    )


@query("before_start_rows", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
       l_shipdate < o_orderdate AS dq_before_start,
       CASE WHEN l_shipdate < o_orderdate THEN CAST(date_diff('day', l_shipdate, o_orderdate) AS INTEGER) END AS days_before_start
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def before_start_rows(t: Tables) -> DataFrame:
    return _lines_with_start(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
        "dq_before_start", "days_before_start")


@query("before_start_summary", sql="""
WITH j AS (SELECT l_orderkey, l_shipdate < o_orderdate AS bad, date_diff('day', l_shipdate, o_orderdate) AS lag
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE bad) AS affected_rows,
       count(DISTINCT l_orderkey) FILTER (WHERE bad) AS affected_entities, count(DISTINCT l_orderkey) AS entities,
       CAST(max(lag) FILTER (WHERE bad) AS INTEGER) AS max_days, median(lag) FILTER (WHERE bad) AS median_days,
       round(count(*) FILTER (WHERE bad) * 100 / count(*), 6) AS affected_pct FROM j
""")
def before_start_summary(t: Tables) -> DataFrame:
    flagged = I.flag_before_start(
        I.date_counts(t("lineitem"), "l_orderkey", "l_shipdate"), t("orders").select("o_orderkey", "o_orderdate"),
        fact_key="l_orderkey", entity_key="o_orderkey", fact_date="l_shipdate", start_date="o_orderdate")
    return rounded(I.before_start_summary(flagged, "l_orderkey", weight="n_rows"))


@query("before_start_by_month", sql="""
SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS flagged, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def before_start_by_month(t: Tables) -> DataFrame:
    return _lines_with_start(t).groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.count_if("dq_before_start").alias("flagged"), P.row_count().alias("n"))


@query("events_before_signup", sql="""
WITH s AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts < start) AS affected_rows,
       count(DISTINCT e.user_id) FILTER (WHERE ts < start) AS affected_entities, count(DISTINCT e.user_id) AS entities,
       CAST(max(date_diff('day', ts, start)) FILTER (WHERE ts < start) AS INTEGER) AS max_days,
       median(date_diff('day', ts, start)) FILTER (WHERE ts < start) AS median_days,
       round(count(*) FILTER (WHERE ts < start) * 100 / count(*), 6) AS affected_pct
FROM events e LEFT JOIN s ON e.user_id = s.user_id
""")
def events_before_signup(t: Tables) -> DataFrame:
    signup = t("events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("signup_ts"))
    flagged = I.flag_before_start(
        I.date_counts(t("events"), "user_id", "ts"), signup, fact_key="user_id", entity_key="u", fact_date="ts", start_date="signup_ts")
    return rounded(I.before_start_summary(flagged, "user_id", weight="n_rows"))


@query("calendar_gaps", sql="""
WITH p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
     f AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM p)
SELECT strftime(d, '%Y-%m-%d') AS period FROM f WHERE d NOT IN (SELECT d FROM p)
""")
def calendar_gaps(t: Tables) -> DataFrame:
    return I.calendar_gaps(t("orders"), "o_orderdate", "day").select(F.col("period").cast("string"))


@query("calendar_gaps_months", sql="""
WITH p AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM orders),
     f AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 MONTH)) AS DATE) AS d FROM p)
SELECT strftime(d, '%Y-%m-%d') AS period FROM f WHERE d NOT IN (SELECT d FROM p)
""")
def calendar_gaps_months(t: Tables) -> DataFrame:
    return I.calendar_gaps(t("orders"), "o_orderdate").select(F.col("period").cast("string"))


@query("grid_missing_cells", sql="""
WITH c AS (SELECT DISTINCT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem)
SELECT entity, strftime(period, '%Y-%m-%d') AS period FROM (
  SELECT e.entity, p.period FROM (SELECT DISTINCT entity FROM c) e, (SELECT DISTINCT period FROM c) p
  EXCEPT SELECT entity, period FROM c)
""")
def grid_missing_cells(t: Tables) -> DataFrame:
    cells = I.grid_missing_cells(t("lineitem"), "l_suppkey", "l_shipdate")
    return cells.select("entity", F.col("period").cast("string"))


@query("grid_missing_runs", sql="""
WITH c AS (SELECT DISTINCT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem),
     p AS (SELECT period, row_number() OVER (ORDER BY period) AS i FROM (SELECT DISTINCT period FROM c)),
     m AS (SELECT e.entity, p.period, p.i FROM (SELECT DISTINCT entity FROM c) e, p WHERE (e.entity, p.period) NOT IN (SELECT (entity, period) FROM c)),
     g AS (SELECT *, i - row_number() OVER (PARTITION BY entity ORDER BY i) AS island FROM m)
SELECT entity, strftime(min(period), '%Y-%m-%d') AS first_period, strftime(max(period), '%Y-%m-%d') AS last_period, count(*) AS n_periods FROM g GROUP BY entity, island
""")
def grid_missing_runs(t: Tables) -> DataFrame:
    return I.grid_missing_runs(t("lineitem"), "l_suppkey", "l_shipdate").select(
        "entity", F.col("first_period").cast("string"), F.col("last_period").cast("string"), "n_periods")


@query("grid_completeness", sql="""
WITH c AS (SELECT user_id AS e, CAST(ts AS DATE) AS p, count(*) AS n FROM events GROUP BY 1, 2),
     s AS (SELECT count(DISTINCT e) AS entities, count(DISTINCT p) AS periods, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n FROM c)
SELECT entities, periods, entities * periods AS cells_expected, cells AS cells_present,
       entities * periods - cells AS cells_missing, n - cells AS surplus_rows FROM s
""")
def grid_completeness(t: Tables) -> DataFrame:
    return I.grid_completeness(t("events"), "user_id", "ts", "day")


@query("period_hygiene", sql="""
WITH d AS (SELECT o_custkey AS e, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE d = last_day(d)) AS month_end_rows,
       count(*) FILTER (WHERE d = last_day(d)) = count(*) AS all_month_end,
       count(DISTINCT date_trunc('month', d)) AS months_present,
       CAST((year(max(d)) - year(min(d))) * 12 + month(max(d)) - month(min(d)) + 1 AS BIGINT) AS months_expected,
       count(*) - count(DISTINCT (e, d)) AS surplus_pairs FROM d
""")
def period_hygiene(t: Tables) -> DataFrame:
    return I.period_hygiene(t("orders"), "o_custkey", "o_orderdate")


@query("future_dated", sql="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 180 DAY) AS after_end FROM orders
""")
def future_dated(t: Tables) -> DataFrame:
    end = t("lineitem").agg(F.max("l_shipdate") - F.expr("interval 180 day")).scalar()
    return I.future_dated(t("orders"), "o_orderdate", end)


@query("distinct_rows", sql="SELECT DISTINCT lang, source, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def distinct_rows(t: Tables) -> DataFrame:
    joined = t("documents").join(t("labels"), "doc_id", "left")
    return joined.select("lang", "source", "quality").dropDuplicates()


@query("rows_of_conflicting_keys", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM (SELECT DISTINCT * FROM lineitem) GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
""")
def rows_of_conflicting_keys(t: Tables) -> DataFrame:
    conflict = I.key_classes(t("lineitem"), LINE_KEY).where("dup_class = 'conflict'").select(*LINE_KEY)
    return t("lineitem").join(conflict, LINE_KEY, "left_semi").select(*LINE_KEY, "l_partkey", "l_quantity")


@query("complete_rows", sql="""
SELECT d.doc_id, n_chars, quality, CASE WHEN quality = 1 AND n_chars BETWEEN 200 AND 5000 THEN 'keep' ELSE 'review' END AS cohort
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND source IS NOT NULL
""")
def complete_rows(t: Tables) -> DataFrame:
    joined = t("documents").join(t("labels"), "doc_id", "left").dropna(subset=["quality", "source"])
    cohort = F.when((F.col("quality") == 1) & F.col("n_chars").between(200, 5000), "keep").otherwise("review")
    return joined.select("doc_id", "n_chars", "quality", cohort.alias("cohort"))


@query("entity_panel_label_join", sql="""
SELECT r_name, count(*) AS n, round(avg(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END), 6) AS rate, round(avg(k), 6) AS mean_orders, round(avg(m), 6) AS mean_months
FROM customer JOIN (SELECT o_custkey, count(*) AS k, count(DISTINCT date_trunc('month', o_orderdate)) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1
""")
def entity_panel_label_join(t: Tables) -> DataFrame:
    # one row per (customer, month) first: distinct months need no distinct sets
    months = t("orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(P.row_count().alias("k"))
    panel = months.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("k").alias("k"), P.row_count().alias("m"))
    joined = (
        t("customer").join(panel, "c_custkey")
        .join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    return rounded(joined.groupBy("r_name").agg(
        P.row_count().alias("n"), F.avg((F.col("c_acctbal") < 0).cast("int")).alias("rate"),
        F.avg("k").alias("mean_orders"), F.avg("m").alias("mean_months")))
