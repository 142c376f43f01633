"""Panel features of customers: orders by (customer, year)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as V
from ..operators import integrity as I
from ..operators.detectors import flag_values, impute_median, is_negative
from ..sources.scratch import materialize
from ..sources.tables import Tables
from .registry import query, rounded

# Feature prefixes and the panel columns behind them.
METRICS = {"spend": "spend", "cnt": "orders", "avg": "mean_price", "fill": "n_filled"}


def customer_panel(t: Tables) -> DataFrame:
    return V.build_panel(t("orders"), "o_custkey", F.year("o_orderdate"), {
        "spend": F.sum("o_totalprice"), "orders": F.count(F.lit(1)), "mean_price": F.avg("o_totalprice"),
        "n_filled": F.count_if(F.col("o_orderstatus") == "F"),
    })


_PANEL = ("(SELECT o_custkey, CAST(year(o_orderdate) AS DOUBLE) AS t, sum(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS cnt, "
          "avg(o_totalprice) AS \"avg\", CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS fill FROM orders GROUP BY 1, 2)")


# Decimals compared - money to 6 places, counts and ratios to 8.
_RATIOS = ["cv", "rel_slope", "halfratio", "trend_r2"]
_DIGITS = {
    f"{tag}_{name}": 8 for tag in METRICS for name in
    ["mean", "median", "min", "max", "sd", "slope", "last_minus_first", "first3", "last3", "last1", *_RATIOS]
    if name in _RATIOS or tag in ("cnt", "fill")
}


def _sql(parts) -> str:
    items = []
    for tag in METRICS:
        for name, expr in parts:
            e = expr.replace("{v}", f'"{tag}"')
            items.append(f"{e if name == 'declining' else f'round({e}, {_DIGITS.get(f"{tag}_{name}", 6)})'} AS {tag}_{name}")
    return f"SELECT o_custkey, {', '.join(items)} FROM {_PANEL} GROUP BY 1"


_SLOPE = ("CASE WHEN min({v}) = max({v}) OR min(t) = max(t) OR abs(regr_slope({v}, t)) <= max(abs({v})) * 1e-12 "
          "THEN 0.0 ELSE regr_slope({v}, t) END")


@query("panel_features_level", sql=_sql([
    ("mean", "avg({v})"), ("median", "median({v})"), ("min", "min({v})"), ("max", "max({v})")]))
def panel_features_level(t: Tables) -> DataFrame:
    return rounded(V.panel_features(customer_panel(t), "o_custkey", METRICS, families=["level"]), 6, **_DIGITS)


@query("panel_features_volatility", sql=_sql([
    ("sd", "stddev_pop({v})"), ("cv", "CASE WHEN avg({v}) > 0 THEN stddev_pop({v}) / avg({v}) ELSE 0.0 END")]))
def panel_features_volatility(t: Tables) -> DataFrame:
    return rounded(V.panel_features(customer_panel(t), "o_custkey", METRICS, families=["volatility"]), 6, **_DIGITS)


_EARLY = "list_avg(list_slice(array_agg({v} ORDER BY t), 1, 3))"
_LATE = "list_avg(list_slice(array_agg({v} ORDER BY t DESC), 1, 3))"


@query("panel_features_trend", sql=_sql([
    ("slope", _SLOPE),
    ("rel_slope", f"CASE WHEN avg({{v}}) > 0 THEN ({_SLOPE}) / avg({{v}}) ELSE 0.0 END"),
    ("halfratio", f"CASE WHEN {_EARLY} > 0 THEN {_LATE} / {_EARLY} END"),
    ("last_minus_first", "arg_max({v}, t) - arg_min({v}, t)"),
    ("trend_r2", "CASE WHEN min({v}) = max({v}) OR min(t) = max(t) THEN 0.0 ELSE regr_r2({v}, t) END"),
    ("declining", f"CAST(({_SLOPE}) < 0 AS INTEGER)")]))
def panel_features_trend(t: Tables) -> DataFrame:
    return rounded(V.panel_features(customer_panel(t), "o_custkey", METRICS, families=["trend"]), 6, **_DIGITS)


@query("panel_features_ends", sql=_sql([
    ("first3", _EARLY), ("last3", _LATE), ("last1", "arg_max({v}, t)")]))
def panel_features_ends(t: Tables) -> DataFrame:
    return rounded(V.panel_features(customer_panel(t), "o_custkey", METRICS, families=[], extras=True), 6, **_DIGITS)


def customer_engagement(panel: DataFrame) -> DataFrame:
    return V.engagement_features(
        panel, "o_custkey",
        zero_periods={"n_unfilled_years": "n_filled"}, active_periods={"n_filled_years": "n_filled"},
        totals={"filled_total": "n_filled"},
        ratios={"filled_per_order": ("n_filled", "orders"), "spend_per_order": ("spend", "orders")},
        products={"unfilled_interaction": ("n_unfilled_years", "filled_total")})


_ENGAGE = f"""SELECT o_custkey, count(*) FILTER (WHERE fill = 0) AS n_unfilled_years, count(*) FILTER (WHERE fill > 0) AS n_filled_years,
  CAST(sum(fill) AS BIGINT) AS filled_total, round(CASE WHEN sum(cnt) > 0 THEN sum(fill) / sum(cnt) ELSE 0.0 END, 4) AS filled_per_order,
  round(CASE WHEN sum(cnt) > 0 THEN sum(spend) / sum(cnt) ELSE 0.0 END, 4) AS spend_per_order,
  CAST(count(*) FILTER (WHERE fill = 0) * sum(fill) AS BIGINT) AS unfilled_interaction FROM {_PANEL} GROUP BY 1"""


@query("panel_features_engagement", sql=_ENGAGE)
def panel_features_engagement(t: Tables) -> DataFrame:
    return rounded(customer_engagement(customer_panel(t)), 4)


def customer_entity(t: Tables) -> DataFrame:
    """Key, label, category, the lowest balance of the nation's suppliers (absent, invalid and filled apart), tenure, and dq_dup_conflict."""
    c = I.keep_first(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"), ["c_custkey"]).select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n"), "dq_dup_conflict",
        is_negative("c_acctbal").cast("int").alias("label"))
    supply = t("supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.min("s_acctbal").alias("supply_low"))
    first = t("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    end = F.to_date(t("orders").agg(F.max("o_orderdate")).scalar())
    joined = c.join(first, "o_custkey", "left").join(supply, "n", "left")
    joined = flag_values(joined, "supply_low", {"supply_bad": is_negative("supply_low")}, "supply_clean", ["supply_bad"])
    joined = impute_median(joined, "supply_clean", imputed="supply_imputed", flag="supply_gap").withColumns({
        "supply_missing": F.col("supply_low").isNull().cast("int"), "supply_invalid": F.col("supply_bad").cast("int"),
        "is_machinery": (F.col("c_mktsegment") == "MACHINERY").cast("int")})
    tenure = V.tenure_features(
        joined.withColumn("first_day", F.to_date("first_order")), "first_day",
        window_start=F.make_date(F.lit(1996), F.lit(1), F.lit(1)), window_end=end)
    return V.with_notes(tenure.select(
        "o_custkey", "label", "dq_dup_conflict", "c_mktsegment", "supply_imputed", "supply_missing", "supply_invalid", "is_machinery",
        "tenure_months", "start_year", "started_in_window"), ENTITY_NOTES)


# Who the customer is and where it sits: family, inputs, reason.
ENTITY_NOTES = {
    "c_mktsegment": ("demographic", ["c_mktsegment"], "line of business"),
    "is_machinery": ("demographic", ["c_mktsegment"], "one line of business against all others"),
    "supply_imputed": ("demographic", ["s_acctbal"], "weakest supplier of the nation, with the median where there is no valid one"),
    "supply_missing": ("demographic", ["s_acctbal"], "nation without a supplier"),
    "supply_invalid": ("demographic", ["s_acctbal"], "weakest supplier in debt, so its balance is not used"),
}


_ENTITY = """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1), s AS (SELECT s_nationkey, min(s_acctbal) AS lo FROM supplier GROUP BY 1),
  c AS (SELECT *, count(DISTINCT (c_acctbal, c_mktsegment, c_nationkey)) OVER (PARTITION BY c_custkey) > 1 AS dq_dup_conflict, row_number() OVER (
        PARTITION BY c_custkey ORDER BY c_acctbal NULLS FIRST, c_mktsegment NULLS FIRST, c_nationkey NULLS FIRST) AS rn FROM customer),
  j AS (SELECT c_custkey AS o_custkey, CAST(c_acctbal < 0 AS INTEGER) AS label, dq_dup_conflict, c_mktsegment, lo, CASE WHEN NOT coalesce(lo < 0, false) THEN lo END AS v, CAST(d AS DATE) AS d
        FROM c LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN s ON s_nationkey = c_nationkey WHERE rn = 1)
SELECT o_custkey, label, dq_dup_conflict, c_mktsegment, round(coalesce(v, (SELECT median(v) FROM j)), 6) AS supply_imputed, CAST(lo IS NULL AS INTEGER) AS supply_missing,
  CAST(coalesce(lo < 0, false) AS INTEGER) AS supply_invalid, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS is_machinery,
  round_even(date_diff('day', d, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) / 30.44, 0) AS tenure_months,
  CAST(year(d) AS INTEGER) AS start_year, CAST(d >= DATE '1996-01-01' AS INTEGER) AS started_in_window FROM j"""


@query("entity_features", sql=_ENTITY)
def entity_features(t: Tables) -> DataFrame:
    return rounded(customer_entity(t), 6)


def customer_features(t: Tables) -> DataFrame:
    # stored once: both feature parts read it, and it is far smaller than the facts
    panel = materialize(customer_panel(t), "customer-panel")
    return V.join_features(customer_entity(t), "o_custkey", [
        V.panel_features(panel, "o_custkey", METRICS), customer_engagement(panel)])


@query("feature_table", sql=f"""
SELECT e.*, p.spend_mean, p.spend_slope, p.cnt_median, p.fill_halfratio, p.fill_trend_r2, g.filled_total, g.unfilled_interaction
FROM ({_ENTITY}) e LEFT JOIN ({_ENGAGE}) g ON g.o_custkey = e.o_custkey
LEFT JOIN (SELECT o_custkey, round(avg(spend), 6) AS spend_mean, round({_SLOPE.replace('{v}', 'spend')}, 6) AS spend_slope, round(median(cnt), 8) AS cnt_median,
  round(CASE WHEN {_EARLY.replace('{v}', 'fill')} > 0 THEN {_LATE.replace('{v}', 'fill')} / {_EARLY.replace('{v}', 'fill')} END, 8) AS fill_halfratio,
  round(CASE WHEN min(fill) = max(fill) OR min(t) = max(t) THEN 0.0 ELSE regr_r2(fill, t) END, 8) AS fill_trend_r2 FROM {_PANEL} GROUP BY 1) p ON p.o_custkey = e.o_custkey
""")
def feature_table(t: Tables) -> DataFrame:
    return rounded(customer_features(t).select(
        *customer_entity(t).columns, "spend_mean", "spend_slope", "cnt_median", "fill_halfratio", "fill_trend_r2",
        "filled_total", "unfilled_interaction"), 6, **_DIGITS)


@query("fill_with_indicator", sql=f"""
WITH h AS (SELECT o_custkey, CASE WHEN {_EARLY.replace('{v}', 'fill')} > 0 THEN {_LATE.replace('{v}', 'fill')} / {_EARLY.replace('{v}', 'fill')} END AS h FROM {_PANEL} GROUP BY 1)
SELECT o_custkey, round(coalesce(h, (SELECT median(h) FROM h)), 8) AS fill_halfratio, CAST(h IS NULL AS INTEGER) AS fill_halfratio_nobase FROM h
""")
def fill_with_indicator(t: Tables) -> DataFrame:
    f = V.panel_features(customer_panel(t), "o_custkey", METRICS, families=["trend"]).select("o_custkey", "fill_halfratio")
    return rounded(V.fill_with_indicator(f, ["fill_halfratio"], V.null_columns(f, ["fill_halfratio"])), 8)


# The market segments.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", sql="""
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS "c_mktsegment_BUILDING", CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS "c_mktsegment_FURNITURE",
       CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS "c_mktsegment_HOUSEHOLD", CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS "c_mktsegment_MACHINERY" FROM customer
""")
def one_hot(t: Tables) -> DataFrame:
    c = t("customer").select("c_custkey", "c_mktsegment")
    return V.one_hot(c, "c_mktsegment", SEGMENTS).drop("c_mktsegment")


# Panel features by family, as SQL.
_PARTS = {
    "usage_level": {"mean": "avg({v})", "median": "median({v})", "min": "min({v})", "max": "max({v})"},
    "usage_volatility": {"sd": "stddev_pop({v})", "cv": "CASE WHEN avg({v}) > 0 THEN stddev_pop({v}) / avg({v}) ELSE 0.0 END"},
    "usage_trend": {
        "slope": _SLOPE, "rel_slope": f"CASE WHEN avg({{v}}) > 0 THEN ({_SLOPE}) / avg({{v}}) ELSE 0.0 END",
        "halfratio": f"CASE WHEN {_EARLY} > 0 THEN {_LATE} / {_EARLY} END", "last_minus_first": "arg_max({v}, t) - arg_min({v}, t)",
        "trend_r2": "CASE WHEN min({v}) = max({v}) OR min(t) = max(t) THEN 0.0 ELSE regr_r2({v}, t) END", "declining": f"CAST(({_SLOPE}) < 0 AS INTEGER)"},
}
_ENGAGED = {
    "n_unfilled_years": ("n_filled", "periods without n_filled"), "n_filled_years": ("n_filled", "periods with n_filled"), "filled_total": ("n_filled", "all n_filled together"),
    "filled_per_order": ("n_filled,orders", "n_filled for each of orders, over all periods"), "spend_per_order": ("spend,orders", "spend for each of orders, over all periods"),
    "unfilled_interaction": ("n_unfilled_years,filled_total", "n_unfilled_years and filled_total at the same time"),
}
_STARTED = {"tenure_months": "months since the start, at the end of the window", "start_year": "year of the start",
            "started_in_window": "whether the whole history lies inside the window"}


def _catalogue_sql() -> str:
    wide = ", ".join(f'{e.replace("{v}", chr(34) + tag + chr(34))} AS {tag}_{name}' for tag in METRICS for part in _PARTS.values() for name, e in part.items())
    features = [(family, ",".join(inputs), why, name) for name, (family, inputs, why) in ENTITY_NOTES.items()]
    features += [("contract", "first_day", why, name) for name, why in _STARTED.items()]
    features += [(family, source, V._WHY[name].format(c=source), f"{tag}_{name}") for tag, source in METRICS.items() for family, part in _PARTS.items() for name in part]
    features += [("engagement", inputs, why, name) for name, (inputs, why) in _ENGAGED.items()]
    lines = " UNION ALL ".join(
        f"SELECT '{family}' AS family, '{inputs}' AS inputs, '{why}' AS rationale, '{name}' AS feature, count({name}) AS n, count(*) - count({name}) AS n_missing, "
        f"round(avg(TRY_CAST({name} AS DOUBLE)), 4) AS mean FROM x" for family, inputs, why, name in features)
    return (f"WITH e AS ({_ENTITY}), g AS ({_ENGAGE}), p AS (SELECT o_custkey AS k, {wide} FROM {_PANEL} GROUP BY 1), "
            f"x AS MATERIALIZED (SELECT * FROM e LEFT JOIN g USING (o_custkey) LEFT JOIN p ON p.k = e.o_custkey) {lines}")


@query("feature_catalogue", sql=_catalogue_sql())
def feature_catalogue(t: Tables) -> DataFrame:
    """Every feature of the table, from the notes its builders left."""
    return rounded(V.feature_catalogue(customer_features(t)), 4)
