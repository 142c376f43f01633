"""Fits on the given tables; checked for shape and range, since fits are iterative.

The customer label (negative balance) is independent of the customers' orders, so its scores should
stay inside the shuffled-label band. The positive control is a label that the number of a customer's
orders determines, turned over for the eighth of the customers whose hashed key begins with 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import models as L
from ..operators import monitor as G
from ..operators.integrity import union_all
from ..sources import sinks
from ..sources.scratch import materialize, scratch_path
from ..sources.tables import Tables
from .feature_queries import METRICS, SEGMENTS, customer_features
from .registry import query, result

_NUMERIC = [
    "supply_imputed", "supply_missing", "is_machinery", "tenure_months", "start_year", "started_in_window",
    *[f"{tag}_{x}" for tag in METRICS for x in ("mean", "sd", "slope", "halfratio", "last_minus_first", "trend_r2")],
    "n_unfilled_years", "filled_total", "filled_per_order",
]


def _labelled(t: Tables) -> DataFrame:
    return customer_features(t).where("label is not null and not dq_dup_conflict")


def customer_matrix(t: Tables) -> L.Matrix:
    """Customers with a label whose rows agree; a supplier that is absent or invalid is one gap here."""
    table = materialize(_labelled(t).withColumn("supply_missing", F.greatest("supply_missing", "supply_invalid")), "customer-features")
    return L.design_matrix(table, "o_custkey", "label", _NUMERIC, {"c_mktsegment": SEGMENTS})


ORDER_FEATURES = ["n_orders", "mean_price", "sd_price", "finished_share", "n_years"]
_BUSY = "(count(*) > 10)"


def order_matrix(t: Tables) -> L.Matrix:
    """Customers with orders: five facts about them, and whether they have more than ten (an eighth turned over)."""
    per = t("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)).alias("sd_price"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("finished_share"), F.countDistinct(F.year("o_orderdate")).cast("double").alias("n_years"))
    turned = F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 1).isin("0", "1")
    table = materialize(per.withColumn("label", ((F.col("n_orders") > 10) != turned).cast("int")), "order-features")
    return L.design_matrix(table, "o_custkey", "label", ORDER_FEATURES)


def _estimators():
    return {
        "logistic": lambda n: L.logistic(n),
        "logistic balanced": lambda n: L.logistic(n, weight="w_balanced"),
        "forest": lambda n: L.forest(500),
        "boosting": lambda n: L.boosting(100),
    }


# Fits are iterative, so the queries return what any right fit must satisfy and SQL can state: who was
# scored in which fold, ranges, sums, the closed form of one component, and the verdicts of both controls.
_CUSTOMERS = "(SELECT c_custkey AS o_custkey, CAST(c_acctbal < 0 AS INTEGER) AS label FROM customer)"
_FOLDED = f"""(SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || o_custkey), o_custkey) - 1) % 5 AS INTEGER) AS fold FROM {_CUSTOMERS})"""
_ORDERS = f"""(SELECT o_custkey, CAST({_BUSY} <> (substr(md5(CAST(o_custkey AS VARCHAR)), 1, 1) IN ('0', '1')) AS INTEGER) AS label FROM orders GROUP BY 1)"""
_TOTALS = f"(SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM {_CUSTOMERS})"


def _inside(c: str) -> F.Column:
    return (F.col(c) > 0) & (F.col(c) < 1)


@result("oof_scores_values")
def oof_scores_values(t: Tables) -> DataFrame:
    return L.oof_scores(customer_matrix(t), {"logistic": lambda n: L.logistic(n)}, k=5)


@query("oof_scores", sql=f"SELECT o_custkey, label, fold, true AS inside FROM {_FOLDED}")
def oof_scores(t: Tables) -> DataFrame:
    return oof_scores_values(t).select("o_custkey", F.col("label").cast("int").alias("label"), "fold", _inside("score").alias("inside"))


@result("model_comparison_values")
def model_comparison_values(t: Tables) -> DataFrame:
    m = customer_matrix(t)
    scores = L.oof_scores(
        m, _estimators(), k=5, weights={"w_balanced": lambda d: L.balanced_weight(d, "label")}, weighted={"logistic balanced": "w_balanced"})
    folded = L.stratified_folds(m.data.select(m.key, "label"), m.key, "label", 5)
    plain = L.base_rate_scores(folded, m.key, "label").select(F.lit("no-skill").alias("model"), m.key, "label", "fold", "score")
    return materialize(L.model_comparison(union_all([scores, plain])), "comparison")


@query("model_comparison", sql=f"""
SELECT unnest(['boosting', 'forest', 'logistic', 'logistic balanced', 'no-skill']) AS model, n, positives, true AS near_half, true AS brier_in_range, CAST(1 AS BIGINT) AS n_best
FROM {_TOTALS}
""")
def model_comparison(t: Tables) -> DataFrame:
    table = model_comparison_values(t)
    best = table.where("best and model <> 'no-skill'").agg(F.count(F.lit(1))).scalar()
    # the label does not depend on the features
    return table.select("model", "n", "positives", (F.abs(F.col("roc_auc") - 0.5) < 0.2).alias("near_half"),
                        F.col("brier").between(0, 0.5).alias("brier_in_range"), best.alias("n_best"))


@result("label_signal_none_values")
def label_signal_none_values(t: Tables) -> DataFrame:
    return L.label_signal(customer_matrix(t), {"logistic": lambda n: L.logistic(n)}, draws=20, k=5)


@query("label_signal_none", sql=f"SELECT 'logistic' AS model, n, positives, 'logistic' AS null_model, true AS band_around_half, false AS signal FROM {_TOTALS}")
def label_signal_none(t: Tables) -> DataFrame:
    return label_signal_none_values(t).select("model", "n", "positives", "null_model", ((F.col("null_min") < 0.5) & (F.col("null_max") > 0.5)).alias("band_around_half"), "signal")


@result("label_signal_control_values")
def label_signal_control_values(t: Tables) -> DataFrame:
    return L.label_signal(
        order_matrix(t), {"logistic": lambda n: L.logistic(n), "forest": lambda n: L.forest(500)}, draws=20, k=5)


@query("label_signal_control", sql=f"""
SELECT unnest(['forest', 'logistic']) AS model, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, true AS above_the_null, true AS signal FROM {_ORDERS}
""")
def label_signal_control(t: Tables) -> DataFrame:
    return label_signal_control_values(t).select("model", "n", "positives", (F.col("pooled_auc") > F.col("null_max")).alias("above_the_null"), "signal")


# Fixed value: greatest slope of the penalised log-likelihood, per unit of weight, that counts as none; a constant score has slopes above 0.1.
_FLAT = 1e-5


def _optimality(t: Tables, weight=None) -> DataFrame:
    """Gradient of the customers' fit at its stored coefficients, and its mean score, which at the optimum is the share of positives."""
    coefficients, rows = L.logistic_parameters(order_matrix(t), weight=weight)
    return L.logistic_gradient(rows, coefficients).select(
        "parameter", (F.abs("gradient") <= _FLAT).alias("flat"), F.round("calibration", 4).alias("mean_score"))


_PARAMETERS = ", ".join(f"'{c}'" for c in ["intercept", *ORDER_FEATURES])


def _optimum_sql(weight: str) -> str:
    return f"""WITH c AS (SELECT label, count(*) OVER () AS n, count(*) OVER (PARTITION BY label) AS of_class FROM {_ORDERS}),
                    w AS (SELECT label, {weight} AS w FROM c)
    SELECT unnest([{_PARAMETERS}]) AS parameter, true AS flat, round(sum(w * label) / sum(w), 4) AS mean_score FROM w"""


@query("logistic_optimality", sql=_optimum_sql("1.0::DOUBLE"))
def logistic_optimality(t: Tables) -> DataFrame:
    return _optimality(t)


@query("logistic_balanced_optimality", sql=_optimum_sql("n / (2.0 * of_class)"))
def logistic_balanced_optimality(t: Tables) -> DataFrame:
    return _optimality(t, lambda d: L.balanced_weight(d, "label"))


@query("logistic_cost_optimality", sql=_optimum_sql("CASE WHEN label = 1 THEN 5.0 ELSE 1.0 END"))
def logistic_cost_optimality(t: Tables) -> DataFrame:
    return _optimality(t, lambda d: L.cost_weight("label"))


@result("cost_weighted_comparison_values")
def cost_weighted_comparison_values(t: Tables) -> DataFrame:
    m = customer_matrix(t)
    scores = L.oof_scores(
        m, {"weights 1 to 1": lambda n: L.logistic(n), "weights 5 to 1": lambda n: L.logistic(n, weight="w_cost")},
        k=5, weights={"w_cost": lambda d: L.cost_weight("label")}, weighted={"weights 5 to 1": "w_cost"})
    # both ends of the grid stand for the fixed policies: an offer to everybody and to nobody
    return E.compare_variants(scores, "model", "score", "label", [0.0, *[0.01 + i * 0.98 / 199 for i in range(200)], 1.01])


@query("cost_weighted_comparison", sql="""
SELECT unnest(['weights 1 to 1', 'weights 5 to 1']) AS model, true AS tau_in_range, true AS at_most_nobody, true AS at_most_everybody
""")
def cost_weighted_comparison(t: Tables) -> DataFrame:
    found = cost_weighted_comparison_values(t)
    rows = _labelled(t).agg(F.count(F.lit(1))).scalar()
    return found.select("model", F.col("best_tau").between(0, 1.01).alias("tau_in_range"), (F.col("saving_vs_nobody") >= 0).alias("at_most_nobody"),
                        (F.col("min_cost") <= rows).alias("at_most_everybody"))


@result("permutation_importance_values")
def permutation_importance_values(t: Tables) -> DataFrame:
    return L.cross_importance(order_matrix(t), lambda n: L.forest(100), k=5, repeats=5)


_NAMED = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in ORDER_FEATURES) + "]) AS feature)"


@query("permutation_importance", sql=f"SELECT feature, feature = 'n_orders' AS first, true AS in_range FROM {_NAMED}")
def permutation_importance(t: Tables) -> DataFrame:
    found = materialize(permutation_importance_values(t), "importance")
    best = found.agg(F.max("perm_importance")).scalar()
    return found.select("feature", (F.col("perm_importance") == best).alias("first"), (F.abs("perm_importance") <= 1).alias("in_range"))


_SHARES = "SELECT count(*) AS features, 1.0::DOUBLE AS total_share, true AS none_negative, 'n_orders' AS first FROM {}"


def _share_check(shares: DataFrame) -> DataFrame:
    return shares.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("share"), 6).alias("total_share"),
                      F.bool_and(F.col("share") >= 0).alias("none_negative"), F.max_by("feature", "share").alias("first"))


@result("sampled_shapley_values")
def sampled_shapley_values(t: Tables) -> DataFrame:
    return L.forest_shapley(order_matrix(t), L.forest(100), repeats=4)


@query("sampled_shapley", sql=_SHARES.format(_NAMED))
def sampled_shapley(t: Tables) -> DataFrame:
    return _share_check(sampled_shapley_values(t))


def _attribution(t: Tables) -> tuple[L.Matrix, DataFrame]:
    m = customer_matrix(t)
    data = materialize(m.data, "customer-matrix")
    scaler, lr = L.logistic(data.count()).fit(data).stages
    # coefficients act on standardised values; divide by the sd to act on raw ones
    weights = {c: float(w / s) if s > 0 else 0.0 for c, w, s in zip(m.names, lr.coefficients, scaler.std)}
    return m, G.attribution_shares(data, weights)


@result("logistic_attribution_values")
def logistic_attribution_values(t: Tables) -> DataFrame:
    return _attribution(t)[1]


@query("logistic_attribution", sql="SELECT 1.0::DOUBLE AS total_share, true AS none_negative, true AS all_features")
def logistic_attribution(t: Tables) -> DataFrame:
    m, found = _attribution(t)
    shares = _share_check(found)
    return shares.select("total_share", "none_negative", (F.col("features") == len(m.names)).alias("all_features"))


@query("score_sink", sql=f"SELECT o_custkey, true AS inside FROM {_CUSTOMERS}")
def score_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "scores")
    sinks.write_scores(oof_scores_values(t), path, key="o_custkey", score="score")
    return sinks.assert_unique_key(t.spark, path, ["o_custkey"]).select("o_custkey", _inside("score").alias("inside"))
