"""Scores against labels. The scores are hashes of the key, partly tilted by the label, so any
engine can rebuild them; some tie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from ..operators import evaluate as E
from ..operators import models as L
from ..operators import monitor as G
from ..sources.scratch import materialize
from ..sources.tables import Tables
from .feature_queries import customer_panel
from .registry import query, rounded


def scored_labels(t: Tables) -> DataFrame:
    def u(name: str, steps: int):
        return hash32(F.lit(name), "doc_id") % steps / F.lit(float(steps))

    return t("labels").select(
        "doc_id", "toxic", "quality", u("a", 250).alias("flat"), ((u("b", 1000) + F.col("toxic") * 0.5) / 1.5).alias("tilted"),
        (u("c", 20) * 0.3).alias("coarse"))


def _u(name: str, steps: int) -> str:
    return f"(('0x' || substr(md5('{name}:' || doc_id), 1, 8))::BIGINT % {steps} / {steps}.0::DOUBLE)"


_SCORED = f"(SELECT doc_id, toxic, quality, {_u('a', 250)} AS flat, ({_u('b', 1000)} + toxic * 0.5::DOUBLE) / 1.5::DOUBLE AS tilted, {_u('c', 20)} * 0.3::DOUBLE AS coarse FROM labels)"
_SCORES = ["flat", "tilted", "coarse"]


def _long(t: Tables) -> DataFrame:
    from ..operators.ordering import unpivot

    return unpivot(scored_labels(t), _SCORES, ["doc_id", "toxic"], name="model", value="score")


_LONG = "(" + " UNION ALL ".join(f"SELECT doc_id, toxic, '{s}' AS model, {s} AS score FROM {_SCORED}" for s in _SCORES) + ")"

_METRICS = f"""
WITH s AS (SELECT model, score, count(*) AS n, sum(toxic) AS pos FROM {_LONG} GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER w AS n_thru, sum(pos) OVER w AS pos_thru, sum(n) OVER v AS nt, sum(pos) OVER v AS pt FROM s
        WINDOW w AS (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY model))
SELECT model, CAST(max(nt) AS BIGINT) AS n, CAST(max(pt) AS BIGINT) AS positives,
  round(sum(pos * ((n_thru - n) - (pos_thru - pos) + (n - pos) / 2.0)) / max(pt * (nt - pt)), 6) AS roc_auc,
  round(sum(pos * (pt - pos_thru + pos) / (nt - n_thru + n)) / max(pt), 6) AS average_precision,
  round(sum(pos * pow(1 - score, 2) + (n - pos) * pow(score, 2)) / max(nt), 6) AS brier,
  round(max(pt) / max(nt), 6) AS base_rate, round(max(pt) / max(nt) * (1 - max(pt) / max(nt)), 6) AS brier_no_skill FROM c GROUP BY model
"""


def _metrics(t: Tables) -> DataFrame:
    return rounded(E.score_metrics(_long(t), "score", "toxic", ["model"]))


@query("roc_auc", sql=f"""
SELECT model, round(sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) / count(*), 6) AS roc_auc
FROM {_LONG} p JOIN {_LONG} q USING (model) WHERE p.toxic = 1 AND q.toxic = 0 GROUP BY 1
""")
def roc_auc(t: Tables) -> DataFrame:
    return _metrics(t).select("model", "roc_auc")


@query("average_precision", sql=f"SELECT model, average_precision, base_rate FROM ({_METRICS})")
def average_precision(t: Tables) -> DataFrame:
    return _metrics(t).select("model", "average_precision", "base_rate")


@query("brier", sql=f"SELECT model, round(avg(pow(score - toxic, 2)), 6) AS brier, round(avg(toxic) * (1 - avg(toxic)), 6) AS brier_no_skill FROM {_LONG} GROUP BY 1")
def brier(t: Tables) -> DataFrame:
    return rounded(E.brier_score(_long(t), "score", "toxic", ["model"]))


@query("model_comparison_given_scores", sql=f"SELECT *, model = (SELECT arg_max(model, roc_auc) FROM ({_METRICS})) AS best FROM ({_METRICS})")
def model_comparison_given_scores(t: Tables) -> DataFrame:
    return rounded(L.model_comparison(_long(t).withColumnRenamed("toxic", "label")))


_H = "md5('42:' || doc_id)"
_FOLDED = f"(SELECT *, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {_H}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM {_SCORED})"


@query("stratified_folds", sql=f"SELECT doc_id, toxic, fold FROM {_FOLDED}")
def stratified_folds(t: Tables) -> DataFrame:
    return L.stratified_folds(t("labels").select("doc_id", "toxic"), "doc_id", "toxic", 5, 42)


@query("fold_sizes", sql=f"SELECT fold, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives FROM {_FOLDED} GROUP BY 1")
def fold_sizes(t: Tables) -> DataFrame:
    return stratified_folds(t).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("positives"))


@query("oof_base_rate", sql=f"""
WITH f AS (SELECT fold, sum(toxic) AS y, count(*) AS n FROM {_FOLDED} GROUP BY 1)
SELECT doc_id, toxic, d.fold, round(((SELECT sum(y) FROM f) - y) / ((SELECT sum(n) FROM f) - n), 6) AS score FROM {_FOLDED} d JOIN f ON f.fold = d.fold
""")
def oof_base_rate(t: Tables) -> DataFrame:
    return rounded(L.base_rate_scores(stratified_folds(t), "doc_id", "toxic"))


@query("per_fold_auc", sql=f"""
WITH p AS (SELECT fold, sum(CASE WHEN a.tilted > b.tilted THEN 1.0 WHEN a.tilted = b.tilted THEN 0.5 ELSE 0.0 END) / count(*) AS auc
           FROM {_FOLDED} a JOIN {_FOLDED} b USING (fold) WHERE a.toxic = 1 AND b.toxic = 0 GROUP BY 1)
SELECT count(*) AS folds, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS sd_auc, round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc,
  (SELECT round(sum(CASE WHEN a.tilted > b.tilted THEN 1.0 WHEN a.tilted = b.tilted THEN 0.5 ELSE 0.0 END) / count(*), 6) FROM {_SCORED} a, {_SCORED} b WHERE a.toxic = 1 AND b.toxic = 0) AS pooled_auc
FROM p
""")
def per_fold_auc(t: Tables) -> DataFrame:
    folded = L.stratified_folds(scored_labels(t), "doc_id", "toxic", 5, 42)
    return rounded(E.metrics_by_fold(folded, "tilted", "toxic", "fold"))


_PERMUTED = """(SELECT draw, doc_id, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY md5(draw || ':' || doc_id), doc_id) <= (SELECT count(*) FROM labels WHERE toxic = 0) THEN 0 ELSE 1 END AS toxic
FROM labels, range(20) d(draw))"""


@query("label_permutation", sql=f"SELECT CAST(draw AS INTEGER) AS draw, doc_id, toxic FROM {_PERMUTED}")
def label_permutation(t: Tables) -> DataFrame:
    return L.permute_labels(t("labels").select("doc_id", "toxic"), "doc_id", "toxic", 20)


@query("null_band", sql=f"""
WITH a AS (SELECT p.draw, sum(CASE WHEN x.flat > y.flat THEN 1.0 WHEN x.flat = y.flat THEN 0.5 ELSE 0.0 END) / count(*) AS auc
           FROM {_PERMUTED} p JOIN {_PERMUTED} q ON p.draw = q.draw JOIN {_SCORED} x ON x.doc_id = p.doc_id JOIN {_SCORED} y ON y.doc_id = q.doc_id
           WHERE p.toxic = 1 AND q.toxic = 0 GROUP BY 1),
  b AS (SELECT sum(CASE WHEN a.flat > b.flat THEN 1.0 WHEN a.flat = b.flat THEN 0.5 ELSE 0.0 END) / count(*) AS best FROM {_SCORED} a, {_SCORED} b WHERE a.toxic = 1 AND b.toxic = 0)
SELECT count(*) AS draws, round(min(auc), 6) AS null_min, round(max(auc), 6) AS null_max, round(avg(auc), 6) AS null_mean,
  count(*) FILTER (WHERE auc >= best) AS draws_ge_best, round(count(*) FILTER (WHERE auc >= best) / count(*), 6) AS share_ge_best,
  round((count(*) FILTER (WHERE auc >= best) + 1) / (count(*) + 1), 6) AS p_adjusted, round(max(best), 6) AS best FROM a, b
""")
def null_band(t: Tables) -> DataFrame:
    scores = scored_labels(t).select("doc_id", "flat")
    draws = label_permutation(t).join(scores, "doc_id")
    true_auc = E.score_metrics(scored_labels(t), "flat", "toxic").select("roc_auc").scalar()
    return rounded(E.null_band(E.score_metrics(draws, "flat", "toxic", ["draw"]), true_auc))


_TAUS = [0.005 + i * (0.995 - 0.005) / 199 for i in range(200)]
_CURVE = f"""(WITH t AS (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in _TAUS)}]) AS tau)
SELECT model, tau, count(*) FILTER (WHERE score >= tau AND toxic = 1) AS tp, count(*) FILTER (WHERE score >= tau AND toxic = 0) AS fp,
  count(*) FILTER (WHERE score < tau AND toxic = 1) AS fn, count(*) FILTER (WHERE score < tau AND toxic = 0) AS tn,
  count(*) FILTER (WHERE score >= tau) + 5.0::DOUBLE * count(*) FILTER (WHERE score < tau AND toxic = 1) AS cost FROM {_LONG}, t GROUP BY 1, 2)"""


@query("cost_sweep", sql=f"SELECT model, round(tau, 9) AS tau, tp, fp, fn, tn, cost FROM {_CURVE}")
def cost_sweep(t: Tables) -> DataFrame:
    return rounded(E.cost_curve(_long(t), "score", "toxic", _TAUS, by=["model"]), 9)


@query("best_threshold", sql=f"SELECT model, round(arg_min(tau, (cost, tau)), 9) AS best_tau, min(cost) AS min_cost FROM {_CURVE} GROUP BY 1")
def best_threshold(t: Tables) -> DataFrame:
    return rounded(E.best_threshold(E.cost_curve(_long(t), "score", "toxic", _TAUS, by=["model"]), ["model"]), 9)


@query("cost_variants", sql=f"""
WITH m AS ({_METRICS}), b AS (SELECT model, arg_min(tau, (cost, tau)) AS best_tau, min(cost) AS min_cost FROM {_CURVE} GROUP BY 1)
SELECT m.model, roc_auc, round(best_tau, 6) AS best_tau, min_cost, 5 * positives - min_cost AS saving_vs_nobody,
       round((5 * positives - min_cost) / (4 * positives), 6) AS share_of_achievable FROM m JOIN b USING (model)
""")
def cost_variants(t: Tables) -> DataFrame:
    return rounded(E.compare_variants(_long(t), "model", "score", "toxic", _TAUS))


@query("policy_costs", sql=f"""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS p, count(*) FILTER (WHERE coarse >= 0.2) AS o, count(*) FILTER (WHERE coarse >= 0.2 AND toxic = 1) AS tp FROM {_SCORED}),
  l AS (SELECT 'nobody' AS policy, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, p AS fn, 5.0::DOUBLE * p AS cost FROM s
    UNION ALL SELECT 'everybody', p, n - p, 0, CAST(n AS DOUBLE) FROM s UNION ALL SELECT 'perfect', p, 0, 0, CAST(p AS DOUBLE) FROM s
    UNION ALL SELECT 'model', tp, o - tp, p - tp, o + 5.0::DOUBLE * (p - tp) FROM s)
SELECT l.*, 5.0::DOUBLE * p - cost AS saving, round((5.0::DOUBLE * p - cost) / (4 * p), 6) AS share_of_achievable FROM l, s
""")
def policy_costs(t: Tables) -> DataFrame:
    return rounded(E.policy_costs(scored_labels(t), "coarse", "toxic"))


_RATIOS = [1, 2, 3, 5, 10, 20]


@query("cost_sensitivity", sql=" UNION ALL ".join(f"""
SELECT {r}::DOUBLE AS ratio, round({1.0 / r!r}::DOUBLE, 6) AS theory_tau, never, everybody, model,
  CASE WHEN never <= everybody AND never <= model THEN 'nobody' WHEN everybody <= model THEN 'everybody' ELSE 'model' END AS cheapest
FROM (SELECT {r}::DOUBLE * count(*) FILTER (WHERE toxic = 1) AS never, CAST(count(*) AS DOUBLE) AS everybody,
  count(*) FILTER (WHERE tilted >= {1.0 / r!r}::DOUBLE) + {r}::DOUBLE * count(*) FILTER (WHERE tilted < {1.0 / r!r}::DOUBLE AND toxic = 1) AS model FROM {_SCORED})""" for r in _RATIOS))
def cost_sensitivity(t: Tables) -> DataFrame:
    return rounded(E.cost_sensitivity(scored_labels(t), "tilted", "toxic", _RATIOS))


@query("random_offer", sql="SELECT round(avg(toxic), 6) AS base_rate, round(avg(toxic) * 5, 6) AS expected_saving, 0.2::DOUBLE AS theory_tau, avg(toxic) * 5 > 1 AS worth_it FROM labels")
def random_offer(t: Tables) -> DataFrame:
    return rounded(E.random_offer_saving(t("labels"), "toxic"))


@query("decile_lift", sql=f"""
WITH b AS (SELECT CAST(ntile(10) OVER (ORDER BY coarse DESC, doc_id) AS INTEGER) AS decile, toxic FROM {_SCORED}),
  s AS (SELECT decile, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives FROM b GROUP BY 1)
SELECT decile, n, positives, round(positives / n, 6) AS rate, round(positives / n / ((SELECT sum(positives) FROM s) / (SELECT sum(n) FROM s)), 6) AS lift,
  round(sum(positives) OVER (ORDER BY decile) / (SELECT sum(positives) FROM s), 6) AS cum_recall FROM s
""")
def decile_lift(t: Tables) -> DataFrame:
    return rounded(E.decile_lift(scored_labels(t), "coarse", "toxic", "doc_id"))


@query("calibration", sql=f"""
WITH e AS (SELECT list_distinct(list_filter([{', '.join(f'quantile_cont(tilted, {i / 10})' for i in range(1, 10))}], lambda z: z IS NOT NULL)) AS e FROM {_SCORED}),
  b AS (SELECT CAST(len(list_filter(e, lambda z: z < tilted)) AS INTEGER) AS bin, tilted, toxic FROM {_SCORED}, e)
SELECT bin, count(*) AS n, round(avg(tilted), 6) AS predicted, round(avg(toxic), 6) AS observed, round(avg(toxic) - avg(tilted), 6) AS gap FROM b GROUP BY 1
""")
def calibration(t: Tables) -> DataFrame:
    return rounded(E.calibration(scored_labels(t), "tilted", "toxic"))


def _prank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query("percent_ranks", sql=f"SELECT doc_id, {', '.join(f'round({_prank(c)}, 6) AS {c}' for c in _SCORES)} FROM {_SCORED}")
def percent_ranks(t: Tables) -> DataFrame:
    return rounded(E.percent_ranks(scored_labels(t), _SCORES, "doc_id"))


@query("rank_ensemble", sql=f"SELECT doc_id, toxic, round(({' + '.join(_prank(c) for c in _SCORES)}) / 3, 6) AS score FROM {_SCORED}")
def rank_ensemble(t: Tables) -> DataFrame:
    return rounded(E.ensemble(scored_labels(t), _SCORES, "doc_id", "toxic", "rank"))


@query("probability_ensemble", sql=f"SELECT doc_id, toxic, round((flat + tilted + coarse) / 3, 6) AS score FROM {_SCORED}")
def probability_ensemble(t: Tables) -> DataFrame:
    return rounded(E.ensemble(scored_labels(t), _SCORES, "doc_id", "toxic", "prob"))


@query("score_summary", sql=f"""
SELECT count(*) AS n, round(min(coarse), 6) AS "min", round(max(coarse), 6) AS "max", round(avg(coarse), 6) AS mean, round(avg(toxic), 6) AS base_rate,
  round(median(coarse), 6) AS median, abs(avg(coarse) - avg(toxic)) < 0.01 AS aligned FROM {_SCORED}
""")
def score_summary(t: Tables) -> DataFrame:
    return rounded(E.score_summary(scored_labels(t), "coarse", "toxic"))


# ------------------------------------------------------------------ drift
def _event_panel(t: Tables) -> DataFrame:
    return t("events").select(
        F.dayofmonth("ts").alias("day"), "value", F.length("props").cast("double").alias("props_len"),
        F.col("user_id").cast("double").alias("user_id"))


_EVENT_METRICS = ["value", "props_len", "user_id"]


def _psi_sql(source: str, period: str, metrics, ref: str) -> str:
    parts = []
    for m in metrics:
        qs = ", ".join(f"quantile_cont({m}, {i / 10})" for i in range(1, 10))
        parts.append(f"""
SELECT '{m}' AS metric, {period}, sum(c) AS n, bool_or(r) AS in_reference, sum(psi) AS psi FROM (
  SELECT g.{period}, g.bin, coalesce(c.c, 0) AS c, coalesce(c.r, false) AS r,
         (greatest(coalesce(c.c, 0) / p.n, 1e-6) - greatest(coalesce(b.c, 0) / bn.n, 1e-6)) * ln(greatest(coalesce(c.c, 0) / p.n, 1e-6) / greatest(coalesce(b.c, 0) / bn.n, 1e-6)) AS psi
  FROM (SELECT {period}, unnest(range(0, (SELECT len(e) + 1 FROM e_{m}))) AS bin FROM (SELECT DISTINCT {period} FROM {source})) g
  JOIN (SELECT {period}, count({m}) AS n FROM {source} GROUP BY 1) p ON p.{period} = g.{period}
  LEFT JOIN (SELECT {period}, bin, count(*) AS c, bool_or({ref}) AS r FROM b_{m} GROUP BY 1, 2) c ON c.{period} = g.{period} AND c.bin = g.bin
  LEFT JOIN (SELECT bin, count(*) AS c FROM b_{m} WHERE {ref} GROUP BY 1) b ON b.bin = g.bin
  CROSS JOIN (SELECT count({m}) AS n FROM {source} WHERE {ref}) bn) GROUP BY 2""")
    ctes = ", ".join(
        f"e_{m} AS (SELECT list_distinct([{', '.join(f'quantile_cont({m}, {i / 10})' for i in range(1, 10))}]) AS e FROM {source} WHERE {ref}), "
        f"b_{m} AS (SELECT *, len(list_filter(e, lambda z: z <= {m})) AS bin FROM {source}, e_{m})" for m in metrics)
    return f"(WITH {ctes} {' UNION ALL '.join(parts)})"


_EVENTS_SQL = "(SELECT CAST(day(ts) AS INTEGER) AS day, value, CAST(length(props) AS DOUBLE) AS props_len, CAST(user_id AS DOUBLE) AS user_id FROM events)"
_EVENT_PSI = _psi_sql(_EVENTS_SQL, "day", _EVENT_METRICS, "day <= 10")


def event_psi(t: Tables) -> DataFrame:
    return G.psi(_event_panel(t), "day", _EVENT_METRICS, F.col("day") <= 10)


@query("psi_by_period", sql=f"SELECT metric, day, CAST(n AS BIGINT) AS n, in_reference, round(psi, 6) AS psi FROM {_EVENT_PSI}")
def psi_by_period(t: Tables) -> DataFrame:
    return rounded(event_psi(t))


_ORDERS_SQL = ("(SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS t, sum(o_totalprice) AS spend, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1, 2)")


@query("psi_customer_panel", sql=f"SELECT metric, t, CAST(n AS BIGINT) AS n, in_reference, round(psi, 6) AS psi FROM {_psi_sql(_ORDERS_SQL, 't', ['spend', 'orders'], 't <= 1997')}")
def psi_customer_panel(t: Tables) -> DataFrame:
    # the panel is far smaller than the facts and is read for edges, reference and periods
    panel = materialize(customer_panel(t), "customer-panel")
    return rounded(G.psi(panel, "t", ["spend", "orders"], F.col("t") <= 1997))


@query("psi_wide", sql=f"SELECT day, {', '.join(f'''round(max(psi) FILTER (WHERE metric = '{m}'), 6) AS psi_{m}''' for m in _EVENT_METRICS)} FROM {_EVENT_PSI} GROUP BY 1")
def psi_wide(t: Tables) -> DataFrame:
    return rounded(G.psi_wide(event_psi(t), "day", {m: f"psi_{m}" for m in _EVENT_METRICS}))


@query("psi_step_summary", sql=f"""
SELECT metric, round(max(psi), 6) AS max_psi, arg_max(day, (psi, day)) AS worst_period, round(max(psi) FILTER (WHERE day <= 20), 6) AS max_before,
  round(min(psi) FILTER (WHERE day > 20), 6) AS min_after, round(min(psi) FILTER (WHERE day > 20) / max(psi) FILTER (WHERE day <= 20), 6) AS step_ratio,
  CASE WHEN max(psi) >= 0.25 THEN 'major' WHEN max(psi) >= 0.1 THEN 'moderate' ELSE 'stable' END AS alarm FROM {_EVENT_PSI} GROUP BY 1
""")
def psi_step_summary(t: Tables) -> DataFrame:
    return rounded(G.step_change(event_psi(t), "day", F.lit(20)))


@query("psi_worst_period", sql=f"SELECT arg_max(day, psi) AS period, round(max(psi), 6) AS max_psi FROM {_EVENT_PSI}")
def psi_worst_period(t: Tables) -> DataFrame:
    wide = G.psi_wide(event_psi(t), "day", {m: f"psi_{m}" for m in _EVENT_METRICS})
    return rounded(G.worst_period(wide, "day", [f"psi_{m}" for m in _EVENT_METRICS]))


_WEIGHTS = {"l_quantity": 0.02, "l_discount": -3.0, "l_tax": 1.5}


@query("linear_attribution", sql=f"""
WITH m AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg(abs({w} * ({c} - (SELECT avg({c}) FROM lineitem)))) AS mean_abs FROM lineitem" for c, w in _WEIGHTS.items())})
SELECT feature, round(mean_abs, 6) AS mean_abs, round(mean_abs / (SELECT sum(mean_abs) FROM m), 6) AS share FROM m
""")
def linear_attribution(t: Tables) -> DataFrame:
    return rounded(G.attribution_shares(t("lineitem"), _WEIGHTS))
