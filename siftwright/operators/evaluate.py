"""Scores against labels: ranking quality, cost, lift, calibration.

Everything rests on counts per distinct score with running totals, so ties are handled exactly
and no table is sorted in one task. A score column may come from any model or rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import edge_array, edges_passed
from ..sources.scratch import materialize
from .ordering import add_position, null_safe_join, ordered_counts, quantiles, unpivot
from .profile import row_count
from .statistics import quantile_bin


def _score_counts(scored: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    y = F.col(label).cast("bigint")
    return ordered_counts(scored.where(F.col(label).isNotNull()), score, by, {"pos": y})


def score_metrics(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, average precision, Brier score and their no-skill references, per group.

    AUC is the chance that a positive outranks a negative, ties counting half. Average precision
    is the step sum over distinct scores from the highest down.
    """
    c = _score_counts(scored, score, label, by)
    neg, neg_before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    negs = F.col("n_total") - F.col("pos_total")
    # at or above this score: positives and rows
    tp = F.col("pos_total") - F.col("pos_before")
    rows = F.col("n_total") - F.col("n_before")
    s = F.col(score).cast("double")
    return c.groupBy(*by).agg(
        F.max("n_total").alias("n"), F.max("pos_total").alias("positives"),
        F.try_divide(F.sum(F.col("pos") * (neg_before + neg / 2.0)), F.max(F.col("pos_total") * negs)).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * tp / rows), F.max("pos_total")).alias("average_precision"),
        (F.sum(F.col("pos") * (1 - s) * (1 - s) + neg * s * s) / F.max("n_total")).alias("brier"),
        (F.max("pos_total") / F.max("n_total")).alias("base_rate"),
    ).withColumn("brier_no_skill", F.col("base_rate") * (1 - F.col("base_rate")))


def brier_score(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and that of the base rate, per group: averages, for which nothing is ordered."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    return scored.where(s.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.avg((s - y) * (s - y)).alias("brier"), (F.avg(y) * (1 - F.avg(y))).alias("brier_no_skill"))


def metrics_by_fold(scored: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """AUC per fold, their mean and sd, beside the AUC of all rows pooled - two different numbers."""
    per = score_metrics(scored, score, label, [fold])
    pooled = score_metrics(scored, score, label).select("roc_auc").scalar()
    return per.agg(
        row_count().alias("folds"), F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("sd_auc"),
        F.min("roc_auc").alias("min_auc"), F.max("roc_auc").alias("max_auc"),
    ).withColumn("pooled_auc", pooled)


def null_band(null_scores: DataFrame, best: Column | float, value: str = "roc_auc") -> DataFrame:
    """Range of the shuffled-label draws and the share at or above the best model, plain and adjusted."""
    b = best if isinstance(best, Column) else F.lit(float(best))
    return null_scores.agg(
        row_count().alias("draws"), F.min(value).alias("null_min"), F.max(value).alias("null_max"),
        F.avg(value).alias("null_mean"), F.count_if(F.col(value) >= b).alias("draws_ge_best"),
    ).select(
        "*", (F.col("draws_ge_best") / F.col("draws")).alias("share_ge_best"),
        ((F.col("draws_ge_best") + 1) / (F.col("draws") + 1)).alias("p_adjusted"), b.alias("best"),
    )


# ------------------------------------------------------------------ cost of decisions
# Loss-to-offer ratios of the sensitivity table.
LOSS_RATIOS = (1, 2, 3, 5, 10, 20)


def cost_curve(scored: DataFrame, score: str, label: str, thresholds: Sequence[float], *, offer: float = 1.0, loss: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and cost at every threshold (offer made at score >= threshold).

    Rows are counted once by the highest threshold they pass; the sums run over that small table.
    """
    taus = sorted(float(x) for x in thresholds)
    passed = edges_passed(edge_array(taus), F.col(score).cast("double"), len(taus))
    counts = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, passed.alias("b")).agg(
        row_count().alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(len(taus))), lambda i: F.struct(
        i.alias("b"), F.get(edge_array(taus), i - 1).alias("tau"))))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives"))
    full = groups.select(*by, "rows", "positives", grid.alias("g")).select(*by, "rows", "positives", "g.*")
    joined = null_safe_join(full, counts, [*by, "b"], "left")
    # at most one row per threshold and group
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("b"))
    run = joined.select(
        *by, "tau", "rows", "positives",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("offers"),
    )
    fn = F.col("positives") - F.col("tp")
    return run.select(
        *by, "tau", "tp", (F.col("offers") - F.col("tp")).alias("fp"), fn.alias("fn"),
        (F.col("rows") - F.col("offers") - fn).alias("tn"),
        (offer * F.col("offers") + loss * fn).alias("cost"),
    )


def best_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cheapest threshold of a cost curve; the lowest one wins a tie."""
    order = F.struct("cost", "tau")
    return curve.groupBy(*by).agg(F.min_by("tau", order).alias("best_tau"), F.min("cost").alias("min_cost"))


def policy_costs(scored: DataFrame, score: str, label: str, *, offer: float = 1.0, loss: float = 5.0) -> DataFrame:
    """Cost of nobody, everybody, a perfect model and the model at its derived threshold offer/loss."""
    tau = offer / loss
    row = _policy_row(scored, score, label, {"t": tau})
    nobody, everybody, perfect = loss * F.col("pos"), offer * F.col("n"), offer * F.col("pos")
    model = offer * F.col("offers_t") + loss * (F.col("pos") - F.col("tp_t"))
    priced = row.select("*", nobody.cast("double").alias("nobody"), (nobody - perfect).cast("double").alias("max_saving"))

    def line(name: str, tp: Column, fp: Column, fn: Column, cost: Column) -> Column:
        return F.struct(
            F.lit(name).alias("policy"), tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
            fn.cast("bigint").alias("fn"), cost.cast("double").alias("cost"),
            (F.col("nobody") - cost).cast("double").alias("saving"),
            F.try_divide(F.col("nobody") - cost, F.col("max_saving")).cast("double").alias("share_of_achievable"),
        )

    zero = F.lit(0)
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return priced.select(F.inline(F.array(
        line("nobody", zero, zero, pos, nobody), line("everybody", pos, neg, zero, everybody),
        line("perfect", pos, zero, zero, perfect),
        line("model", F.col("tp_t"), F.col("offers_t") - F.col("tp_t"), pos - F.col("tp_t"), model),
    )))


def _policy_row(scored: DataFrame, score: str, label: str, taus: Mapping[str, float]) -> DataFrame:
    hit = F.col(label) == 1
    return scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(
        row_count().alias("n"), F.count_if(hit).alias("pos"),
        *[a for k, x in taus.items() for a in (
            F.count_if(F.col(score) >= x).alias(f"offers_{k}"), F.count_if((F.col(score) >= x) & hit).alias(f"tp_{k}"))],
    )


def cost_sensitivity(scored: DataFrame, score: str, label: str, ratios: Sequence[float] = LOSS_RATIOS) -> DataFrame:
    """Cost of three policies at several loss-to-offer ratios and the cheapest by cost.

    The model's loss is the ratio itself, as for the other policies.
    """
    row = _policy_row(scored, score, label, {f"r{i}": 1.0 / r for i, r in enumerate(ratios)})
    lines = []
    for i, r in enumerate(ratios):
        lines.append(F.struct(
            F.lit(float(r)).alias("ratio"), F.lit(1.0 / r).alias("theory_tau"),
            (float(r) * F.col("pos")).alias("never"), F.col("n").cast("double").alias("everybody"),
            (F.col(f"offers_r{i}") + float(r) * (F.col("pos") - F.col(f"tp_r{i}"))).alias("model"),
        ))
    costs = row.select(F.inline(F.array(*lines)))
    cheapest = F.array_min(F.array(*[
        F.struct(F.col(c).alias("cost"), F.lit(i).alias("i"), F.lit(name).alias("name"))
        for i, (c, name) in enumerate([("never", "nobody"), ("everybody", "everybody"), ("model", "model")])
    ]))
    return costs.withColumn("cheapest", cheapest.getField("name"))


def random_offer_saving(scored: DataFrame, label: str, *, offer: float = 1.0, loss: float = 5.0) -> DataFrame:
    """What one offer to a random entity saves, and whether that beats its price."""
    rate = F.avg(label)
    return scored.agg(rate.alias("base_rate"), (rate * loss).alias("expected_saving")).select(
        "*", F.lit(offer / loss).alias("theory_tau"), (F.col("expected_saving") > offer).alias("worth_it"))


# ------------------------------------------------------------------ lift, calibration, ensembles
def decile_lift(scored: DataFrame, score: str, label: str, key: str, n: int = 10) -> DataFrame:
    """Equal-count bands from the highest score down: positives, rate, lift, cumulative recall.

    Every row gets its global position (ties broken by key); the first ``rows mod n`` bands hold
    one row more.
    """
    rows = materialize(scored.where(F.col(score).isNotNull()).select(key, label, (-F.col(score)).alias("__d")), "positions")
    ranked = add_position(rows, ["__d", key], name="pos", stored=True)
    total = rows.agg(F.struct(row_count().alias("n"), F.sum(label).alias("y"))).scalar()
    rows = total.getField("n")
    size, extra = F.floor(rows / n), rows % n
    at = F.col("pos") - 1
    wide = extra * (size + 1)
    # beyond the wider bands size is at least 1 whenever a row exists
    band = F.when(at < wide, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - wide) / F.greatest(size, F.lit(1))))
    bands = ranked.groupBy((band + 1).cast("int").alias("decile")).agg(
        row_count().alias("n"), F.sum(label).cast("bigint").alias("positives"))
    up_to = Window.partitionBy(F.lit(0)).orderBy("decile")  # n rows
    rate = F.col("positives") / F.col("n")
    y = total.getField("y")
    return bands.select(
        "decile", "n", "positives", rate.alias("rate"), F.try_divide(rate, y / rows).alias("lift"),
        F.try_divide(F.sum("positives").over(up_to), y).alias("cum_recall"),
    )


def calibration(scored: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score against observed rate per quantile bin of the score."""
    binned = quantile_bin(scored.where(F.col(score).isNotNull()).select(score, label), score, bins)
    return binned.groupBy("bin").agg(
        row_count().alias("n"), F.avg(score).alias("predicted"), F.avg(label).alias("observed")
    ).withColumn("gap", F.col("observed") - F.col("predicted"))


def percent_ranks(scored: DataFrame, scores: Sequence[str], key: str) -> DataFrame:
    """Average percentile rank of every score (ties share the mean rank), one row per key."""
    long = unpivot(scored, scores, [key])
    counts = ordered_counts(long, "value", ["metric"])
    rank = (F.col("n_before") + (F.col("n") + 1) / 2.0) / F.col("n_total")
    placed = long.join(counts.select("metric", "value", rank.alias("r")), ["metric", "value"])
    return placed.groupBy(key).agg(*[F.max(F.when(F.col("metric") == s, F.col("r"))).alias(s) for s in scores])


def ensemble(scored: DataFrame, scores: Sequence[str], key: str, label: str, how: str = "prob") -> DataFrame:
    """Mean of the scores ("prob") or of their percentile ranks ("rank"): key, label, score."""
    if how == "prob":
        wide = scored
    elif how == "rank":
        wide = percent_ranks(scored, scores, key).join(scored.select(key, label), key)
    else:
        raise ValueError("how must be 'prob' or 'rank'")
    mean = sum((F.col(s) for s in scores[1:]), F.col(scores[0])) / len(scores)
    return wide.select(key, label, mean.alias("score"))


def score_summary(scored: DataFrame, score: str, label: str, tolerance: float = 0.01) -> DataFrame:
    """Range, median and mean of a score, and whether its mean sits at the label's base rate."""
    median = quantiles(scored, score, {"m": 0.5}).scalar()
    row = scored.agg(
        row_count().alias("n"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"),
        F.avg(label).alias("base_rate"))
    return row.select("*", median.alias("median"), (F.abs(F.col("mean") - F.col("base_rate")) < tolerance).alias("aligned"))


def compare_variants(scored: DataFrame, variant: str, score: str, label: str, thresholds: Sequence[float], *, offer: float = 1.0, loss: float = 5.0) -> DataFrame:
    """Per model variant: AUC, best threshold, lowest cost, saving against nobody, share achievable."""
    auc = score_metrics(scored, score, label, [variant]).select(variant, "roc_auc", "positives")
    best = best_threshold(cost_curve(scored, score, label, thresholds, offer=offer, loss=loss, by=[variant]), [variant])
    saving = loss * F.col("positives") - F.col("min_cost")
    return auc.join(best, variant).select(
        variant, "roc_auc", "best_tau", "min_cost", saving.alias("saving_vs_nobody"),
        F.try_divide(saving, (loss - offer) * F.col("positives")).alias("share_of_achievable"))
