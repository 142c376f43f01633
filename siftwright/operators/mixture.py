"""One-dimensional Gaussian mixtures: fit, model choice and a closed-form flag."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .ordering import quantiles


@dataclass(frozen=True)
class Component:
    weight: float
    mean: float
    sd: float


@dataclass(frozen=True)
class Mixture:
    """Components in ascending order of their mean."""

    n: int
    log_likelihood: float
    components: tuple[Component, ...]

    @property
    def k(self) -> int:
        return len(self.components)

    @property
    def bic(self) -> float:
        return -2.0 * self.log_likelihood + (3 * self.k - 1) * math.log(self.n)


def fit_mixtures(df: DataFrame, column: str, ks: Sequence[int] = (1, 2, 3), n_init: int = 5, seed: int = 0) -> list[Mixture]:
    """Best fit of several starts for every k; one component has a closed form.

    The fits pass over value counts, each value weighing its rows, so a step grows with the distinct
    values and not with the rows. Only fitted parameters, a few numbers per model, reach the driver.
    """
    x = F.col(column).cast("double")
    clean = df.select(x.alias("x")).where(x.isNotNull())
    m = clean.agg(F.count("x").alias("n"), F.avg("x").alias("mu"), F.var_pop("x").alias("v")).first()
    out: list[Mixture] = []
    if 1 in ks:
        loglik = -0.5 * m["n"] * (math.log(2 * math.pi * m["v"]) + 1.0)
        out.append(Mixture(m["n"], loglik, (Component(1.0, m["mu"], math.sqrt(m["v"])),)))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(value_counts(df, column)).select("features", F.col("n").cast("double").alias("n"))
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        starts = [(k, seed + i) for k in ks if k > 1 for i in range(n_init)]
        # independent fits; threads only submit their jobs, the work runs on the executors
        with ThreadPoolExecutor(max_workers=min(8, len(starts) or 1)) as pool:
            fits = list(pool.map(
                inheritable_thread_target(df.sparkSession)(lambda a: GaussianMixture(k=a[0], seed=a[1], maxIter=200, tol=0.01, weightCol="n").fit(vectors)), starts))
        for k in [k for k in ks if k > 1]:
            best = max(
                (m for (kk, _), m in zip(starts, fits) if kk == k), key=lambda m: m.summary.logLikelihood)
            parts = sorted(
                (Component(float(w), float(g.mean[0]), math.sqrt(float(g.cov.toArray()[0][0])))
                 for w, g in zip(best.weights, best.gaussians)),
                key=lambda c: c.mean,
            )
            out.append(Mixture(m["n"], float(best.summary.logLikelihood), tuple(parts)))
    finally:
        vectors.unpersist()
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Stored (x, n): each value with its number of rows, which is all that a fit of one column needs."""
    x = F.col(column).cast("double")
    return materialize(df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x)).groupBy("x").agg(F.count(F.lit(1)).alias("n")), "value-counts")


def em_step(counts: DataFrame, parts: Sequence[Component]) -> tuple[float, list[Component]]:
    """Log-likelihood at ``parts`` and the components that follow from their posteriors, in one aggregate over (x, n)."""
    # the parameters are one constant array, and the text of the step is parsed once by Spark
    named = ", ".join(
        f"struct({math.log(c.weight) - math.log(c.sd) - 0.5 * math.log(2 * math.pi)!r}D AS a, {c.mean!r}D AS m, {c.sd!r}D AS s)" for c in parts)
    rows = counts.selectExpr("x", "n", f"array({named}) AS c").selectExpr(
        "x", "n", "transform(c, v -> v.a - pow((x - v.m) / v.s, 2) / 2) AS d", "transform(c, v -> x - v.m) AS o")
    rows = rows.selectExpr("n", "d", "o", "array_max(d) AS top").selectExpr("n", "o", "top", "transform(d, v -> exp(v - top)) AS e")
    rows = rows.selectExpr("n", "o", "top", "e", "aggregate(e, 0D, (a, v) -> a + v) AS t")
    sums = ["sum(n * (top + ln(t))) AS l", "sum(n) AS n"]
    for i in range(len(parts)):
        sums += [f"sum(n * e[{i}] / t) AS r{i}", f"sum(n * e[{i}] / t * o[{i}]) AS s{i}", f"sum(n * e[{i}] / t * o[{i}] * o[{i}]) AS q{i}"]
    found = [float(v or 0.0) for v in rows.selectExpr(*sums).first()]
    loglik, n, new = found[0], found[1], []
    for i, c in enumerate(parts):
        r, shift, square = found[2 + 3 * i : 5 + 3 * i]
        if r <= 0:
            new.append(c)
            continue
        move = shift / r
        new.append(Component(max(r / n, 1e-12), c.mean + move, math.sqrt(max(square / r - move * move, 1e-12))))
    return loglik, new


def _extrapolated(a: Sequence[Component], b: Sequence[Component], c: Sequence[Component]) -> list[Component]:
    """A long step along three successive EM iterates: the squared iterative method's steplength on log weights, means and log sds."""
    def flat(parts: Sequence[Component]) -> list[float]:
        return [v for p in parts for v in (math.log(p.weight), p.mean, math.log(p.sd))]
    x, y, z = flat(a), flat(b), flat(c)
    first = [q - p for p, q in zip(x, y)]
    bend = [(r - q) - f for q, r, f in zip(y, z, first)]
    length = math.hypot(*bend)
    step = min(-1.0, -math.hypot(*first) / length) if length > 0 else -1.0
    to = [p - 2 * step * f + step * step * g for p, f, g in zip(x, first, bend)]
    weights = [math.exp(min(v, 50.0)) for v in to[0::3]]
    total = sum(weights)
    return [Component(max(w / total, 1e-12), m, math.exp(max(min(s, 50.0), -14.0))) for w, m, s in zip(weights, to[1::3], to[2::3])]


def largest_move(before: Sequence[Component], after: Sequence[Component]) -> float:
    """The greatest change of a weight, of a mean in sds or of an sd in sds."""
    return max(max(abs(a.weight - b.weight), abs(a.mean - b.mean) / b.sd, abs(a.sd - b.sd) / b.sd) for a, b in zip(before, after))


def fit_counts(counts: DataFrame, k: int = 2, *, steps: int = 300, tol: float = 1e-4) -> Mixture:
    """Mixture of ``k`` components by expectation maximisation over (x, n), the same on every run.

    Components start at equally spaced quantiles with the sd of all values. Two steps are followed
    by a long one along them, which is kept if the likelihood does not fall. It ends when no
    parameter moves by more than ``tol`` (see :func:`largest_move`) or after ``steps``. An empty
    table is an error. The driver sees sums only.
    """
    whole = counts.agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mu"),
                       (F.sum(F.col("x") * F.col("x") * F.col("n")) / F.sum("n")).alias("square")).first()
    if not whole["n"]:
        raise ValueError("no values to fit")
    sd = math.sqrt(max(whole["square"] - whole["mu"] ** 2, 1e-12))
    marks = quantiles(counts, "x", {f"q{i}": (i + 0.5) / k for i in range(k)}, weight="n").select("*").first()
    parts = [Component(1.0 / k, float(marks[f"q{i}"]), sd) for i in range(k)]
    loglik = 0.0
    for _ in range(steps // 3):
        _, one = em_step(counts, parts)
        reached, two = em_step(counts, one)
        if largest_move(two, one) <= tol:
            loglik, parts = reached, two
            break
        far = _extrapolated(parts, one, two)
        if all(whole["lo"] <= c.mean <= whole["hi"] and c.sd <= 4 * sd for c in far):
            loglik, ahead = em_step(counts, far)
            # a long step that loses likelihood is not taken
            two = ahead if loglik >= reached else two
        parts = two
    return Mixture(int(whole["n"]), loglik, tuple(sorted(parts, key=lambda c: c.mean)))


def mixture_rows(spark, models: Sequence[Mixture]) -> DataFrame:
    """Fitted models as rows: k, BIC, component number, weight, mean, sd."""
    rows = [
        (m.k, m.bic, m.log_likelihood, i, c.weight, c.mean, c.sd)
        for m in models for i, c in enumerate(m.components)
    ]
    return spark.createDataFrame(
        rows, "k int, bic double, log_likelihood double, component int, weight double, mean double, sd double")


def _log_density(x: Column, c: Component) -> Column:
    z = (x - F.lit(c.mean)) / F.lit(c.sd)
    return F.lit(math.log(c.weight) - math.log(c.sd)) - z * z / 2


def high_component_posterior(column: str, low: Component, high: Component) -> Column:
    """Probability that a value comes from the high-mean component, as a plain expression."""
    x = F.col(column).cast("double")
    gap = F.least(_log_density(x, low) - _log_density(x, high), F.lit(700.0))
    return 1 / (1 + F.exp(gap))


def is_contaminated(column: str, model: Mixture, *, threshold: float = 0.5, min_separation: float = 2.0) -> Column:
    """Value more likely from the high component, where the two components are truly apart.

    Only values above the clean mean count: a wide component also wins far down the low tail.
    """
    low, high = model.components[0], model.components[-1]
    apart = (high.mean - low.mean) / math.sqrt((low.sd**2 + high.sd**2) / 2) >= min_separation
    if model.k < 2 or not apart:
        return F.lit(False)
    posterior = high_component_posterior(column, low, high)
    return F.coalesce((posterior > threshold) & (F.col(column) > F.lit(low.mean)), F.lit(False))
