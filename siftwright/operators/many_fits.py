"""Many logistic fits over the same rows at once: all labels and folds share each pass.

A shuffled-label null needs one fit for every (draw, fold). Fitted one by one, each of them passes over
the rows until it has converged. Here a row carries its features once, with an array of labels and an
array of folds, one entry per draw. A pass adds up gradient and curvature of every fit at its present
coefficients, inside each task first; the driver sees the sums (fits x features^2 numbers), takes a Newton
step in each fit and starts the next pass. About eight passes serve all fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ManyFits:
    """Coefficients on (x - mean) / sd, intercept first: ``beta[draw * k + fold]`` was fitted without that fold."""

    mean: np.ndarray
    sd: np.ndarray
    beta: np.ndarray
    k: int
    passes: int

    def raw(self, draw: int, fold: int) -> tuple[float, np.ndarray]:
        """Intercept and coefficients on the features as they are."""
        slope = self.beta[draw * self.k + fold][1:] / self.sd
        return float(self.beta[draw * self.k + fold][0] - slope @ self.mean), slope


def _sums(rows: DataFrame, width: int, fits: int, add: Callable) -> np.ndarray:
    """Sum of ``add(x, y, f)`` over all rows: a (fits, width) table, added up in each task and then by place."""

    def task(batches):
        total = np.zeros((fits, width))
        for b in batches:
            if len(b):
                total += add(np.stack(b["x"]), np.stack(b["ys"]), np.stack(b["fs"]))
        yield _frame(total)

    def _frame(total):
        import pandas as pd

        return pd.DataFrame({"fit": np.arange(len(total), dtype=np.int32), "part": list(total)})

    parts = rows.select("x", "ys", "fs").mapInPandas(task, "fit int, part array<double>")
    places = parts.select("fit", F.posexplode("part").alias("at", "v"))
    summed = places.groupBy("fit", "at").agg(F.sum("v").alias("v"))
    found = summed.toPandas()
    out = np.zeros((fits, width))
    out[found["fit"], found["at"]] = found["v"]
    return out


def fit_many(rows: DataFrame, draws: int, k: int, *, c: float = 1.0, tol: float = 1e-9, max_passes: int = 60, own_rows: bool = False) -> ManyFits:
    """L2 logistic regressions of every draw's labels without each of its folds.

    ``rows`` holds ``features`` (vector), ``x`` (the same as an array), ``ys`` and ``fs``: per draw a label 0 or 1
    and a fold 0..k-1. Each fit has the optimum of :func:`models.logistic` on its training rows: features are
    scaled by the training rows' own deviation, a feature without spread there has no weight, the intercept is
    free, and the penalty counts n * (k - 1) / k rows, or with ``own_rows`` each fit's own. A fit ends at a gradient of at most ``tol`` per training row;
    a step that raises a fit's loss is halved. Fits that have not ended after ``max_passes`` are an error.
    """
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit on")
    whole = rows.agg(Summarizer.mean(F.col("features")).alias("mean"), Summarizer.std(F.col("features")).alias("sd")).first()
    mean, sd = whole["mean"].toArray(), whole["sd"].toArray()
    sd = np.where(sd > 0, sd, 1.0)
    d, fits = len(mean), draws * k
    upper = np.triu_indices(d + 1)

    def held_moments(x, y, f):
        z = (x - mean) / sd
        out = np.zeros((fits, 1 + 2 * d))
        for t in range(draws):
            for fold in range(k):
                part = z[f[:, t] == fold]
                out[t * k + fold] = np.concatenate([[len(part)], part.sum(axis=0), (part * part).sum(axis=0)])
        return out

    held = _sums(rows, 1 + 2 * d, fits, held_moments).reshape(draws, k, -1)
    train = (held.sum(axis=1, keepdims=True) - held).reshape(fits, -1)
    m = train[:, 0]
    if (m < 2).any():
        raise ValueError("a fold leaves fewer than two rows to fit on")
    spread = (train[:, 1 + d:] - train[:, 1:1 + d] ** 2 / m[:, None]) / (m - 1)[:, None]
    fixed = np.concatenate([np.zeros((fits, 1), bool), spread <= 1e-12], axis=1)
    counted = m if own_rows else np.full(fits, n * (k - 1) / k)
    penalty = np.concatenate([np.zeros((fits, 1)), spread * (m / (c * counted))[:, None]], axis=1)

    def at(beta):
        def add(x, y, f):
            z = np.concatenate([np.ones((len(x), 1)), (x - mean) / sd], axis=1)
            out = np.zeros((fits, 1 + d + 1 + len(upper[0])))
            for i in range(fits):
                inside = f[:, i // k] != i % k
                zi, yi = z[inside], y[inside, i // k]
                margin = zi @ beta[i]
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                curve = (zi * (p * (1 - p))[:, None]).T @ zi
                out[i, 0] = (np.logaddexp(0.0, margin) - yi * margin).sum()
                out[i, 1:d + 2] = zi.T @ (p - yi)
                out[i, d + 2:] = curve[upper]
            return out

        return add

    good = np.zeros((fits, d + 1))
    best = np.full(fits, np.inf)
    trial = good.copy()
    done = np.zeros(fits, bool)
    for step in range(1, max_passes + 1):
        s = _sums(rows, 1 + d + 1 + len(upper[0]), fits, at(trial))
        loss = s[:, 0] + 0.5 * (penalty * trial * trial).sum(axis=1)
        for i in np.flatnonzero(~done):
            if loss[i] > best[i] + 1e-9 * abs(best[i]):
                trial[i] = (good[i] + trial[i]) / 2
                continue
            best[i], good[i] = loss[i], trial[i]
            slope = np.where(fixed[i], 0.0, s[i, 1:d + 2] + penalty[i] * trial[i])
            if np.abs(slope).max() <= tol * m[i]:
                done[i] = True
                continue
            curve = np.zeros((d + 1, d + 1))
            curve[upper] = s[i, d + 2:]
            curve = curve + np.triu(curve, 1).T + np.diag(penalty[i])
            free = np.ix_(~fixed[i], ~fixed[i])
            trial[i, ~fixed[i]] = good[i, ~fixed[i]] - np.linalg.lstsq(curve[free], slope[~fixed[i]], rcond=None)[0]
        if done.all():
            return ManyFits(mean, sd, good, k, step)
    raise RuntimeError(f"{int((~done).sum())} of {fits} fits have not ended after {max_passes} passes")


def held_out_scores(rows: DataFrame, fits: ManyFits, draws: int) -> DataFrame:
    """(draw, label, score) of every row in every draw, by the fit that did not see the row; one pass."""
    mean, sd, beta, k = fits.mean, fits.sd, fits.beta, fits.k

    def task(batches):
        import pandas as pd

        for b in batches:
            if not len(b):
                continue
            y, f = np.stack(b["ys"]), np.stack(b["fs"])
            z = np.concatenate([np.ones((len(b), 1)), (np.stack(b["x"]) - mean) / sd], axis=1)
            for t in range(draws):
                margin = np.einsum("ij,ij->i", z, beta[t * k + f[:, t]])
                yield pd.DataFrame({
                    "draw": np.full(len(b), t, np.int32), "label": y[:, t].astype(np.int32),
                    "score": 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))})

    return rows.select("x", "ys", "fs").mapInPandas(task, "draw int, label int, score double")
