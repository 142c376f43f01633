"""Tail probabilities for result rows.

Spark has no error function, Student-t, chi-square or Kolmogorov tail. These four Arrow-batched
functions are meant for the few rows an aggregate leaves, never for the fact rows beneath it.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors need not have this package installed: the functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_regularized(df / 2.0, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    """P(X >= x): series below the mean, continued fraction above it."""
    if x <= 0.0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1.0
            term *= y / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = y + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    total = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        total *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * total


def kolmogorov_upper(d: float, n: float) -> float:
    """Asymptotic P(D_n >= d) from the Kolmogorov distribution."""
    z = d * math.sqrt(n)
    if z < 0.3:
        return 1.0
    s = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * z * z) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * s))


def _one(fn):
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else fn(float(v)) for v in x], dtype="float64")
    return apply


def _two(fn):
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(v) or pd.isna(w) else fn(float(v), float(w)) for v, w in zip(x, y)],
            dtype="float64",
        )
    return apply


def _pandas(fn, series: int):
    if series == 1:
        def body(x: pd.Series) -> pd.Series:
            return _one(fn)(x)
    else:
        def body(x: pd.Series, y: pd.Series) -> pd.Series:
            return _two(fn)(x, y)
    return F.pandas_udf(body, T.DoubleType())


norm_cdf = _pandas(normal_cdf, 1)
student_t_sf = _pandas(student_t_two_sided, 2)
chi2_sf = _pandas(chi2_upper, 2)
kolmogorov_sf = _pandas(kolmogorov_upper, 2)
