"""Small column builders; all of them stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``num / den`` where the denominator is positive, else ``default`` (None gives NULL)."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(default).cast("double"))


def digit_mask(c: Column | str) -> Column:
    """Shape of a string: every digit shown as 9."""
    return F.regexp_replace(col(c), "[0-9]", "9")


def normalised(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def is_month_end(d: Column | str) -> Column:
    return F.last_day(col(d)) == F.to_date(col(d))


def tenure_months(start: Column | str, end: Column | str) -> Column:
    """Whole months between two dates at 30.44 days a month, rounded half to even."""
    return F.rint(F.datediff(col(end), col(start)) / F.lit(30.44))


def swap_month_day(d: Column | str) -> Column:
    """The date read the other way round (day as month); NULL where that is no date."""
    d = col(d)
    return F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d)))


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of the MD5 of the parts joined by ':' - the same number in any engine."""
    text = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def adjusted_skewness(c: Column | str) -> Column:
    """Bias-corrected sample skewness (aggregate)."""
    n = F.count(col(c)).cast("double")
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(c: Column | str) -> Column:
    """Bias-corrected sample excess kurtosis (aggregate)."""
    n = F.count(col(c)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(c)) + 6))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation, NULL when either side is constant (aggregate)."""
    # the built-in corr divides by zero on a constant before any guard around it is looked at
    both = col(x).isNotNull() & col(y).isNotNull()
    xs, ys = F.when(both, col(x)).cast("double"), F.when(both, col(y)).cast("double")
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def ols_slope(v: Column | str, t: Column | str) -> Column:
    """Least-squares slope of ``v`` on ``t``; 0 for a constant or one-point series (aggregate).

    A slope within rounding error of the values counts as 0, so that its sign means something.
    """
    v, t = col(v).cast("double"), col(t).cast("double")
    flat = (F.min(v) == F.max(v)) | (F.min(t) == F.max(t))
    slope = F.regr_slope(v, t)
    residue = F.abs(slope) <= F.max(F.abs(v)) * F.lit(1e-12)
    return F.when(flat | residue, F.lit(0.0)).otherwise(slope)


def trend_r2(v: Column | str, t: Column | str) -> Column:
    """R squared of that fit; 0 for a constant or one-point series (aggregate)."""
    v, t = col(v).cast("double"), col(t).cast("double")
    flat = (F.min(v) == F.max(v)) | (F.min(t) == F.max(t))
    return F.when(flat, F.lit(0.0)).otherwise(F.regr_r2(v, t))


def half_ratio(first: Column | str, last: Column | str) -> Column:
    """Late level over early level; NULL when the early level is not positive."""
    return safe_ratio(last, first, None)


def utc_instant(c: Column | str) -> Column:
    """A zone-less timestamp read as UTC, whatever the session's zone (watermarks need an instant)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col(c)).cast("timestamp")


def utc_day(c: Column | str) -> Column:
    """UTC calendar day of an instant as text, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(col(c), F.current_timezone()), "yyyy-MM-dd")
