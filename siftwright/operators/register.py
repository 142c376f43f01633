"""Issue register, its roll-ups, and reconciliation of claimed against computed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..sources.sinks import REGISTER_COLUMNS
from .integrity import union_all
from .profile import row_count


def issue(
    *,
    issue_id: str,
    table: str,
    fields: str,
    issue: str,
    severity: str,
    rule: str,
    resolution: str,
    affected: Column,
    total: Column,
    evidence: Column,
) -> Column:
    """One register entry over the columns of a detector's one-row aggregate; its text is computed.

    The share is rounded as SQL engines round a double: scaled, to the next whole number, scaled back. Spark's own
    ``round`` takes the shortest decimal text, which on a half goes the other way where scaling falls below it.
    """
    share = F.try_divide(affected * 100.0, total)
    return F.struct(
        F.lit(issue_id).alias("issue_id"), F.lit(table).alias("table"), F.lit(fields).alias("fields"),
        F.lit(issue).alias("issue"), affected.cast("bigint").alias("affected_rows"),
        (F.round(share * 1000, 0) / 1000).alias("affected_pct"),
        F.lit(severity).alias("severity"), evidence.alias("evidence"), F.lit(rule).alias("rule"),
        F.lit(resolution).alias("resolution"),
    )


def register_rows(row: DataFrame, issues: Sequence[Column]) -> DataFrame:
    """Several entries read off one aggregate, so rules on the same table share its scan."""
    return row.select(F.inline(F.array(*issues)))


def build_register(rows: Sequence[DataFrame]) -> DataFrame:
    return union_all(rows).select(*REGISTER_COLUMNS)


def roll_up(register: DataFrame, by: str) -> DataFrame:
    """Issues and affected rows per severity or resolution."""
    return register.groupBy(by).agg(row_count().alias("issues"), F.sum("affected_rows").alias("affected_rows"))


def reconcile(metrics: DataFrame, expectations: DataFrame) -> DataFrame:
    """Compare metrics (name, value) with expectations (name, expected, tolerance).

    An expectation without a metric, or with a NULL one, fails.
    """
    joined = expectations.join(metrics.select("name", F.col("value").alias("actual")), "name", "left")
    passed = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    return joined.select("name", "expected", "actual", "tolerance", passed.alias("passed"))


def claims(spark: SparkSession, values: Mapping[str, float | None], *, name: str = "name", value: str = "value") -> DataFrame:
    """Named numbers, such as the metrics observed during writes, as rows; a dozen or two, never data."""
    rows = [(n, None if v is None else float(v)) for n, v in values.items()]
    return spark.createDataFrame(rows, f"`{name}` string, `{value}` double")


def clean_bill(checks: DataFrame) -> DataFrame:
    """The checks that passed."""
    return checks.where("passed").select("name", "actual")


def require_all(checks: DataFrame) -> DataFrame:
    """Fail loudly when a check failed: all failures are written as a table, and the error names it and their number."""
    failed = checks.where("not passed")
    n = failed.count()
    if n:
        path = scratch_path(checks.sparkSession, "failed-checks")
        failed.write.parquet(path)
        raise ValueError(f"reconciliation failed: {n} checks, listed in {path}")
    return checks
