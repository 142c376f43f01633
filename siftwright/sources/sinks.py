"""Table writers and the post-write check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Column order of the issue register.
REGISTER_COLUMNS = [
    "issue_id", "table", "fields", "issue", "affected_rows", "affected_pct",
    "severity", "evidence", "rule", "resolution",
]


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a cleaned or result table; CSV output carries a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_observed(df: DataFrame, path: str, metrics: Mapping[str, Column]) -> tuple[DataFrame, dict[str, object]]:
    """Write ``df`` and aggregate its rows on their way to the files: the table as written, and the metrics seen.

    The aggregate rides on the writing tasks, so it costs no further pass; a repeated task is counted once.
    A table without rows gives the metrics of no rows. Where models are fitted too, ``df`` should come from
    :func:`siftwright.session.side_session`.
    """
    seen = Observation()
    columns = [m.alias(name) for name, m in metrics.items()]
    df.observe(seen, *columns).write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    # an input that is known to be empty is planned away together with its observation
    return written, seen.get or df.limit(0).agg(*columns).first().asDict()


def write_routed(routed: DataFrame, path: str, *, route: str = "route") -> dict[str, DataFrame]:
    """One write of all rows, dealt into a folder for each route; every route as a table of its own."""
    routed.write.mode("overwrite").partitionBy(route).parquet(path)
    written = routed.sparkSession.read.schema(routed.schema).parquet(path)
    names = [r[0] for r in written.select(route).distinct().collect()]  # few by nature
    return {n: written.where(F.col(route) == n).drop(route) for n in names}


def write_dated(df: DataFrame, path: str, run_date: str, *, name: str = "run_date") -> DataFrame:
    """Add the results of one run date to ``path``; those of the same date are replaced, other dates stay as they are.

    Returns all dates. ``run_date`` is an ISO date.
    """
    date.fromisoformat(run_date)
    dated = df.withColumn(name, F.lit(run_date).cast("date"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return df.sparkSession.read.schema(dated.schema).parquet(path)


def write_register(register: DataFrame, path: str) -> None:
    """Issue register in its fixed column order; one row per rule, so one file."""
    register.select(*REGISTER_COLUMNS).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One-row nested summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_scores(scores: DataFrame, path: str, *, key: str, score: str) -> None:
    """Scored entities: key and probability only."""
    scores.select(key, score).write.mode("overwrite").parquet(path)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique_key(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Re-read a written parquet table and fail when its key repeats."""
    written = spark.read.parquet(path)
    if not duplicate_keys(written, key).isEmpty():
        raise ValueError(f"key {list(key)} is not unique in {path}")
    return written
