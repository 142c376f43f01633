"""Register of the queries over the given tables, each beside its check in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
# whole results of fits, which no SQL states; QUERIES has the facts about them that SQL can state
RESULTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``; ``sql`` gives the expected result."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return wrap


def result(name: str):
    """Register a function of :class:`Tables` that has no SQL."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in RESULTS or name in QUERIES:
            raise ValueError(f"result {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        RESULTS[name] = run
        return fn
    return wrap


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison with another engine's last bits; ``special`` per column."""
    return df.select(*[
        F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
