"""Session settings used by tests and the benchmark; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, *, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("siftwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory or os.environ.get("SIFTWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def side_session(spark: SparkSession) -> SparkSession:
    """Another session of the same application with the same settings.

    A session that has observed metrics can no longer be serialised, and Spark ML ships the session with
    the training summary of a model; so observed writes run beside the session in which models are fitted.
    """
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if side.conf.isModifiable(key):
            side.conf.set(key, value)
    return side
