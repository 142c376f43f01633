"""The batch rules at ingestion: the same column expressions on a stream.

State is bounded by a watermark in every stateful operator. Sinks are file tables, so results of
any size stay on the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import edges_passed
from ..operators.monitor import bin_counts, psi_of_counts
from ..sources.scratch import scratch_path


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, *, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, in the order they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, name: str, *, schema_of: DataFrame | None = None) -> DataFrame:
    """Process what is there, append it to a table in the shared folder and return that table."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/data")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema((schema_of or stream).schema).parquet(f"{base}/data")


def run_to_end(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Process an ended source and return the last state of every window, also of those no watermark has closed.

    Each micro-batch writes the windows it changed to a folder of its own, overwritten if the
    batch is tried again; of a window's rows the one of the latest batch counts.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(f"{base}/data")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("r"))
    return last.select(*keys, "r.*").select(*stream.columns)


def flag_rows(stream: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Row-level rules; stateless, so they need no watermark."""
    return stream.withColumns(dict(flags))


def drop_repeats(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row of a key within the watermark; later repeats are dropped, old keys are forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def window_profile(stream: DataFrame, column: str, time: str, window: str, delay: str) -> DataFrame:
    """Rows, NULLs, negatives, mean and sd per tumbling window, emitted once the window is closed."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"))
    x = F.col(column)
    return w.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_if(x < 0).alias("negatives"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "nulls", "negatives", "mean", "sd")


def window_psi(stream: DataFrame, reference: DataFrame, metrics: Sequence[str], time: str, window: str, delay: str, bins: int = 10) -> DataFrame:
    """Stability index per metric and window against a fixed reference.

    ``reference`` comes from :func:`siftwright.operators.monitor.reference_bins`, written as a
    table: one row per metric, so it is sent to every task.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = stream.withWatermark(time, delay).select(time, F.inline(cells)).where("value is not null")
    edges = reference.select("metric", "edges")
    placed = long.join(F.broadcast(edges), "metric").withColumn("bin", edges_passed(F.col("edges"), F.col("value"), bins))
    counts = placed.groupBy(F.window(time, window).alias("w"), "metric").agg(
        bin_counts(bins).alias("counts"), F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(reference), "metric").select(
        "metric", F.col("w.start").alias("window_start"), "n",
        psi_of_counts(F.col("edges"), F.col("ref_counts"), F.col("counts")).alias("psi"))


def flag_before_start_stream(stream: DataFrame, entity: DataFrame, *, key: str, entity_key: str, time: str, start: str, flag: str = "dq_before_start") -> DataFrame:
    """Stream-static join with the entity table; rows of unknown entities stay unflagged."""
    starts = entity.select(F.col(entity_key).alias("__k"), F.col(start).alias("start_date"))
    joined = stream.join(starts, stream[key] == F.col("__k"), "left").drop("__k")
    return joined.withColumn(flag, F.coalesce(F.col(time) < F.col("start_date"), F.lit(False)))
