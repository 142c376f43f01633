"""Stateful rules over several micro-batches."""

import datetime as dt

from siftwright.functions.scalars import utc_day
from siftwright.sources.scratch import scratch_path
from siftwright.streaming import ingest as N

SCHEMA = "k int, ts timestamp, v double"


def _files(spark, batches):
    folder = scratch_path(spark, "test-stream")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return N.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def _at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_repeats_are_dropped_across_batches(spark):
    stream = _files(spark, [[(1, _at(1), 1.0), (2, _at(1), 1.0)], [(1, _at(1, 1), 2.0), (3, _at(1, 2), 1.0)]])
    out = N.run_available(N.drop_repeats(stream, ["k"], "ts", "10 days"), "test-dedup")
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3]


def test_closed_windows_are_profiled_once(spark):
    stream = _files(spark, [[(1, _at(1), -1.0), (1, _at(1, 5), 3.0)], [(1, _at(2), None), (1, _at(3, 12), 1.0)]])
    out = N.run_available(N.window_profile(stream, "v", "ts", "1 day", "1 hour"), "test-profile")
    got = {r["d"]: (r["n"], r["nulls"], r["negatives"], r["mean"]) for r in out.select(utc_day("window_start").alias("d"), "*").collect()}
    assert got == {"2024-01-01": (2, 0, 1, 1.0), "2024-01-02": (1, 1, 0, None)}
