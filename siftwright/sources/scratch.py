"""Where intermediate tables live.

A cluster names a shared folder in ``spark.checkpoint.dir``; everything that has to outlive an
executor is written below it. Only a session on one machine (master ``local``) may leave it
unset; then a temporary folder is made and set, and removed with the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_stored: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables; an error where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"master {master} needs a folder that all machines share: set spark.checkpoint.dir")
    local = tempfile.mkdtemp(prefix="siftwright-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses; :func:`release` removes what is there."""
    path = f"{checkpoint_root(spark)}/siftwright/{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Remove the tables this process has stored (from number ``since`` on) and say how many; no DataFrame may need them any more."""
    jvm = spark._jvm
    n = 0
    while len(_stored) > since:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``make`` returns and remove every table that was stored on the way to it."""
    before = len(_stored)
    df = make()
    result = materialize(df, name)
    kept = _stored.pop()
    release(df.sparkSession, before)
    _stored.append(kept)
    return result
