"""The package's code on the executors, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of ``spark`` once; code only, through Spark's own file service."""
    context = spark.sparkContext
    if getattr(context, "_siftwright_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="siftwright-code-"), "siftwright_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("siftwright", os.path.relpath(path, top)))
    context.addPyFile(archive)
    context._siftwright_shipped = True
