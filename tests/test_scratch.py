"""Stored tables: where they go and that they can be removed."""

import os

import pytest

from siftwright.sources import scratch


class Master:
    """A session of a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.checkpoint_root(Master())


def test_stored_tables_are_removed(spark, tmp_path):
    kept = list(scratch._stored)
    scratch._stored.clear()
    try:
        stored = scratch.materialize(spark.range(10), "ten")
        path = scratch._stored[-1]
        assert stored.count() == 10 and os.path.isdir(path)
        assert scratch.release(spark) == 1
        assert not os.path.exists(path) and not scratch._stored
    finally:
        scratch._stored.extend(kept)


def test_only_the_result_stays(spark):
    kept = list(scratch._stored)
    scratch._stored.clear()
    try:
        def make():
            a = scratch.materialize(spark.range(10), "a")
            return scratch.materialize(a.where("id > 3"), "b").where("id < 8")

        result = scratch.settle(make, "c")
        assert [r.id for r in result.orderBy("id").collect()] == [4, 5, 6, 7]
        assert len(scratch._stored) == 1 and "/c-" in scratch._stored[0]
        folder = os.path.dirname(scratch._stored[0])
        assert not [n for n in os.listdir(folder) if n.startswith(("a-", "b-"))]
    finally:
        scratch.release(spark)
        scratch._stored.extend(kept)
