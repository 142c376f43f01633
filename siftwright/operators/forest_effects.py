"""What features do to the scores of forests of :mod:`many_trees`: rows with other rows' values, in bins, a byte a feature.

A part is a block of pairs of a row and a donor, with every mixed vector whose score is wanted; ``forest_sums`` scores the
parts where they meet the stored trees. Neither the driver nor a task holds the forest of more than one fold.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .many_trees import BLOCK_ROWS, Growth, _mix, forest_sums, in_bins

# executors need not have this package installed: the functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def binned_rows(rows: DataFrame, g: Growth) -> DataFrame:
    """``rows`` with the bins of their array ``x`` in its place, as bytes."""
    def task(batches):
        for b in batches:
            if len(b):
                yield b.assign(x=[r.tobytes() for r in in_bins(np.stack(b["x"]), g.edges)])

    kinds = {**dict(rows.dtypes), "x": "binary"}
    return rows.mapInPandas(task, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))


def _vectors(column, width: int) -> np.ndarray:
    """A row for each value of a column of equally long byte strings."""
    import pyarrow as pa

    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].reshape(-1, width)


def _scored(parts: DataFrame, trees: DataFrame, g: Growth, name: str) -> DataFrame:
    parts = materialize(parts.withColumn("id", F.monotonically_increasing_id()), name)
    return parts.drop("bins").join(forest_sums(parts, trees, g), "id").drop("id")


def swapped_scores(pairs: DataFrame, trees: DataFrame, g: Growth) -> DataFrame:
    """(fold, j, rep, label, score) of every pair (fold, rep, label, x, z) with feature j taken from ``z``; j is -1 for ``x`` itself, in repeat 0 only."""
    d = g.width

    def mixed(batches):
        import pyarrow as pa

        for batch in batches:
            fold, rep, label = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("fold", "rep", "label"))
            x, z = (_vectors(batch.column(c), d) for c in ("x", "z"))
            for f in np.unique(fold):
                inside = np.flatnonzero(fold == f)
                for i in range(0, len(inside), BLOCK_ROWS // (d + 1)):
                    at = inside[i:i + BLOCK_ROWS // (d + 1)]
                    rows = np.repeat(x[at][:, None, :], d + 1, axis=1)
                    for j in range(d):
                        rows[:, j + 1, j] = z[at, j]
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int32()), **{
                        c: pa.array([v.tobytes()], pa.binary()) for c, v in (("rep", rep[at]), ("y", label[at]), ("bins", rows))}})

    def task(batches):
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples():
                rep, y = np.frombuffer(b.rep, np.int32), np.frombuffer(b.y, np.int32)
                score = np.frombuffer(b.total).reshape(-1, d + 1) / g.trees
                for j in range(-1, d):
                    inside = rep == 0 if j < 0 else slice(None)
                    yield pd.DataFrame({"fold": b.fold, "j": j, "rep": rep[inside], "label": y[inside], "score": score[inside, j + 1]})

    parts = pairs.select("fold", "rep", "label", "x", "z").mapInArrow(mixed, "fold int, rep binary, y binary, bins binary")
    return _scored(parts, trees, g, "swapped").mapInPandas(task, "fold int, j int, rep int, label int, score double")


def shapley_sums(pairs: DataFrame, key: str, trees: DataFrame, g: Growth, *, repeats: int, seed: int) -> DataFrame:
    """(j, rows, sum_abs): over all rows, the absolute mean contribution of feature j to the row's walks from ``z`` to ``x``.

    ``pairs`` has (key, rep, x, z). A walk takes the features in hash order; the contribution is the change of the score at its step.
    """
    d = g.width
    walks = pairs.groupBy(key).agg(F.collect_list(F.struct("rep", "x", "z")).alias("walks")).select(F.xxhash64(key).alias("h"), "walks")

    def mixed(batches):
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, max(1, BLOCK_ROWS // ((d + 1) * repeats))):
                batch = whole.slice(i, max(1, BLOCK_ROWS // ((d + 1) * repeats)))
                lists = batch.column("walks")
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                walk = lists.flatten()
                rep = walk.field("rep").to_numpy(zero_copy_only=False).astype(np.uint64)
                x, z = (_vectors(walk.field(c), d) for c in ("x", "z"))
                h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)[owner]
                start = _mix(h + _mix(rep + _mix(np.full(len(rep), seed, np.uint64))))
                rank = _mix(start[:, None] + np.arange(d, dtype=np.uint64)).argsort(axis=1).argsort(axis=1).astype(np.uint8)
                steps = rank[:, None, :] < np.arange(d + 1)[None, :, None]
                rows = np.where(steps, x[:, None, :], z[:, None, :])
                yield pa.RecordBatch.from_pydict({"fold": pa.array([0], pa.int32()), "rows": pa.array([batch.num_rows], pa.int64()), **{
                    c: pa.array([v.tobytes()], pa.binary()) for c, v in (("owner", owner.astype(np.int32)), ("rank", rank), ("bins", rows))}})

    def task(batches):
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples():
                owner, rank = np.frombuffer(b.owner, np.int32), np.frombuffer(b.rank, np.uint8).reshape(-1, d)
                gained = np.diff(np.frombuffer(b.total).reshape(-1, d + 1), axis=1) / g.trees
                of = np.take_along_axis(gained, rank.astype(np.int64), axis=1)
                means = [np.abs(np.bincount(owner, of[:, j], b.rows) / repeats).sum() for j in range(d)]
                yield pd.DataFrame({"j": np.arange(d, dtype=np.int32), "rows": b.rows, "sum_abs": means})

    parts = walks.mapInArrow(mixed, "fold int, rows bigint, owner binary, rank binary, bins binary")
    sums = _scored(parts, trees, g, "walks").mapInPandas(task, "j int, rows bigint, sum_abs double")
    return sums.groupBy("j").agg(F.sum("rows").alias("rows"), F.sum("sum_abs").alias("sum_abs"))
