"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size. In a block every dimension has its list of
vectors sorted by component. For one query the lists are read from the end that its weight
favours, a step deeper at a time; every vector met is scored in full at once. No unseen vector
can score more than the sum of weight times component at the current depth; when that bound
cannot beat the kth best score so far, the block is done. The best k of all blocks are the
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ship import ship
from .text import bind

BLOCK = 8192
QUERY_BLOCK = 512
_STEP = 128


def grid_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if the vector or any component is null or not finite."""
    def whole_numbers(v: Column) -> Column:
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return F.when(~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))
    return bind(vector, whole_numbers)


class SortedLists:
    """A block's vectors with every dimension's order; ``ids`` rise."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def best(self, query: np.ndarray, own: int | None, k: int) -> tuple[list[tuple[int, int]], int]:
        """Up to ``k`` (score, id), highest first, ties by smaller id, and the depth read."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if not len(dims):
            hits = [(0, int(i)) for i in self.ids[: k + 1] if i != own]
            return hits[:k], 0
        seen = np.zeros(n, bool)
        if own is not None:
            seen[self.ids == own] = True
        weights = query[dims]
        up = weights > 0
        found = np.empty(0, np.int64)
        scores = np.empty(0, self.vectors.dtype)
        depth, step = 0, _STEP
        while depth < n:
            to = min(n, depth + step)
            # the favoured end of each list: from the top for positive weights, from the bottom for negative ones
            met = np.concatenate((self.order[n - to : n - depth][:, dims[up]].ravel(), self.order[depth:to][:, dims[~up]].ravel()))
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            found = np.concatenate((found, new))
            scores = np.concatenate((scores, self.vectors[new] @ query))
            if len(found) > k:
                top = np.lexsort((found, -scores))[:k]
                found, scores = found[top], scores[top]
            depth, step = to, step * 2
            if depth < n and len(found) >= k:
                edge = np.where(up, self.sorted[n - depth - 1, dims], self.sorted[depth, dims])
                # an unseen vector of equal score could still have the smaller id
                if weights @ edge < scores.min():
                    break
        top = np.lexsort((found, -scores))[:k]
        return [(int(scores[i]), int(self.ids[found[i]])) for i in top], depth


def _block_best(k: int):
    def run(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(block):
            q = np.array(queries["v"].tolist(), np.int64)
            c = np.array(block["v"].tolist(), np.int64)
            # products of whole numbers are exact in double precision below 2 ** 53
            most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
            kind = np.float64 if most < 2.0**53 else np.int64
            lists = SortedLists(block["id"].to_numpy(), c.astype(kind))
            for own, vector in zip(queries["id"].tolist(), q.astype(kind)):
                out += [(own, i, s) for s, i in lists.best(vector, own, k)[0]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, *, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score``: each query's ``k`` best by integer inner product.

    Both tables hold ``id`` (long) and ``v`` (array of long, no nulls in it). Ties go to the
    smaller id; a vector of the query's own id is left out; all others are returned where
    there are fewer than ``k``. Rows with a null id or vector take no part; vectors meet those of
    equal length only. Of repeated ids one row, the least vector, counts. Queries and vectors
    are dealt into blocks by hash, and each pair of blocks is one group of bounded size.
    """
    ship(vectors.sparkSession)
    queries, vectors = (t.select("id", "v").where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v")) for t in (queries, vectors))
    query_blocks = max(1, -(-queries.count() // query_block))
    blocks = max(1, -(-vectors.count() // block))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumns({"dims": F.size("v"), "qb": place(query_blocks)}).withColumn("cb", spread(blocks))
    c = vectors.withColumns({"dims": F.size("v"), "cb": place(blocks)}).withColumn("qb", spread(query_blocks))
    on = ["dims", "qb", "cb"]
    hits = q.groupBy(*on).cogroup(c.groupBy(*on)).applyInPandas(_block_best(k), "query_id long, vec_id long, score long")
    # a query's rows here: k for each block
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
