"""Random forests of all folds at once: trees are grown where their rows meet.

A level-wise forest sends a histogram of every open node from every task, at every level. Most nodes are small, so here the
rows travel instead, in a byte a feature. As long as a fold's training rows fit one task (GROUP_BYTES in bins) they go whole to
each task that grows a group of the fold's trees, which draws the bootstraps itself: a row travels once for each group of trees.
Beyond that a row goes to each tree that drew it: the rows of one (fold, tree, node) grow the subtree below that node in one
group of at most ``group_rows`` rows, and larger nodes are first split from histograms, which only they need. Draws come from
hashes of key, tree and node, so a forest does not depend on how the rows are dealt. Trees stay a table: the driver holds none,
and a task that scores holds those of one group.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

# executors need not have this package installed: the functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32  # as Spark's own trees have
GROUP_BYTES = 96 << 20  # hashes, labels and bins of the rows that one task takes whole
GROUP_ROWS = 1 << 18
BLOCK_ROWS = 1 << 16
SENT_BYTES = 1 << 23
TOGETHER = 100  # trees that a task holds when it scores, at most
PIECE = 1 << 15  # rows whose arrays stay in a core's cache
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(18)])
# draws by the first 16 bits of the hash, 255 where these do not decide
_DRAWS = np.searchsorted(_POISSON, np.arange(1 << 16) / float(1 << 16), side="right").astype(np.uint8)
_DRAWS[np.searchsorted(_POISSON, (np.arange(1 << 16) + 1) / float(1 << 16), side="right") != _DRAWS] = 255
_TREE = np.dtype([("node", "<i8"), ("feature", "<i4"), ("cut", "<i4"), ("value", "<f8")])


@dataclass(frozen=True)
class Growth:
    """Numbers of one kind of forest: ``k`` forests of ``trees`` trees, fold f's without the rows of fold f."""

    k: int
    trees: int
    depth: int
    min_leaf: int
    seed: int
    edges: list[np.ndarray]

    @property
    def width(self) -> int:
        return len(self.edges)

    def base(self, fold: int, tree: int) -> np.ndarray:
        return _mix(np.array([(self.seed * self.k + fold) * self.trees + tree + 1], np.uint64))

    def weights(self, hashes: np.ndarray, fold: int, tree: int) -> np.ndarray:
        """How often each row is in the tree's bootstrap: Poisson of mean 1."""
        out = np.empty(len(hashes), np.uint8)
        for i in range(0, len(hashes), PIECE):
            bits = _mix(hashes[i:i + PIECE] + self.base(fold, tree))
            drawn = _DRAWS[bits >> np.uint64(48)]
            open_ = np.flatnonzero(drawn == 255)
            drawn[open_] = np.searchsorted(_POISSON, (bits[open_] >> np.uint64(11)) / float(1 << 53), side="right")
            out[i:i + PIECE] = drawn
        return out

    def choices(self, fold: int, tree: int, nodes: np.ndarray) -> np.ndarray:
        """The features that each node may split on: the square root of all, drawn anew for every node."""
        some = math.ceil(math.sqrt(self.width))
        at = nodes.astype(np.uint64)[:, None] * np.uint64(self.width) + np.arange(self.width, dtype=np.uint64)
        return np.argsort(_mix(at + self.base(fold, tree)), axis=1)[:, :some]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _histogram(bins, w, y, at, chosen) -> tuple[np.ndarray, np.ndarray]:
    """Weight and weight of positives by (node, choice, bin)."""
    (m, some), (n, width) = chosen.shape, bins.shape
    out = np.zeros((some, m * BINS * 2))
    flat, of = bins.reshape(-1), np.ascontiguousarray(chosen.T)
    for i in range(0, n, PIECE):
        node = at[i:i + PIECE]
        slot = node * (2 * BINS) + y[i:i + PIECE]
        row = np.arange(i * width, i * width + len(node) * width, width)
        weight = w[i:i + PIECE].astype(float)
        for s in range(some):
            bin_ = flat.take(of[s].take(node) + row).astype(np.int64)
            bin_ <<= 1
            bin_ += slot
            found = np.bincount(bin_, weight)
            out[s, :len(found)] += found
    parts = out.reshape(some, m, BINS, 2).transpose(1, 0, 2, 3)
    positives = np.ascontiguousarray(parts[..., 1])
    return parts[..., 0] + positives, positives


def _splits(g: Growth, nodes: np.ndarray, chosen: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A record for every node (feature -1: a leaf), and weight and weight of positives that go left: greatest Gini gain, both sides at least ``min_leaf``."""
    all_n, all_p = n[:, 0].sum(axis=1), p[:, 0].sum(axis=1)
    left_n, left_p = n.cumsum(axis=2)[:, :, :-1], p.cumsum(axis=2)[:, :, :-1]
    right_n, right_p = all_n[:, None, None] - left_n, all_p[:, None, None] - left_p

    def impurity(n, p):
        return 2 * p * (n - p) / np.maximum(n, 1)

    gain = impurity(all_n, all_p)[:, None, None] - impurity(left_n, left_p) - impurity(right_n, right_p)
    gain[(left_n < g.min_leaf) | (right_n < g.min_leaf)] = 0
    if int(nodes[0]).bit_length() > g.depth:
        gain[:] = 0
    flat = gain.reshape(len(nodes), -1)
    best, every = flat.argmax(axis=1), np.arange(len(nodes))
    choice, cut = best // (BINS - 1), best % (BINS - 1)
    out = np.empty(len(nodes), _TREE)
    out["node"], out["cut"], out["value"] = nodes, cut, all_p / np.maximum(all_n, 1)
    out["feature"] = np.where(flat[every, best] > 1e-9, chosen[every, choice], -1)
    return out, left_n[every, choice, cut], left_p[every, choice, cut]


def _leaves(nodes: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty(len(nodes), _TREE)
    out["node"], out["feature"], out["cut"], out["value"] = nodes, -1, 0, p / np.maximum(n, 1)
    return out


def _grow(g: Growth, fold: int, tree: int, node: int, bins, w, y) -> np.ndarray:
    """The subtree below ``node`` as records; node n has the children 2 n and 2 n + 1."""
    found: list[np.ndarray] = []
    n = np.array([w.sum(dtype=np.int64)], float)
    p = np.array([w[y > 0].sum(dtype=np.int64)], float)
    _grow_below(g, fold, tree, np.array([node]), n, p, np.ascontiguousarray(bins), w, y, np.zeros(len(w), np.int64), found)
    return np.concatenate(found)


def _grow_below(g: Growth, fold: int, tree: int, nodes, n, p, bins, w, y, at, found: list[np.ndarray]) -> None:
    """Level by level; ``n`` and ``p`` are the nodes' weights, ``at`` is the node of each row. Rows that have reached a leaf stay with weight 0 until they are many."""
    while len(nodes):
        # what cannot be split is not looked for in the rows
        able = (n >= 2 * g.min_leaf) & (p > 0) & (p < n) & (int(nodes[0]).bit_length() <= g.depth)
        found.append(_leaves(nodes[~able], n[~able], p[~able]))
        if not able.any():
            return
        if not able.all():
            bins, w, y, at = _kept(able, bins, w, y, at)
            nodes, n, p = nodes[able], n[able], p[able]
        if len(at) > 2 * PIECE and len(nodes) >= 64:
            # from here on in pieces of neighbouring nodes: a piece's sums stay in the cache
            order = np.argsort(at.astype(np.uint16) if len(nodes) <= 1 << 16 else at, kind="stable")
            bins, w, y, at = bins.take(order, axis=0), w.take(order), y.take(order), at.take(order)
            start = np.searchsorted(at, np.arange(len(nodes) + 1))
            i = 0
            while i < len(nodes):
                j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE, side="right")) - 1)
                rows = slice(start[i], start[j])
                _grow_below(g, fold, tree, nodes[i:j], n[i:j], p[i:j], bins[rows], w[rows], y[rows], at[rows] - i, found)
                i = j
            return
        chosen = g.choices(fold, tree, nodes)
        level, left_n, left_p = _splits(g, nodes, chosen, *_histogram(bins, w, y, at, chosen))
        found.append(level)
        split = level["feature"] >= 0
        bins, w, y, at = _kept(split, bins, w, y, at)
        level, n, p, left_n, left_p = level[split], n[split], p[split], left_n[split], left_p[split]
        if not len(level):
            return
        feature, cut, flat, width = level["feature"].astype(np.int64), level["cut"].astype(np.uint8), bins.reshape(-1), bins.shape[1]
        for i in range(0, len(at), PIECE):
            now = at[i:i + PIECE]
            row = np.arange(i * width, i * width + len(now) * width, width)
            right = flat.take(feature.take(now) + row) > cut.take(now)
            at[i:i + PIECE] = 2 * now + right
        nodes = (level["node"][:, None] * 2 + np.arange(2)).ravel()
        n, p = np.stack([left_n, n - left_n], axis=1).ravel(), np.stack([left_p, p - left_p], axis=1).ravel()


def _kept(stay: np.ndarray, bins, w, y, at) -> tuple[np.ndarray, ...]:
    """The rows of the nodes that ``stay``, whose places close up."""
    if stay.all():
        return bins, w, y, at
    inside = stay.take(at)
    place = (np.cumsum(stay) - 1).take(at)
    if np.count_nonzero(inside) > 0.75 * len(at):
        return bins, np.where(inside, w, 0).astype(w.dtype), y, np.maximum(place, 0)
    rows = np.flatnonzero(inside)
    return bins.take(rows, axis=0), w.take(rows), y.take(rows), place.take(rows)


def _pack(tree: np.ndarray) -> bytes:
    """A whole tree in the order of its nodes: their number, features, cuts, and the values of its leaves."""
    tree = tree[np.argsort(tree["node"], kind="stable")]
    leaf = tree["feature"] < 0
    return b"".join((np.int64(len(tree)).tobytes(), tree["feature"].astype("<i2").tobytes(), tree["cut"].astype(np.uint8).tobytes(), tree["value"][leaf].tobytes()))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """A word for each node, the nodes' values and the depth. A word is the place of the left child, whose neighbour is the right one, then feature and
    cut in 16 and 8 bits; a leaf is its own left child, and no bin is above its cut."""
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    feature = np.frombuffer(packed, "<i2", n, 8).astype(np.int64)
    cut = np.frombuffer(packed, np.uint8, n, 8 + 2 * n).astype(np.int64)
    leaf = feature < 0
    value = np.zeros(n)
    value[leaf] = np.frombuffer(packed, "<f8", int(leaf.sum()), 8 + 3 * n)
    left = np.where(leaf, np.arange(n), 2 * np.cumsum(~leaf) - 1)
    word = (left << 24) | (np.where(leaf, 0, feature) << 8) | np.where(leaf, 255, cut)
    depth, end = 0, 1
    while end < n:
        # a level ends where the children of the level before end
        end = 1 + 2 * int(np.count_nonzero(~leaf[:end]))
        depth += 1
    return word, value, depth


def _add_leaf_values(total: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, int]], bins: np.ndarray) -> None:
    """Adds to ``total`` the value of the leaf that each row reaches, over all ``trees``."""
    flat, width = np.ascontiguousarray(bins).reshape(-1), bins.shape[1]
    for i in range(0, len(bins), PIECE):
        row = np.arange(i * width, min(i + PIECE, len(bins)) * width, width)
        for word, value, depth in trees:
            at = np.zeros(len(row), np.int64)
            for _ in range(depth):
                now = word.take(at)
                at = now >> 8
                at &= 0xFFFF
                at += row
                right = flat.take(at) > now.astype(np.uint8)
                now >>= 24
                now += right
                at = now
            total[i:i + PIECE] += value.take(at)


def _open_nodes(top: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Node that each row reaches below the records of ``top``; 0 for rows that end in a leaf there."""
    node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    place = {int(n): i for i, n in enumerate(top["node"])}
    moving = rows
    while len(moving) and place:
        at = np.array([place.get(n, -1) for n in range(int(node[moving].max()) + 1)])[node[moving]]
        moving, at = moving[at >= 0], at[at >= 0]
        feature, cut = top["feature"][at], top["cut"][at]
        ends = feature < 0
        node[moving[ends]] = 0
        moving, feature, cut = moving[~ends], feature[~ends], cut[~ends]
        node[moving] = 2 * node[moving] + (bins[moving, feature] > cut)
    return node


def _edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Upper ends of at most BINS bins of every feature, from its quantiles."""
    probabilities = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(j)), probabilities, 10000).alias(f"q{j}") for j in range(width)],
                     *[F.max(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(width)]).first()
    return [np.array([v for v in sorted(set(found[f"q{j}"] or [])) if v < found[f"m{j}"]]) for j in range(width)]


def in_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def _blocks(rows: DataFrame, key: str, edges: list[np.ndarray]) -> DataFrame:
    """Rows in bins, up to BLOCK_ROWS of one fold and task together."""
    def task(batches):
        import pandas as pd

        held: dict[int, list] = {}

        def block(fold):
            parts = held.pop(fold)
            return pd.DataFrame({
                "fold": [fold], "keys": [[k for p in parts for k in p[0]]],
                **{name: [b"".join(p[i] for p in parts)] for i, name in ((1, "h"), (2, "y"), (3, "bins"))}})

        for b in batches:
            if not len(b):
                continue
            bins = in_bins(np.stack(b["x"]), edges)
            for fold, part in b.reset_index(drop=True).groupby("fold"):
                held.setdefault(fold, []).append((
                    part[key].tolist(), part["h"].to_numpy(np.int64).tobytes(), part["label"].to_numpy(np.uint8).tobytes(), bins[part.index].tobytes()))
                if sum(len(p[0]) for p in held[fold]) >= BLOCK_ROWS:
                    yield block(fold)
        for fold in list(held):
            yield block(fold)

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "fold", "label", "x", F.xxhash64(key).alias("h")).mapInPandas(
        task, f"fold int, keys array<{kind}>, h binary, y binary, bins binary")


def _unpacked(b, width: int):
    return np.frombuffer(b.h, np.int64).view(np.uint64), np.frombuffer(b.y, np.uint8), np.frombuffer(b.bins, np.uint8).reshape(-1, width)


def _cores(blocks: DataFrame) -> int:
    return blocks.sparkSession.sparkContext.defaultParallelism


def _width(blocks: DataFrame) -> int:
    """Tasks for pieces of trees: their rows are few bytes for the work they make."""
    return max(_cores(blocks), int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _split_large(blocks: DataFrame, g: Growth, sizes: dict[int, int], group_rows: int) -> dict[tuple[int, int], np.ndarray]:
    """Records of the nodes of more than ``group_rows`` rows, split level by level from histograms."""
    n = sum(sizes.values())
    large = {(f, t): np.array([1]) for f in range(g.k) for t in range(g.trees) if n - sizes.get(f, 0) > group_rows}
    top: dict[tuple[int, int], np.ndarray] = {}
    def histograms(large, top):
        def task(batches):
            import pandas as pd

            for batch in batches:
                for b in batch.itertuples():
                    h, y, bins = _unpacked(b, g.width)
                    for (f, t), nodes in large.items():
                        if f == b.fold:
                            continue
                        w = g.weights(h, f, t)
                        node = _open_nodes(top.get((f, t), np.empty(0, _TREE)), bins)
                        at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                        stay = (nodes[at] == node) & (w > 0)
                        n, p = _histogram(bins[stay], w[stay], y[stay], at[stay], g.choices(f, t, nodes))
                        yield pd.DataFrame({"f": [f], "t": [t], "part": [np.stack([n, p]).tobytes()]})

        return task

    def chooser(large):
        def choose(key, parts):
            import pandas as pd

            f, t = (int(v) for v in key)
            nodes = large[f, t]
            chosen = g.choices(f, t, nodes)
            n, p = sum(np.frombuffer(part) for part in parts["part"]).reshape(2, *chosen.shape, BINS)
            level, left, _ = _splits(g, nodes, chosen, n, p)
            return pd.DataFrame({"f": [f], "t": [t], "level": [level.tobytes()], "n_left": [left.tolist()], "n": [n[:, 0].sum(axis=1).tolist()]})

        return choose

    while large:
        parts = blocks.select("fold", "h", "y", "bins").mapInPandas(histograms(large, dict(top)), "f int, t int, part binary")
        done = parts.groupBy("f", "t").applyInPandas(chooser(large), "f int, t int, level binary, n_left array<double>, n array<double>").collect()
        large = {}
        for r in done:
            level = np.frombuffer(r["level"], _TREE)
            top[r["f"], r["t"]] = np.concatenate([top.get((r["f"], r["t"]), np.empty(0, _TREE)), level])
            below = [(2 * int(v["node"]) + side, size) for v, a, b in zip(level, r["n_left"], r["n"]) if v["feature"] >= 0
                     for side, size in ((0, a), (1, b - a))]
            still = sorted(node for node, size in below if size > group_rows)
            if still:
                large[r["f"], r["t"]] = np.array(still)
    return top


def _alike(bins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """An order in which rows of one label and the same bins are neighbours, and where each such run begins; None where the runs are not far fewer than the rows.

    Such rows take the same way in every tree, so their draws can be added up. There are at most 32 ** features of them, so many rows have few.
    """
    width = bins.shape[1]
    if not len(y) or 5 * width + 1 > 63:
        return None
    cell = y.astype(np.int64)
    for j in range(width):
        cell = cell * BINS + bins[:, j]
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    return (order, first) if 2 * len(first) <= len(y) else None


def _whole_trees(blocks: DataFrame, g: Growth, name: str, made: Callable[[np.ndarray], bytes]) -> DataFrame:
    """All trees as ``made`` of their records, (f, t, ``name``): each task takes the training rows of one fold and grows a group of its trees."""
    groups = min(g.trees, math.ceil(4 * _cores(blocks) / g.k))

    def task(batches):
        import pandas as pd

        held: dict[int, list] = {}
        for batch in batches:
            for b in batch.itertuples():
                held.setdefault(b.place, []).append((b.h, b.y, b.bins))
        for place, parts in held.items():
            h, y, bins = (b"".join(x[i] for x in parts) for i in range(3))
            parts.clear()
            h, y, bins = np.frombuffer(h, np.int64).view(np.uint64), np.frombuffer(y, np.uint8), np.frombuffer(bins, np.uint8).reshape(-1, g.width)
            f, group = divmod(place, groups)
            first = None
            alike = _alike(bins, y)
            if alike is not None:
                order, first = alike
                h, y, bins = h[order], y[order[first]], bins[order[first]]
            for t in range(group, g.trees, groups):
                w = g.weights(h, f, t)
                if first is not None:
                    w = np.add.reduceat(w, first, dtype=np.int32)
                inside = np.flatnonzero(w)
                tree = _grow(g, f, t, 1, bins.take(inside, axis=0), w.take(inside), y.take(inside))
                yield pd.DataFrame({"f": [f], "t": [t], name: [made(tree)]})

    places = F.sequence(F.lit(0), F.lit(g.k * groups - 1))
    sent = blocks.select("fold", F.explode(places).alias("place"), "h", "y", "bins").where(F.col("fold") != F.floor(F.col("place") / groups)).drop("fold")
    return sent.repartitionById(g.k * groups, "place").mapInPandas(task, f"f int, t int, {name} binary")


def _shared_trees(blocks: DataFrame, g: Growth, sizes: dict[int, int], group_rows: int) -> DataFrame:
    """All trees, (f, t, records) for each subtree: each task takes the rows of one node, and nodes of more than ``group_rows`` are split first."""
    top = _split_large(blocks, g, sizes, group_rows)

    def sent(batches):
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples():
                h, y, bins = _unpacked(b, g.width)
                for f in range(g.k):
                    if f == b.fold:
                        continue
                    out, size = [], 0
                    for t in range(g.trees):
                        w = g.weights(h, f, t)
                        node = _open_nodes(top[f, t], bins) if (f, t) in top else np.ones(len(w), np.int64)
                        node[w == 0] = 0
                        for v in np.unique(node[node > 0]):
                            inside = node == v
                            out.append((f, t, v, np.column_stack([bins[inside], w[inside], y[inside]]).tobytes()))
                            size += len(out[-1][-1])
                        if size >= SENT_BYTES:
                            yield pd.DataFrame(out, columns=["f", "t", "node", "rows"])
                            out, size = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=["f", "t", "node", "rows"])

    def grown(key, parts):
        import pandas as pd

        f, t, node = (int(v) for v in key)
        rows = np.frombuffer(b"".join(parts["rows"]), np.uint8).reshape(-1, g.width + 2)
        tree = _grow(g, f, t, node, rows[:, :-2], rows[:, -2].copy(), rows[:, -1].copy())
        return pd.DataFrame({"f": [f], "t": [t], "records": [tree.tobytes()]})

    width = max(_width(blocks), g.k * g.trees // 20)
    pieces = blocks.select("fold", "h", "y", "bins").mapInPandas(sent, "f int, t int, node bigint, rows binary").repartition(width, "f", "t", "node")
    below = pieces.groupBy("f", "t", "node").applyInPandas(grown, "f int, t int, records binary")
    if not top:
        return below
    above = blocks.sparkSession.createDataFrame([(f, t, bytearray(v.tobytes())) for (f, t), v in top.items()], "f int, t int, records binary")
    return below.unionByName(above)


def forest_trees(blocks: DataFrame, g: Growth, *, group_rows: int | None = None, packed: bool = False) -> DataFrame:
    """All trees of all forests: (f, t, records), one row for each subtree, or (f, t, packed), one row and few bytes for each tree.

    ``group_rows``: rows that meet in one task, by default as many as fit GROUP_BYTES.
    """
    sizes = {r["fold"]: int(r["n"]) for r in blocks.groupBy("fold").agg(F.sum(F.length("y")).alias("n")).collect()}
    most = max((sum(sizes.values()) - sizes.get(f, 0) for f in range(g.k)), default=0)
    if most <= (group_rows or GROUP_BYTES // (g.width + 9)):
        return _whole_trees(blocks, g, "packed", _pack) if packed else _whole_trees(blocks, g, "records", np.ndarray.tobytes)
    found = _shared_trees(blocks, g, sizes, group_rows or GROUP_ROWS)
    return _packed(found) if packed else found


def _packed(trees: DataFrame) -> DataFrame:
    def whole(key, parts):
        import pandas as pd

        return pd.DataFrame({"f": [int(key[0])], "t": [int(key[1])], "packed": [_pack(np.frombuffer(b"".join(parts["records"]), _TREE))]})

    return trees.groupBy("f", "t").applyInPandas(whole, "f int, t int, packed binary")


def _shape(parts: DataFrame, trees: DataFrame, g: Growth) -> tuple[int, int]:
    """Into how many groups of trees and slices of the parts to cut: enough tasks for all cores, and the fewest bytes sent."""
    of_parts = parts.agg(F.sum(F.length("bins"))).first()[0] or 0
    of_trees = trees.agg(F.sum(F.length("packed"))).first()[0] or 0
    tasks = math.ceil(4 * _cores(parts) / g.k)
    least = math.ceil(g.trees / TOGETHER)
    # a part goes to every group and comes back as 8 bytes a row; a tree goes to every slice
    return min(((n, math.ceil(tasks / n)) for n in range(least, min(g.trees, max(least, tasks)) + 1)),
               key=lambda x: x[0] * of_parts * (1 + 8 / g.width) + x[1] * of_trees)


def forest_sums(parts: DataFrame, trees: DataFrame, g: Growth) -> DataFrame:
    """(id, total): leaf values of each row of each part, eight bytes a row, summed over the forest of the part's fold.

    ``parts`` is a stored table with ``fold``, a unique ``id`` and the rows' ``bins``; ``trees`` are packed and stored too. Every
    group of trees meets every slice of the parts in a task, which reads the trees first.
    """
    groups, slices = _shape(parts, trees, g)

    def task(batches):
        import pandas as pd

        place, held = None, []
        for batch in batches:
            for b in batch.itertuples():
                if b.place != place:
                    place, held = b.place, []
                if b.id < 0:
                    held.append(_unpack(b.data))
                    continue
                total = np.zeros(len(b.data) // g.width)
                _add_leaf_values(total, held, np.frombuffer(b.data, np.uint8).reshape(-1, g.width))
                yield pd.DataFrame({"id": [b.id], "place": [place], "part": [total.tobytes()]})

    def places(fold, group, slice_):
        return ((F.col(fold) * groups + group) * slices + slice_).cast("int").alias("place")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = trees.select("f", "t", "packed", each(slices).alias("s")).select(
        places("f", F.col("t") % groups, F.col("s")), (-1 - F.col("t")).cast("bigint").alias("id"), F.col("packed").alias("data"))
    held = parts.select("fold", "id", "bins", each(groups).alias("of")).select(
        places("fold", F.col("of"), F.pmod(F.xxhash64("id"), F.lit(slices))), F.col("id").cast("bigint").alias("id"), F.col("bins").alias("data"))
    met = dealt.unionByName(held).repartitionById(g.k * groups * slices, "place").sortWithinPartitions("place", "id")
    summed = met.mapInPandas(task, "id bigint, place int, part binary")

    def add(key, found):
        import pandas as pd

        # in the order of the groups, so that rows with the same bins have the same sum
        found = found.sort_values("place")
        return pd.DataFrame({"id": [int(key[0])], "total": [sum(np.frombuffer(p) for p in found["part"]).tobytes()]})

    return summed.groupBy("id").applyInPandas(add, "id bigint, total binary") if groups > 1 else summed.select("id", F.col("part").alias("total"))


def forest_scores(blocks: DataFrame, trees: DataFrame, g: Growth, key: str) -> DataFrame:
    """(key, label, fold, score) of every row: mean share of positives in its leaves, in the forest that did not see it."""
    def task(batches):
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples():
                yield pd.DataFrame({key: b.keys, "label": np.frombuffer(b.y, np.uint8).astype(np.int32), "fold": b.fold, "score": np.frombuffer(b.total) / g.trees})

    # stored with its numbers, which a second run might deal otherwise
    blocks = materialize(blocks.withColumn("id", F.monotonically_increasing_id()), "forest-parts")
    totals = forest_sums(blocks, trees if "packed" in trees.columns else _packed(trees), g)
    kind = dict(blocks.dtypes)["keys"][len("array<"):-1]
    return blocks.select("id", "fold", "keys", "y").join(totals, "id").drop("id").mapInPandas(task, f"`{key}` {kind}, label int, fold int, score double")


def forest_blocks(rows: DataFrame, key: str, k: int, *, trees: int, depth: int, min_leaf: int, seed: int) -> tuple[DataFrame, Growth]:
    """Rows (key, label, fold, array ``x``) in bins, and the numbers of the forests that grow on them."""
    width = rows.select(F.max(F.size("x"))).first()[0] or 0
    edges = _edges(rows, width)
    return _blocks(rows, key, edges), Growth(k, trees, depth, min_leaf, seed, edges)
