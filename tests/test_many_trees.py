"""Forests that are grown together against Spark's own and against themselves in smaller groups."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from siftwright.operators import models as L
from siftwright.operators.evaluate import score_metrics
from siftwright.operators.many_trees import forest_blocks, forest_scores, forest_trees


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        a, b, c = (float(v) for v in rng.normal(size=3))
        rows.append((i, int((a * b > 0) != (rng.random() < 0.1)), [a, b, c, float(i % 2), 7.0]))
    df = spark.createDataFrame(rows, "k int, label int, x array<double>").repartition(3)
    return L._fold_table(df.withColumn("features", array_to_vector("x")), "k", 3, 42)


def _scores(rows, **how):
    blocks, growth = forest_blocks(rows, "k", 3, trees=30, depth=8, min_leaf=5, seed=42)
    return forest_scores(blocks, forest_trees(blocks, growth, **how), growth, "k")


def test_auc_is_that_of_sparks_forest(folded):
    scored = _scores(folded)
    assert scored.count() == scored.select("k").distinct().count() == 1500
    own = score_metrics(scored, "score", "label").first()["roc_auc"]
    parts = [L.positive_probability(L.forest(30, depth=8).fit(folded.where(F.col("fold") != f)), folded.where(F.col("fold") == f), "label") for f in range(3)]
    theirs = score_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2]), "score", "label").first()["roc_auc"]
    assert own > 0.85 and own == pytest.approx(theirs, abs=0.03)


def test_nodes_split_from_histograms_give_the_same_trees(folded):
    """Also on rows dealt otherwise."""
    whole = {r["k"]: r["score"] for r in _scores(folded).collect()}
    apart = {r["k"]: r["score"] for r in _scores(folded.repartition(7), group_rows=200).collect()}
    assert apart == pytest.approx(whole, abs=1e-9)


def test_leaves_keep_their_least_size(folded):
    from siftwright.operators.many_trees import _TREE

    blocks, growth = forest_blocks(folded, "k", 3, trees=2, depth=3, min_leaf=5, seed=1)
    for r in forest_trees(blocks, growth).collect():
        tree = np.frombuffer(r["records"], _TREE)
        assert tree["node"].max() < 2 ** 4 and 0 <= tree["value"].min() and tree["value"].max() <= 1
        assert set(tree["node"][tree["feature"] >= 0] * 2) <= set(tree["node"])


def test_oof_scores_fit_no_forest_on_the_driver(folded, monkeypatch):
    def refuse(self, *a, **b):
        raise AssertionError("a forest on the driver")

    monkeypatch.setattr(L.RandomForestClassifier, "fit", refuse)
    m = L.Matrix(folded.select("k", "label", "features"), "k", "label", list("abcde"))
    scores = L.oof_scores(m, {"forest": lambda n: L.forest(20, depth=6)}, k=3)
    assert scores.columns == ["model", "k", "label", "fold", "score"]
    assert scores.where("score between 0 and 1").count() == 1500


def test_a_fold_that_fits_a_task_is_not_sent_to_every_tree(folded, monkeypatch):
    """A row travels once for each group of trees, and the packed trees score as the records do."""
    from siftwright.operators import many_trees as M

    def refuse(*a):
        raise AssertionError("rows go to single trees")

    monkeypatch.setattr(M, "_shared_trees", refuse)
    blocks, growth = forest_blocks(folded, "k", 3, trees=4, depth=6, min_leaf=5, seed=1)
    packed = {(r["f"], r["t"]): r["packed"] for r in forest_trees(blocks, growth, packed=True).collect()}
    assert packed == {(r["f"], r["t"]): M._pack(np.frombuffer(r["records"], M._TREE)) for r in forest_trees(blocks, growth).collect()} and len(packed) == 12


def test_trees_do_not_depend_on_pieces_or_on_rows_counted_together(monkeypatch):
    from siftwright.operators import many_trees as M

    rng = np.random.default_rng(8)
    bins = rng.integers(0, 5, (3000, 3)).astype(np.uint8)
    y, h = (bins[:, 0] > 2).astype(np.uint8) ^ (rng.random(3000) < 0.2), rng.integers(0, 2 ** 62, 3000).astype(np.uint64)
    g = M.Growth(2, 3, 9, 2, 1, [np.arange(4.0)] * 3)
    w = g.weights(h, 1, 2)
    u = (M._mix(h + g.base(1, 2)) >> np.uint64(11)) / float(1 << 53)
    assert (w == np.searchsorted(M._POISSON, u, side="right")).all()
    grown = lambda *rows: np.sort(M._grow(g, 1, 2, 1, *rows), order="node")
    whole = grown(bins, w, y)
    order, first = M._alike(bins, y)
    assert len(first) <= 250
    alike = grown(bins[order[first]], np.add.reduceat(w[order], first, dtype=np.int32), y[order[first]])
    monkeypatch.setattr(M, "PIECE", 16)
    for other in (grown(bins, w, y), alike):
        assert all((whole[c] == other[c]).all() for c in ("node", "feature", "value"))
    total = np.zeros(3000)
    M._add_leaf_values(total, [M._unpack(M._pack(whole))], bins)
    place = {int(r["node"]): r for r in whole}
    for i in range(0, 3000, 50):
        node = 1
        while place[node]["feature"] >= 0:
            node = 2 * node + int(bins[i, place[node]["feature"]] > place[node]["cut"])
        assert total[i] == place[node]["value"]
