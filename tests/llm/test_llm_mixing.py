import pytest
from pyspark.sql import functions as F

from siftwright.llm import mixing
from siftwright.llm.text import count_words


def expected(sizes, pattern, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: pattern[i % len(pattern)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: cap * sizes[s] for s in names}
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("share,cap", [(1.5, 2.0), (0.3, 1.0), (2.0, 2.0), (1.0, 4.0)])
def test_targets_and_takes(spark, folder, share, cap):
    df = spark.read.parquet(f"{folder}/documents.parquet").withColumn("size", count_words(F.col("text")))
    rows = mixing.mix(df, size="size", source="source", key=["doc_id", "text"], pattern=[5, 2, 1], share=share, max_epochs=cap).toPandas()
    want = expected(rows.groupby("source")["size"].sum().to_dict(), [5, 2, 1], share, cap)
    rows["taken"] = rows["whole"] * rows["size"] + rows["part"]
    for source, g in rows.groupby("source"):
        assert g["target"].iloc[0] == pytest.approx(want[source])
        assert abs(g["taken"].sum() - want[source]) <= 1
    assert (rows["taken"] <= cap * rows["size"]).all()
    partial = rows[(rows["part"] > 0) & (rows["part"] < rows["size"])]
    assert partial.groupby("source").size().tolist() == [1] * partial["source"].nunique()


def test_odd_rows(spark, odd, none):
    df = odd.withColumn("size", count_words(F.col("text"))).withColumn("target", F.lit("clash"))
    rows = mixing.mix(df, size="size", source="source", key=["doc_id", "text"], pattern=[5, 2, 1]).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r["whole"] * r["size"] + r["part"] - r["target"] / len([x for x in rows if x["source"] == r["source"]]))
    # rows alike share the cut, rounded down
    assert all(abs(sum(v)) <= 3 for v in by.values())
    assert mixing.mix(none.withColumn("size", F.lit(0).cast("long")), size="size", source="source", key=["doc_id"], pattern=[1]).count() == 0
    with pytest.raises(ValueError):
        mixing.water_fill(spark.createDataFrame([("a", 1, 1.0)], "source string, source_size long, weight double"), share=3, max_epochs=2)
