"""Shares of the register on halves of the last digit, against SQL."""

import duckdb
from pyspark.sql import functions as F

from siftwright.operators import register as R


def test_shares_on_a_half_are_those_of_sql(spark):
    # of 160000 rows every eighth count has a share that ends on a half
    counts = [(bad, 160000) for bad in range(4, 20000, 8)]
    df = spark.createDataFrame(counts, "bad bigint, total bigint")
    text = {name: "" for name in ("issue_id", "table", "fields", "issue", "severity", "rule", "resolution")}
    got = R.register_rows(df, [R.issue(**text, affected=F.col("bad"), total=F.col("total"), evidence=F.lit(""))])
    sql = "SELECT CAST(b AS BIGINT) AS bad, round(CAST(b AS BIGINT) * 100.0 / CAST(160000 AS BIGINT), 3) FROM range(4, 20000, 8) t(b)"
    assert sorted((r["affected_rows"], r["affected_pct"]) for r in got.collect()) == sorted(duckdb.sql(sql).fetchall())
