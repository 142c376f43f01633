"""Metrics observed during writes, and the claims' numbers made the other way round."""

import math

import pytest
from pyspark.sql import functions as F

from siftwright.operators import mixture as M
from siftwright.operators import register as R
from siftwright.operators.profile import row_count
from siftwright.plans import claim_queries as C
from siftwright.session import side_session
from siftwright.sources import sinks
from siftwright.sources.scratch import checkpoint_root
from siftwright.sources.tables import Tables


@pytest.fixture(scope="module")
def beside(spark):
    return side_session(spark)


def test_the_other_session_has_the_same_settings(spark, beside):
    assert beside.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert checkpoint_root(beside) == checkpoint_root(spark)


def test_models_can_be_fitted_after_an_observed_write(spark, folder):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    C._customers(Tables(side_session(spark), folder))
    rows = VectorAssembler(inputCols=["id"], outputCol="features").transform(spark.range(40).withColumn("label", (F.col("id") % 3 == 0).cast("int")))
    assert LogisticRegression(maxIter=2).fit(rows).transform(rows).agg(F.count("probability")).first()[0] == 40


def test_what_is_seen_during_a_write_is_what_was_written(beside, tmp_path):
    df = beside.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("x"))
    metrics = {"rows": row_count(), "known": F.count("x"), "total": F.sum("x")}
    written, seen = sinks.write_observed(df.repartition(5), f"{tmp_path}/t", metrics)
    again = written.agg(*[m.alias(n) for n, m in metrics.items()]).first().asDict()
    assert seen == again and seen["rows"] == 1000 and seen["known"] == 666


def test_tables_without_rows_are_observed_too(beside, tmp_path):
    for i, empty in enumerate([beside.range(0), beside.range(10).where("id > 99"), beside.range(10).limit(0)]):
        written, seen = sinks.write_observed(empty, f"{tmp_path}/{i}", {"rows": row_count(), "total": F.sum("id")})
        assert seen == {"rows": 0, "total": None} and written.count() == 0


def test_crossing_point_and_posterior_flag_the_same_values(spark):
    x = spark.createDataFrame([(None,)] + [(i / 100,) for i in range(0, 2000)], "x double")
    model = M.Mixture(0, 0.0, C.CONTAMINATION)
    differ = x.where(C._nearer_upper(F.col("x")) != M.is_contaminated("x", model))
    assert differ.count() == 0 and x.where(C._nearer_upper(F.col("x"))).count() > 0


def test_shape_from_power_sums_and_value_counts(spark):
    xs = [math.sin(i) + math.cos(i * 1.7) + math.sin(i * 0.37) * 1.3 + math.cos(i * 2.9) for i in range(4000)]
    seen = {"rows": len(xs), "n_x": len(xs), **{f"x{k}": sum(v**k for v in xs) for k in (1, 2, 3, 4)}}
    df = spark.createDataFrame([(v,) for v in xs], "x double").agg(F.skewness("x"), F.kurtosis("x")).first()
    bell = abs(df[0]) <= 0.25 and abs(df[1]) <= 0.25
    assert (C._bell_rows(seen) == len(xs)) == bell
    assert C._bell_rows({"rows": 0, "n_x": 0}) == 0.0 and C._bell_rows({"rows": 2, "n_x": 2, "x1": 4, "x2": 8, "x3": 16, "x4": 32}) == 0.0
    flat = spark.createDataFrame([(float(v), 40) for v in range(1, 51)], "v double, n long")
    steep = spark.createDataFrame([(float(v), 1 + v * v) for v in range(1, 51)], "v double, n long")
    assert flat.agg(C._flat_rows(flat)).first()[0] == 2000 and steep.agg(C._flat_rows(steep)).first()[0] == 0
    assert flat.limit(0).agg(C._flat_rows(flat.limit(0))).first()[0] == 0


def test_a_wrong_claim_stops_the_run(spark, folder):
    found = R.claims(spark, {"a": 3, "b": None, "c": 0.1})
    claimed = R.claims(spark, {"a": 3, "b": 1.0, "c": 0.2, "d": 4}, value="expected").withColumn("tolerance", F.lit(0.0))
    checks = R.reconcile(found, claimed)
    assert {r["name"]: r.passed for r in checks.collect()} == {"a": True, "b": False, "c": False, "d": False}
    with pytest.raises(ValueError, match="3 checks"):
        R.require_all(checks)
    names = {r["name"] for r in C._checks(Tables(spark, folder)).collect()}
    assert len(names) == 23 and {f"DQ-{i:02d}" for i in range(1, 12)} < names


def test_a_violated_check_is_not_on_the_clean_bill(spark, folder, tmp_path):
    t = Tables(spark, folder)
    spoiled = t("orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 7 == 0, F.expr("o_orderdate + interval 3 hours")).otherwise(F.col("o_orderdate")))
    t._scans["orders"] = spoiled.unionByName(spoiled.limit(1)).withColumn("o_orderpriority", F.concat(F.lit(" "), "o_orderpriority"))
    failed = {r["name"] for r in C._clean_checks(t).where("not passed").collect()}
    assert failed == {"repeated order keys", "order dates with a time of day", "padded or variant categories"}
    assert C._clean_checks(Tables(spark, folder)).where("passed").count() == 9


def test_reconcile_repairs_the_lines_once(spark, folder, monkeypatch):
    from siftwright.plans import QUERIES, audit_queries, claim_queries

    made, repair = [], audit_queries.audited_lines

    def counted(*a, **kw):
        made.append(1)
        return repair(*a, **kw)

    for module in (audit_queries, claim_queries):
        monkeypatch.setattr(module, "audited_lines", counted)
    assert QUERIES["reconcile"](spark, folder).where("passed").count() == 23
    assert len(made) == 1
