"""Whole results of the fitted queries on small planted tables."""

import math

import pytest

from siftwright.plans import QUERIES, RESULTS


def test_every_fit_has_its_values(spark):
    import __spark_entry__ as e

    assert {n.removesuffix("_values") for n in RESULTS} <= set(QUERIES)
    assert set(RESULTS) <= set(e.queries()) and not set(RESULTS) & set(e.oracle_sql())


def test_mixture_flags_are_the_planted_ones(spark, tmp_path):
    near = lambda m, i: int(math.exp(m + 0.1 * ((i * 7) % 11 - 5)))
    rows = [(i, near(9.5 if i % 4 == 0 else 6.0, i)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in RESULTS["mixture_fit_values"](spark, str(tmp_path)).collect()}
    assert {i for i, r in found.items() if r["dq_contaminated"]} == {i for i, _ in rows if i % 4 == 0}
    assert all(r["log_chars"] == pytest.approx(math.log(n)) and (r["posterior"] > 0.99) == (i % 4 == 0) for (i, n), r in ((x, found[x[0]]) for x in rows))
    low, high = RESULTS["mixture_bic_values"](spark, str(tmp_path)).where("k = 2").orderBy("component").collect()
    assert (low["weight"], high["weight"]) == (pytest.approx(0.75, abs=0.01), pytest.approx(0.25, abs=0.01))


def test_attribution_finds_the_planted_feature(spark, tmp_path):
    """The label follows the number of orders; prices, states and dates are the same for everybody."""
    rows = [(k, float(100 + (k * 7 + i) % 13), "FO"[i % 2], f"199{i % 3}-05-01") for k in range(60) for i in range(6 + k % 10)]
    df = spark.createDataFrame(rows, "o_custkey long, o_totalprice double, o_orderstatus string, d string")
    df.selectExpr("o_custkey", "o_totalprice", "o_orderstatus", "cast(d as timestamp) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    shares = RESULTS["sampled_shapley_values"](spark, str(tmp_path)).collect()
    assert shares[0]["feature"] == "n_orders" and shares[0]["share"] > 0.5 and sum(r["share"] for r in shares) == pytest.approx(1.0)


def test_mixture_fits_pass_over_distinct_values(spark, monkeypatch):
    from siftwright.operators import mixture as M

    seen, fit = [], M.GaussianMixture.fit
    monkeypatch.setattr(M.GaussianMixture, "fit", lambda self, rows: (seen.append(rows.count()), fit(self, rows))[1])
    df = spark.range(600).selectExpr("cast(if(id % 4 = 0, 20, 5) + id % 7 as double) AS v")
    one, two = M.fit_mixtures(df, "v", ks=(1, 2), n_init=2)
    assert seen == [14, 14] and one.n == two.n == 600
    assert two.components[0].weight == pytest.approx(0.75, abs=0.01) and two.components[1].mean == pytest.approx(23, abs=0.1)
