"""The cascade takes a measure only where it gets to the measure's rule."""

import pytest
from pyspark.sql import functions as F

from siftwright.llm import quality


@pytest.fixture(scope="module")
def texts(spark):
    long = " ".join(f"word{i}" for i in range(30))
    return spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "# " * 40), (5, long), (6, long + " " + long), (7, "a b")], "id int, text string")


def _alarm(rule: str, when) -> dict:
    """The measures, one of which fails the job for rows where ``when`` holds."""
    made = quality.measures("text")
    return made | {rule: F.when(when, F.raise_error(F.lit("measured")).cast("long")).otherwise(made[rule])}


def _ranked(*names):
    rules = {r.name: r for r in quality.RULES}
    return [rules[n] for n in names]


def test_rejected_texts_are_spared_the_later_measures(spark, texts):
    few = F.coalesce(F.size(F.split("text", " ")) < 20, F.lit(True))
    ranked = _ranked("few_words", "repeats", "symbols", "word_length", "dup_lines")
    for m in ("n_repeat_words", "n_symbols", "word_chars", "n_lines"):
        got = quality.judge(texts, "text", ranked, made=_alarm(m, few)).collect()
        assert {r.id: r.failed_rule for r in got} == {1: "few_words", 2: "few_words", 3: "few_words", 4: "repeats", 5: None, 6: "repeats", 7: "few_words"}
        # the alarm does go off where the rule comes first
        other = [r for r in ranked if m in r.needs] + [r for r in ranked if m not in r.needs]
        with pytest.raises(Exception, match="measured"):
            quality.judge(texts, "text", other, made=_alarm(m, few)).collect()


def test_kept_measures_and_order_change_no_verdict(spark, texts):
    ranked = list(quality.RULES)
    want = {r.id: r.kept for r in quality.filter_quality(texts, "text").collect()}
    assert want == {i: i == 5 for i in range(1, 8)}
    for order in (ranked, ranked[::-1]):
        for keep in ([], ["n_symbols"], list(quality.measures("text"))):
            out = quality.judge(texts, "text", order, keep=keep)
            assert out.columns == ["id", "text", *[m for m in quality.measures("text") if m in keep], "failed_rule", "kept"]
            assert {r.id: r.kept for r in out.collect()} == want
    some = quality.filter_quality(texts, "text", keep=["n_symbols"])
    assert set(some.columns) == {"id", "text", "n_words", "n_symbols", "n_repeat_words", "base_failed", "failed_rule", "kept"}
    assert {r.id: r.base_failed for r in some.collect()} == {i: i != 5 for i in range(1, 8)}


def test_the_sample_comes_from_all_partitions(spark):
    # the first partitions hold clean texts only; the rule that rejects is seen all the same
    clean = " ".join(f"w{i}x" for i in range(60))
    df = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") < 3000, F.lit(clean)).otherwise(F.lit("# " * 30 + clean)).alias("text"))
    rules = _ranked("few_words", "symbols")
    rules[1] = quality.Rule("symbols", lambda m: m["n_symbols"] > 5, ("n_words", "n_symbols"))
    assert [r.name for r in quality.rank_rules(df, "text", rules)] == ["symbols", "few_words"]
    assert [r.name for r in quality.rank_rules(df.limit(0), "text", rules)] == ["few_words", "symbols"]
