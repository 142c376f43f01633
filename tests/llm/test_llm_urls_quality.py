import re

from pyspark.sql import functions as F

from siftwright.llm import quality, url_rules
from siftwright.llm.queries import URL_RULES

BLANK = r"[\x20\x09-\x0D]"


def judge(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    h, p, v = min(fits, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1]))
    return host, path, h + p, v


def test_urls_against_plain_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "http://ORG/x", "http://a.b.org/", "http://xorg/", "http://example.org/es/1",
            "http://m.Example.org/en/12", "http://example.org/en/2", "http://a.com/fr/", "http://a.com/fr", "http://com/de/x?y#z", "http://.com/de/", "x://a://b.org/",
            "http://a..org/", "http://ä.org/\nx", "http://example.org?x=/es/", "http://example.org/es/1", "ftp://example.org:80/es/"]
    rules = [*URL_RULES, ("b.org", "/", "block"), ("a.b.org", "", "allow"), (None, "/", "block"), ("example.org", "/es/", "block")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, "url", table).collect()}
    assert got == {i: judge(u, [r for r in rules if r[0]]) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(df.limit(0), "url", table).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(df, "url", table.limit(0), default="block").collect()} == {"block"}


def measured(text):
    text = text or ""
    w = re.findall(BLANK.replace("[", "[^", 1) + "+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = [windows.count(x) > 1 for x in windows]
    lines = [x for x in text.split("\n") if re.search(BLANK.replace("[", "[^", 1), x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({j for i, h in enumerate(hit) if h for j in range(i, i + 8)}),
    }


def test_measures_of_odd_texts(spark, odd, none):
    rows = quality.filter_quality(odd.withColumn("n_words", F.lit("clash")), "text").collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = measured(r["text"])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert r["kept"] == (r["failed_rule"] is None)
    assert quality.filter_quality(none, "text").count() == 0


def test_order_of_rules_changes_no_verdict(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    ranked = quality.rank_rules(df, "text")
    assert {r.name for r in ranked} == {r.name for r in quality.RULES}
    some = df.select(*[c.alias(n) for n, c in quality.measures("text").items()])
    both = some.select(quality.cascade(ranked).isNull().alias("a"), quality.cascade(list(reversed(ranked))).isNull().alias("b"))
    assert both.where("a <> b").count() == 0


def test_whole_paragraph_repeated(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(text,), (text + "\n" + text,), (text + " x " + text,)], "text string")
    got = [r.n_repeat_words for r in df.select(quality.measures("text")["n_repeat_words"].alias("n_repeat_words")).collect()]
    assert got == [0, 80, 80]
