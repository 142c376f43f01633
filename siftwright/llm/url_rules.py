"""Allow and block rules for URLs by hashed host-suffix and path-prefix expressions.

Each URL is expanded into the pairs (host suffix, path prefix) that a rule could name; rules
and expressions meet by an equi-join on the first four bytes of a SHA-256 digest, full digests
confirm, and the longest fitting rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """A-Z lower-cased text between the first ``://`` and the next ``/``, ``?`` or ``#``; empty without ``://`` or for null."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Text from the end of the host up to ``?`` or ``#``; empty without ``://`` or for null."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # the host's length keeps pairs apart whose joined texts are alike
    return F.sha2(F.concat_ws("\n", F.length(host).cast("string"), F.concat(host, path)), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(urls: DataFrame, url: str, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` (strings) and ``verdict``. A rule fits its host and every
    subdomain if the URL's path begins with the rule's path; among fitting rules the one of
    most characters (host and path together) wins, then the longer host, then the smaller
    text. Without one, ``rule`` is null and the verdict is ``default``. Rules that are null in
    any column are ignored; of rules with equal host and path the smaller verdict counts.
    Nulls and texts without ``://`` have an empty host, which no rule names. Columns of
    ``urls`` named like results are replaced.

    The label counts of rule hosts and the lengths of rule paths (each bounded by the longest
    rule, not by the number of rules) reach the driver; only suffixes and prefixes of these
    lengths are expanded. Equal (host, path) pairs are judged once.
    """
    made = ["host", "path", "rule", "verdict"]
    rules = rules.select("host", "path", "verdict").na.drop().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    keep = [c for c in urls.columns if c not in made]
    rows = urls.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))}).select(*keep, "_host", "_path")
    if not shape["labels"]:
        return rows.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"),
                           F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.size(F.split("_host", r"\."))
    suffixes = F.array_compact(F.array(*[
        F.when(labels >= k, F.substring_index("_host", ".", -k)) for k in shape["labels"]
    ]))
    prefixes = F.array_compact(F.array(*[
        F.when(F.length("_path") >= k, F.substring(F.col("_path"), 1, k)) for k in shape["lengths"]
    ]))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.struct(s.alias("s"), p.alias("p"), _digest(s, p).alias("digest")))))
    expanded = (
        rows.select("_host", "_path").distinct()
        .select("_host", "_path", F.explode(pairs).alias("e"))
        .select("_host", "_path", F.col("e.digest").alias("digest"), _prefix(F.col("e.digest")).alias("prefix"))
    )
    listed = rules.select(
        F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule_text"), F.col("verdict").alias("rule_verdict"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
    ).withColumn("rule_prefix", _prefix(F.col("rule_digest")))
    best = (
        expanded.join(listed, F.col("prefix") == F.col("rule_prefix"))
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy(F.col("_host").alias("of_host"), F.col("_path").alias("of_path"))
        .agg(F.min(F.struct(
            (-F.length("rule_text")).alias("a"), (-F.length("rule_host")).alias("b"), F.col("rule_text"), F.col("rule_verdict"),
        )).alias("best"))
    )
    return (
        rows.join(best, (F.col("_host") == F.col("of_host")) & (F.col("_path") == F.col("of_path")), "left")
        .select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"),
                F.col("best.rule_text").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    )
