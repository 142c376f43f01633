"""Quality rules as a cascade that stops at the first failure, ordered by rejection per cost.

A rule is a boolean column over measured columns. On a seeded sample drawn over all partitions each
measure is timed and each rule's rejected share counted; rules are then tried in falling order
of rejected share per second. A measure that one rule alone needs, and the caller does not want
back, is taken inside that rule's branch, so a text that an earlier rule rejects is spared it.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .text import BLANKS, bind, whole, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(whole(text), BLANKS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(whole(text)) - F.length(F.translate(whole(text), SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(whole(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(whole(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)).cast("long")


def n_repeat_words(found: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that the array holds twice or more, first occurrence included.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Only texts in which a
    window repeats are sorted by window.
    """
    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width)))),
            F.lit(0), lambda a, x: a + x)

    def repeated(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(placed, lambda s: bind(
            F.sort_array(F.transform(
                F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"])),
            covered))

    def over(hashes: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - width),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        return F.when(F.size(hashes) < width, F.lit(0)).otherwise(bind(
            windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(repeated(w))))

    return bind(F.transform(found, lambda w: F.xxhash64(w)), over).cast("long")


@dataclass(frozen=True)
class Rule:
    """``fails`` makes the condition from the measures in ``needs``, given by their names in :func:`measures`."""
    name: str
    fails: Callable[[Mapping[str, Column]], Column]
    needs: tuple[str, ...]

    def on_row(self) -> Column:
        """The condition over measures that are columns already."""
        return self.fails({m: F.col(m) for m in self.needs})

    def on_struct(self, taken: Column) -> Column:
        """The condition over measures that are fields of a struct."""
        return self.fails({m: taken[m] for m in self.needs})


# Documented limits; a text that fails any is rejected.
BASE = (
    Rule("few_words", lambda m: m["n_words"] < 20, ("n_words",)),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"], ("n_words", "n_repeat_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: m["n_symbols"] > m["n_words"], ("n_words", "n_symbols")),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]), ("n_words", "word_chars")),
    Rule("dup_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"], ("n_lines", "n_dup_lines")),
)


def measures(text: str) -> dict[str, Column]:
    """All measured columns by name; null texts count as empty."""
    t = F.col(text)
    found = words(t)
    return {
        "n_words": F.size(found).cast("long"), "word_chars": word_chars(t), "n_symbols": n_symbols(t),
        "n_lines": n_lines(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(found),
    }


def rank_rules(
    df: DataFrame, text: str, rules: Sequence[Rule] = RULES, *, made: Mapping[str, Column] | None = None, sample_rows: int = 400, seed: int = 5,
) -> list[Rule]:
    """Rules by rejected share per second, each measured on about ``sample_rows`` rows from all partitions of ``df``.

    The sample is stored and stays on the executors; the time of reading it is taken off each measure's.
    Equal ratios, as on an empty table, keep the given order.
    """
    made = made or measures(text)
    texts = df.select(F.col(text)).where(F.col(text).isNotNull())
    n = texts.count()
    if not n:
        return list(rules)
    sample = materialize(texts.sample(min(1.0, sample_rows / n), seed), "quality-sample")
    seen = sample.select(*[made[m].alias(m) for m in _named(rules)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(r.on_row()).alias(f"rule{i}") for i, r in enumerate(rules)]).first()

    def seconds(column: Column) -> float:
        start = time.perf_counter()
        sample.agg(F.sum(column)).collect()
        return time.perf_counter() - start

    reading = min(seconds(F.length(text)) for _ in range(2))
    cost = {m: max(seconds(made[m]) - reading, 1e-3) for m in _named(rules)}
    value = {r.name: seen[f"rule{i}"] / max(seen["n"], 1) / sum(cost[m] for m in r.needs) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: -value[r.name])


def _named(rules: Sequence[Rule]) -> list[str]:
    """The measures that rules need, each once, in order."""
    return list(dict.fromkeys(m for r in rules for m in r.needs))


def cascade(rules: Sequence[Rule], lazy: Mapping[str, Column] | None = None) -> Column:
    """Name of the first rule that fails, null if none does; a rule behind it is not evaluated.

    Measures in ``lazy`` are taken inside the branch of their rule, the others are columns of the row.
    """
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        own = {m: (lazy or {}).get(m, F.col(m)) for m in r.needs}
        if lazy and any(m in lazy for m in r.needs):
            taken = F.struct(*[c.alias(m) for m, c in own.items()])
            fails = bind(taken, r.on_struct)
        else:
            fails = r.fails(own)
        out = F.when(fails, F.lit(r.name)).otherwise(out)
    return out


def judge(
    df: DataFrame, text: str, ranked: Sequence[Rule], *, keep: Sequence[str] = (), made: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``df`` with the measures in ``keep``, ``failed_rule`` (the first of ``ranked`` that fails) and ``kept``.

    Measures that several rules need are taken once; the rest only where the cascade gets to their rule.
    """
    made = made or measures(text)
    results = {*made, "failed_rule", "kept"}
    uses = [m for r in ranked for m in dict.fromkeys(r.needs)]
    ahead = [m for m in made if m in keep or uses.count(m) > 1]
    lazy = {m: c for m, c in made.items() if m not in ahead}
    rest = [c for c in df.columns if c not in results or c == text]
    judged = df.select(*rest, *[made[m].alias(m) for m in ahead]).withColumn("failed_rule", cascade(ranked, lazy))
    return judged.select(*rest, *[m for m in ahead if m in keep], "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def filter_quality(
    df: DataFrame, text: str, rules: Sequence[Rule] = RULES, *, keep: Sequence[str] | None = None, sample_rows: int = 400,
) -> DataFrame:
    """``df`` with the measures in ``keep`` (None: all), ``base_failed``, ``failed_rule`` (the first in the ranked order) and ``kept``.

    ``base_failed``: a rule of BASE fails; its measures are always returned. Null texts count as empty and
    fail. Columns of ``df`` named like the results are replaced; every row comes back.
    """
    made = measures(text)
    wanted = list(made) if keep is None else list(dict.fromkeys([*_named(BASE), *keep]))
    df = df.drop(*[c for c in ("base_failed",) if c != text])
    judged = judge(df, text, rank_rules(df, text, rules, made=made, sample_rows=sample_rows), keep=wanted, made=made)
    base = reduce(lambda a, b: a | b, [r.on_row() for r in BASE])
    return judged.withColumn("base_failed", base).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
