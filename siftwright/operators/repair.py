"""Repair with flags, the naive-versus-audited impact, and flag counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .detectors import impute_median, null_out
from .integrity import classify_duplicates, flag_before_start, keep_first
from .profile import row_count


def repair_entities(
    df: DataFrame,
    key: Sequence[str],
    *,
    order_by: Sequence[str] | None = None,
    flags: Mapping[str, Column] | None = None,
    clean: Mapping[str, tuple[str, Sequence[str]]] | None = None,
    impute: Sequence[str] = (),
) -> DataFrame:
    """One row per key with every change visible.

    ``flags`` adds boolean columns, ``clean`` maps a new column to (raw column, flags that make it
    NULL), ``impute`` names columns that get ``<column>_imputed`` (the exact median of the repaired rows in
    the gaps) and ``<column>_missing``; the rows are stored first, since medians and result both read them.
    """
    out = keep_first(df, key, order_by)
    if flags:
        out = out.withColumns(dict(flags))
    for name, (raw, bad) in (clean or {}).items():
        out = out.withColumn(name, null_out(raw, *[F.col(b) for b in bad]))
    if impute:
        out = materialize(out, "repaired")
    for c in impute:
        out = impute_median(out, c, imputed=f"{c}_imputed", flag=f"{c}_missing")
    return out


KEPT, QUARANTINED = "kept", "quarantined"


def route_conflicts(df: DataFrame, key: Sequence[str], *, name: str = "route") -> DataFrame:
    """Every row with where it goes: all rows of a key whose rows disagree are quarantined, the others kept.

    Rows of a repeated key that agree in every column are kept; ``group_rows`` tells how many there are.
    """
    classed = classify_duplicates(df, key)
    return classed.withColumn(name, F.when(F.col("dup_class") == "conflict", QUARANTINED).otherwise(KEPT))


def routed_account(routed: DataFrame, key: Sequence[str], *, name: str = "route") -> DataFrame:
    """Rows, distinct keys and largest key of each route; the rows of all routes are those of the input."""
    per_key = routed.groupBy(name, *key).agg(row_count().alias("n"))
    return per_key.groupBy(name).agg(F.sum("n").alias("n_rows"), row_count().alias("n_keys"), F.max("n").alias("largest_key"))


def repair_facts(
    fact: DataFrame,
    entity: DataFrame,
    *,
    fact_key: str,
    entity_key: str,
    fact_date: str,
    start_date: str,
    flags: Mapping[str, Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Fact rows with the before-start flag, value flags and carried entity flags; none is removed."""
    flagged = flag_before_start(
        fact, entity, fact_key=fact_key, entity_key=entity_key, fact_date=fact_date, start_date=start_date)
    if carry:
        extra = entity.select(F.col(entity_key).alias("__k"), *carry)
        flagged = flagged.join(extra, flagged[fact_key] == F.col("__k"), "left").drop("__k")
    return flagged.withColumns(dict(flags)) if flags else flagged


def flag_counts(df: DataFrame, flags: Sequence[str], clean: Sequence[str] = ()) -> DataFrame:
    """Rows per flag and NULLs per clean column."""
    pairs = [(f, F.count_if(F.col(f))) for f in flags] + [(c, F.count_if(F.col(c).isNull())) for c in clean]
    row = df.agg(row_count().alias("n"), *[agg.alias(f"c{i}") for i, (_, agg) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"c{i}").alias("n_rows"), F.col("n").alias("total_rows"))
        for i, (name, _) in enumerate(pairs)
    ])))


def _joined_means(facts: DataFrame, labels: DataFrame, key: str, label_key: str, label: str, columns: Mapping[str, str]) -> DataFrame:
    """Row count, label mean and column means of ``facts`` joined to ``labels``, as one row.

    Both sides are summed per key first, so repeated keys multiply in arithmetic and not in rows.
    """
    f = facts.groupBy(F.col(key).alias("k")).agg(row_count().alias("n"), *[
        a for name, c in columns.items() for a in (F.sum(c).alias(f"s_{name}"), F.count(c).alias(f"c_{name}"))
    ])
    y = labels.groupBy(F.col(label_key).alias("k")).agg(
        row_count().alias("m"), F.sum(label).alias("sy"), F.count(label).alias("cy"))
    joined = f.join(y, "k")
    return joined.agg(F.struct(
        F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).cast("double").alias("rows_joined"),
        F.try_divide(F.sum(F.col("n") * F.col("sy")), F.sum(F.col("n") * F.col("cy"))).alias("label_rate"),
        *[F.try_divide(F.sum(F.col(f"s_{x}") * F.col("m")), F.sum(F.col(f"c_{x}") * F.col("m"))).alias(f"mean_{x}") for x in columns],
    ).alias("s"))


def impact(
    raw: DataFrame,
    audited: DataFrame,
    labels: DataFrame,
    *,
    key: str,
    label_key: str,
    label: str,
    metrics: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Headline numbers before and after the audit: (metric, naive, audited, change).

    ``metrics`` maps a name to (raw column, audited column).
    """
    naive = _joined_means(raw, labels, key, label_key, label, {k: v[0] for k, v in metrics.items()})
    after = _joined_means(audited, labels, key, label_key, label, {k: v[1] for k, v in metrics.items()})
    names = ["rows_joined", "label_rate", *[f"mean_{m}" for m in metrics]]
    both = naive.select(F.lit("naive").alias("side"), "s.*").unionByName(after.select(F.lit("audited").alias("side"), "s.*"))
    wide = both.groupBy().agg(*[
        F.max(F.when(F.col("side") == side, F.col(n))).alias(f"{side}_{n}") for side in ("naive", "audited") for n in names
    ])
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("metric"), F.col(f"naive_{n}").alias("naive"), F.col(f"audited_{n}").alias("audited"),
            (F.col(f"audited_{n}") - F.col(f"naive_{n}")).alias("change"),
        ) for n in names
    ])))
