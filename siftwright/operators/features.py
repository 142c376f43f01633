"""Panel features: one row per entity from one row per (entity, period).

A panel is built with :func:`build_panel`, so an entity owns at most one row per period and its
series is never longer than the calendar, however many fact rows it has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_ratio, ols_slope, safe_ratio, tenure_months, trend_r2
from .ordering import quantiles, unpivot
from .profile import long_stats

FAMILIES = ("level", "volatility", "trend")
NOTE = "feature"  # key of a feature's note in the metadata of its column

# What a panel feature is taken for; {c} is the panel column.
_WHY = {
    "mean": "how much {c} there is in an average period", "median": "usual {c}, whatever single periods did", "min": "weakest period of {c}",
    "max": "strongest period of {c}", "sd": "how far {c} swings between periods", "cv": "swing of {c} in units of its own level",
    "slope": "change of {c} from one period to the next on a straight line", "rel_slope": "that change in units of the level of {c}",
    "halfratio": "late {c} over early {c}, free of the shape in between", "last_minus_first": "{c} gained or lost over the whole series",
    "trend_r2": "how well a straight line tells {c}", "declining": "whether the line of {c} falls",
}


def noted(c: Column | str, name: str, family: str, inputs: Sequence[str], why: str) -> Column:
    """A feature column that carries its family, inputs and reason in its metadata, through joins and stored tables."""
    c = F.col(c) if isinstance(c, str) else c
    return c.alias(name, metadata={NOTE: {"family": family, "inputs": ",".join(inputs), "rationale": why}})


def with_notes(df: DataFrame, notes: Mapping[str, tuple[str, Sequence[str], str]]) -> DataFrame:
    """``df`` with notes (family, inputs, reason) on the named columns; the others keep theirs."""
    return df.select(*[noted(c, c, *notes[c]) if c in notes else F.col(c) for c in df.columns])


def build_panel(facts: DataFrame, entity: str, period: Column, metrics: Mapping[str, Column]) -> DataFrame:
    """Aggregate fact rows to (entity, t, metrics); ``metrics`` maps names to aggregates."""
    return facts.groupBy(entity, period.alias("t")).agg(*[a.alias(m) for m, a in metrics.items()])


# The ends of feature names (_mean, _sd, _cv, _slope, _rel_slope, _halfratio, _last_minus_first,
# _trend_r2, _declining, _first3, _last3, _last1) are what readers of the feature table expect.
def _mean_of(items: Column, field: str) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda acc, s: acc + s.getField(field))
    return F.when(F.size(items) > 0, total / F.size(items))


def panel_features(
    panel: DataFrame,
    entity: str,
    metrics: Mapping[str, str],
    *,
    period: str = "t",
    k: int = 3,
    families: Sequence[str] = FAMILIES,
    extras: bool = False,
) -> DataFrame:
    """Level, volatility and trend of every metric, per entity, in one aggregate.

    ``metrics`` maps a feature prefix to a panel column. ``k`` is the length of the early and late
    stretch; ``extras`` adds their means and the last value.
    """
    t = F.col(period).cast("double")
    aggs: list[Column] = []
    trend = "trend" in families or extras
    for tag, c in metrics.items():
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"{tag}_mean"), F.stddev_pop(v).alias(f"{tag}_sd")]
        if "level" in families:
            aggs += [F.median(v).alias(f"{tag}_median"), F.min(v).alias(f"{tag}_min"), F.max(v).alias(f"{tag}_max")]
        if trend:
            aggs += [
                ols_slope(v, t).alias(f"{tag}_slope"), trend_r2(v, t).alias(f"{tag}_trend_r2"),
                (F.max_by(v, t) - F.min_by(v, t)).alias(f"{tag}_last_minus_first"),
            ]
    if trend:
        series = F.array_sort(F.collect_list(F.struct(t.alias("t"), *[F.col(c).cast("double").alias(tag) for tag, c in metrics.items()])))
        aggs.append(series.alias("__series"))
    g = panel.groupBy(entity).agg(*aggs)
    if trend:
        g = g.withColumn("__early", F.slice("__series", 1, k)).withColumn(
            "__late", F.slice("__series", F.greatest(F.size("__series") - k + 1, F.lit(1)), k))
    out: list[Column] = [F.col(entity)]
    for tag, source in metrics.items():
        mean, sd, slope = F.col(f"{tag}_mean"), F.col(f"{tag}_sd"), F.col(f"{tag}_slope")

        def add(family: str, **features: Column) -> None:
            out.extend(noted(c, f"{tag}_{name}", f"usage_{family}", [source], _WHY[name].format(c=source)) for name, c in features.items())

        if "level" in families:
            add("level", mean=mean, median=F.col(f"{tag}_median"), min=F.col(f"{tag}_min"), max=F.col(f"{tag}_max"))
        if "volatility" in families:
            add("volatility", sd=sd, cv=safe_ratio(sd, mean))
        if trend:
            early, late = _mean_of(F.col("__early"), tag), _mean_of(F.col("__late"), tag)
        if "trend" in families:
            add("trend", slope=slope, rel_slope=safe_ratio(slope, mean), halfratio=half_ratio(early, late),
                last_minus_first=F.col(f"{tag}_last_minus_first"), trend_r2=F.col(f"{tag}_trend_r2"), declining=(slope < 0).cast("int"))
        if extras:
            ends = {f"first{k}": early, f"last{k}": late, "last1": F.element_at("__series", -1).getField(tag)}
            out += [noted(c, f"{tag}_{name}", "usage_ends", [source], f"{source} at one end of the series") for name, c in ends.items()]
    return g.select(*out)


def engagement_features(
    panel: DataFrame,
    entity: str,
    *,
    zero_periods: Mapping[str, str] | None = None,
    active_periods: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    ratios: Mapping[str, tuple[str, str]] | None = None,
    products: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Counts of silent and active periods, totals, ratios of totals and products of features.

    Names map to panel columns; ``ratios`` to (numerator, denominator) columns, summed first;
    ``products`` to two features made here.
    """
    aggs = [F.count_if(F.col(c) == 0).alias(n) for n, c in (zero_periods or {}).items()]
    aggs += [F.count_if(F.col(c) > 0).alias(n) for n, c in (active_periods or {}).items()]
    aggs += [F.sum(c).alias(n) for n, c in (totals or {}).items()]
    aggs += [safe_ratio(F.sum(a), F.sum(b)).alias(n) for n, (a, b) in (ratios or {}).items()]
    g = panel.groupBy(entity).agg(*aggs)
    g = g.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in (products or {}).items()})
    family = "engagement"
    return with_notes(g, {
        **{n: (family, [c], f"periods without {c}") for n, c in (zero_periods or {}).items()},
        **{n: (family, [c], f"periods with {c}") for n, c in (active_periods or {}).items()},
        **{n: (family, [c], f"all {c} together") for n, c in (totals or {}).items()},
        **{n: (family, list(ab), f"{ab[0]} for each of {ab[1]}, over all periods") for n, ab in (ratios or {}).items()},
        **{n: (family, list(ab), f"{ab[0]} and {ab[1]} at the same time") for n, ab in (products or {}).items()},
    })


def tenure_features(df: DataFrame, start: str, *, window_start: Column, window_end: Column) -> DataFrame:
    """Months of tenure at the end of the window, start year, and whether the start lies inside it."""
    return with_notes(df.withColumns({
        "tenure_months": tenure_months(start, window_end),
        "start_year": F.year(start),
        "started_in_window": (F.col(start) >= window_start).cast("int"),
    }), {
        "tenure_months": ("contract", [start], "months since the start, at the end of the window"),
        "start_year": ("contract", [start], "year of the start"),
        "started_in_window": ("contract", [start], "whether the whole history lies inside the window"),
    })


def join_features(entity: DataFrame, key: str, parts: Sequence[DataFrame]) -> DataFrame:
    """Left-join feature parts, each one row per key, on the same key."""
    out = entity
    for p in parts:
        out = out.join(p, key, "left")
    return out


def null_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold at least one NULL; one pass, one row returned."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 0]


def fill_with_indicator(df: DataFrame, columns: Sequence[str], with_gaps: Sequence[str]) -> DataFrame:
    """``<column>_nobase`` where a gap was, then the column's exact median in the gap."""
    if not with_gaps:
        return df
    medians = quantiles(unpivot(df, with_gaps), "value", {"m": 0.5}, ["metric"])
    lookup = medians.agg(F.map_from_entries(F.collect_list(F.struct("metric", "m")))).scalar()
    out = df.withColumn("__medians", lookup)
    cols = []
    for c in df.columns:
        if c in with_gaps:
            cols.append(F.coalesce(F.col(c).cast("double"), F.col("__medians")[F.lit(c)]).alias(c))
        else:
            cols.append(F.col(c))
    cols += [F.col(c).isNull().cast("int").alias(f"{c}_nobase") for c in with_gaps]
    return out.select(*cols)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """0/1 columns for every listed value but the alphabetically first; other values and NULL are 0 in all."""
    rest = sorted(values)[1:]
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in rest})


def feature_catalogue(table: DataFrame) -> DataFrame:
    """Family, inputs and reason of every feature, as its builder noted them, beside its gaps and mean in the table.

    Columns without a note (keys, labels, flags) are no features; the mean of a text is NULL.
    """
    notes = {f.name: f.metadata[NOTE] for f in table.schema.fields if NOTE in f.metadata}
    if not notes:
        raise ValueError("no column of the table carries a feature note")
    s = long_stats(table, list(notes), {
        "n": lambda c: F.count(c), "n_missing": lambda c: F.count_if(F.col(c).isNull()), "mean": lambda c: F.avg(F.col(c).try_cast("double")),
    }, name="feature")
    lookup = F.create_map(*[x for f, note in notes.items() for x in (F.lit(f), F.struct(*[F.lit(note[k]).alias(k) for k in ("family", "inputs", "rationale")]))])
    return s.select(lookup[F.col("feature")].alias("note"), "feature", "n", "n_missing", "mean").select("note.*", "feature", "n", "n_missing", "mean")
