"""Stream versions of the rules, over the events file as a stream that ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import utc_day, utc_instant
from ..operators.monitor import reference_bins
from ..sources.scratch import materialize
from ..sources.tables import Tables
from ..streaming import ingest as N
from .evaluation_queries import _psi_sql
from .registry import query, rounded


def _events(t: Tables) -> DataFrame:
    stream = N.file_stream(t.spark, t.folder, t("events").schema, pattern="events.parquet")
    return stream.withColumn("ts", utc_instant("ts"))


@query("stream_flags", sql="""
SELECT event_id, value <= 0.05 AS dq_value_floor, value < 0 AS dq_negative, props IS NULL OR trim(props) = '' AS dq_no_props FROM events
""")
def stream_flags(t: Tables) -> DataFrame:
    flagged = N.flag_rows(_events(t), {
        "dq_value_floor": F.col("value") <= 0.05, "dq_negative": F.col("value") < 0,
        "dq_no_props": F.col("props").isNull() | (F.trim("props") == "")})
    return N.run_available(flagged.select("event_id", "dq_value_floor", "dq_negative", "dq_no_props"), "stream-flags")


@query("stream_dedup", sql="SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    days = _events(t).withColumn("day", utc_day("ts"))
    unique = N.drop_repeats(days, ["user_id", "event_type", "day"], "ts", "1 day")
    return N.run_available(unique.select("user_id", "event_type", "day"), "stream-dedup")


@query("stream_window_profile", sql="""
WITH w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, count(*) - count(value) AS nulls, count(*) FILTER (WHERE value < 0) AS negatives, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, n, nulls, negatives, round(m, 6) AS mean, round(s, 6) AS sd FROM w
""")
def stream_window_profile(t: Tables) -> DataFrame:
    p = N.run_to_end(N.window_profile(_events(t), "value", "ts", "1 day", "1 hour"), "stream-profile", ["window_start"])
    return rounded(p.select(utc_day("window_start").alias("day"), "n", "nulls", "negatives", "mean", "sd"))


_SOURCE = "(SELECT CAST(day(ts) AS INTEGER) AS day, ts, value, CAST(user_id AS DOUBLE) AS user_id FROM events)"


@query("stream_psi", sql=f"""
SELECT metric, strftime(make_date(2024, 1, day), '%Y-%m-%d') AS window_day, CAST(n AS BIGINT) AS n, round(psi, 6) AS psi
FROM {_psi_sql(_SOURCE, 'day', ['value', 'user_id'], 'day <= 10')}
""")
def stream_psi(t: Tables) -> DataFrame:
    reference = materialize(
        reference_bins(t("events").where(F.dayofmonth("ts") <= 10), ["value", "user_id"]), "stream-reference")
    live = N.window_psi(_events(t), reference, ["value", "user_id"], "ts", "1 day", "1 hour")
    out = N.run_to_end(live, "stream-psi", ["metric", "window_start"])
    return rounded(out.select("metric", utc_day("window_start").alias("window_day"), "n", "psi"))


@query("stream_before_start", sql="""
WITH s AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id, coalesce(ts < start, false) AS dq_before_start FROM events e LEFT JOIN s ON e.user_id = s.user_id
""")
def stream_before_start(t: Tables) -> DataFrame:
    signup = t("events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("u")).agg(utc_instant(F.min("ts")).alias("signup_ts"))
    entity = materialize(signup, "stream-entity")
    flagged = N.flag_before_start_stream(_events(t), entity, key="user_id", entity_key="u", time="ts", start="signup_ts")
    return N.run_available(flagged.select("event_id", "dq_before_start"), "stream-before-start")
