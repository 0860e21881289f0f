"""The same operators on a stream: events arrive as files, results are read when input ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.plans.catalog import query
from tallymark.plans.queries_scores import sweep_sql
from tallymark.streaming.cache import drain_lookup_cache
from tallymark.streaming.drain import drain_append, drain_complete, table_stream
from tallymark.streaming.metrics import (
    stream_latency_windows,
    stream_running_cer,
    stream_threshold_counts,
    sweep_on_read,
)


def events(spark, folder) -> DataFrame:
    return table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_running_cer",
    """SELECT event_type AS script, round(avg(CASE WHEN user_id % 6 <> 0 THEN value / 100e0 END), 6) AS running_cer_field,
      count(*) AS n, count(*) FILTER (WHERE user_id % 6 <> 0) AS n_with_gt_fields FROM events GROUP BY event_type""",
)
def _(spark, folder):
    items = events(spark, folder).select(
        F.col("event_type").alias("script"),
        F.when(F.col("user_id") % 6 != 0, F.col("value") / 100.0).alias("cer_field"),
    )
    out = drain_complete(stream_running_cer(items))
    return out.withColumn("running_cer_field", F.round("running_cer_field", 6))


@query(
    "stream_latency_windows",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n,
      count(*) FILTER (WHERE event_type <> 'error') AS successes,
      count(*) FILTER (WHERE event_type = 'error') AS failures,
      round(avg(value * 10e0 / 1000e0), 6) AS mean_seconds, avg(value * 10e0 / 1000e0) < 60 AS passed
    FROM events GROUP BY date_trunc('day', ts)
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY
      <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""",
)
def _(spark, folder):
    log = events(spark, folder).select(
        "ts",
        (F.col("value") * 10.0).alias("elapsed_ms"),
        (F.col("event_type") != "error").alias("success"),
    )
    out = drain_append(stream_latency_windows(log))
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "n",
        "successes",
        "failures",
        F.round("mean_seconds", 6).alias("mean_seconds"),
        "passed",
    )


_EVENT_SCORES = """
event_scores AS (
  SELECT event_type AS domain, value / 60e0 AS score, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS label
  FROM events)"""


@query(
    "stream_threshold_counts",
    f"""WITH {_EVENT_SCORES}, {sweep_sql('event_scores', 'domain')}
    SELECT domain, threshold, tp, fp, tn, fn, tpr, fpr, "precision", f1, accuracy FROM swept""",
)
def _(spark, folder):
    rows = events(spark, folder).select(
        F.col("event_type").alias("domain"),
        (F.col("value") / 60.0).alias("score"),
        F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("label"),
    )
    counts = drain_complete(stream_threshold_counts(rows, ["domain"]))
    return sweep_on_read(counts, ["domain"])


LOOKUPS = """
    requests AS (
      SELECT event_id AS request_id, event_type AS source, 'User' || user_id % 20 AS handle, epoch_us(ts) AS us,
        CASE user_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'not_found' ELSE 'ok' END AS status FROM events),
    storable AS (SELECT source, handle, us, request_id, status FROM requests WHERE status IN ('ok', 'not_found')),
    stores AS (
      SELECT source, handle, min(us) AS us FROM storable GROUP BY source, handle
      UNION ALL
      SELECT s.source, s.handle, (SELECT min(n.us) FROM storable n WHERE n.source = s.source AND n.handle = s.handle
          AND n.us > s.us + 86400000000) AS us
      FROM stores s WHERE s.us IS NOT NULL),
    held AS (
      SELECT s.source, s.handle, s.us, arg_min(x.request_id, x.request_id) AS by_request,
             arg_min(x.status, x.request_id) AS held_status
      FROM stores s JOIN storable x USING (source, handle, us) WHERE s.us IS NOT NULL GROUP BY ALL)"""


def lookups(spark, folder):
    status = (
        F.when(F.col("user_id") % 5 == 0, "timeout").when(F.col("user_id") % 5 == 1, "not_found").otherwise("ok")
    )
    requests = events(spark, folder).select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("User"), (F.col("user_id") % 20).cast("string")).alias("handle"),
        "ts",
        status.alias("status"),
    )
    return drain_lookup_cache(requests, ttl_seconds=86400.0)


@query(
    "stream_lookup_cache",
    f"""WITH RECURSIVE {LOOKUPS}
    SELECT r.request_id, r.source, r.handle, coalesce(h.held_status, r.status) AS status,
           h.us IS NOT NULL AS cached
    FROM requests r LEFT JOIN held h ON h.source = r.source AND h.handle = r.handle
      AND r.us BETWEEN h.us AND h.us + 86400000000
      AND NOT (r.us = h.us AND r.request_id <= h.by_request)""",
)
def _(spark, folder):
    return lookups(spark, folder).rows.drop("ts")


@query(
    "stream_lookup_state",
    f"""WITH RECURSIVE {LOOKUPS}
    SELECT source, lower(handle) AS handle, us AS at_us, held_status AS status FROM held
    WHERE us + 86400000000 >= (SELECT max(us) FROM requests)""",
)
def _(spark, folder):
    """Results still held when the stream ends: those whose time has not run out."""
    held = lookups(spark, folder).state
    return held.select("source", "handle", F.round(F.col("at") * 1000000.0).cast("bigint").alias("at_us"), "status")
