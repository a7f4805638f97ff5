"""Streaming extension, each query against its batch twin in SQL."""

from pyspark.sql import functions as F

from eventide.catalog import register
from eventide.functions.scalar import r6
from eventide.streaming import operators as T


def _events(spark, d):
    return T.read_events(spark, f"{d}/events.parquet")


@register("stream_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", dates="start")
def _(spark, d):
    return T.run_available(T.tumbling(_events(spark, d), "1 day"), "complete").withColumn("total", F.round("total", 4))


@register("stream_sliding", "SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS start, event_type, count(*) AS n, max(value) AS high FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2", dates="start")
def _(spark, d):
    return T.run_available(T.sliding(_events(spark, d), "2 hours", "1 hour"), "complete")


@register("stream_session", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, date_trunc('second', min(ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid", dates="start")
def _(spark, d):
    x = T.run_available(T.sessions(_events(spark, d), "6 hours"), "complete")
    return x.select("user_id", F.date_trunc("second", "start").alias("start"), "n", F.round("total", 4).alias("total"))


@register("stream_dedup", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    e = _events(spark, d)
    return T.run_available(T.dedup(e.union(e), ["event_id"]).select("event_id"), "append")


@register("stream_ewma", "WITH RECURSIVE o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events), e AS (SELECT event_type, event_id, rn, value AS mean FROM o WHERE rn = 1 UNION ALL SELECT o.event_type, o.event_id, o.rn, 0.5 * e.mean + 0.5 * o.value FROM e JOIN o ON o.event_type = e.event_type AND o.rn = e.rn + 1) SELECT event_type, event_id, round(mean, 6) AS mean FROM e")
def _(spark, d):
    return T.run_available(T.ewma(_events(spark, d), 3), "append").select("event_type", "event_id", r6("mean").alias("mean"))
