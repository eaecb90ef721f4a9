"""Queries of the ingest-rate series."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import metrics
from logweir.plans import sql as S
from logweir.plans import views as V
from logweir.plans.registry import query

HOUR = 3_600

HOURLY = S.with_(S.EV, """spans AS (
  SELECT source, min(date_trunc('hour', received_at)) AS first, max(date_trunc('hour', received_at)) AS last
  FROM ev GROUP BY source),
ticks AS (
  SELECT source, unnest(generate_series(first, last, INTERVAL 1 HOUR)) AS window_start FROM spans),
counts AS (
  SELECT source, date_trunc('hour', received_at) AS window_start, count(*) AS events FROM ev GROUP BY ALL),
series AS (
  SELECT source, window_start, coalesce(events, 0) AS events, coalesce(events, 0) / 3600.0::DOUBLE AS rate,
         row_number() OVER (PARTITION BY source ORDER BY window_start) AS tick
  FROM ticks LEFT JOIN counts USING (source, window_start))""")


@query("ingest_rate", S.with_(S.EV) + """
SELECT date_trunc('second', received_at) AS window_start, count(*) AS events, CAST(count(*) AS DOUBLE) AS rate
FROM ev GROUP BY 1""")
def ingest_rate(spark, sf_dir):
    return metrics.ingest_rate(V.log_events(spark, sf_dir)).select(*V.ntz("window_start"), "events", "rate")


@query("ingest_rate_dense", S.with_(S.EV, """spans AS (
  SELECT min(date_trunc('second', received_at)) AS first, max(date_trunc('second', received_at)) AS last FROM ev),
ticks AS (SELECT unnest(generate_series(first, last, INTERVAL 1 SECOND)) AS window_start FROM spans),
counts AS (SELECT date_trunc('second', received_at) AS window_start, count(*) AS events FROM ev GROUP BY 1),
series AS (
  SELECT window_start, coalesce(events, 0) AS events FROM ticks LEFT JOIN counts USING (window_start))""") + """
SELECT date_trunc('hour', window_start) AS window_hour, count(*) AS ticks,
       CAST(count(*) FILTER (WHERE events = 0) AS BIGINT) AS idle_ticks, CAST(sum(events) AS BIGINT) AS events,
       CAST(max(events) AS DOUBLE) AS peak_rate
FROM series GROUP BY 1""")
def ingest_rate_dense(spark, sf_dir):
    """Every second between the first and the last event, reported by the hour."""
    series = metrics.ingest_rate(V.log_events(spark, sf_dir), dense=True)
    hours = series.groupBy(F.date_trunc("hour", "window_start").alias("window_hour")).agg(
        F.count("*").alias("ticks"), F.count_if(F.col("events") == 0).alias("idle_ticks"),
        F.sum("events").alias("events"), F.max("rate").alias("peak_rate"),
    )
    return hours.withColumn("window_hour", F.col("window_hour").cast("timestamp_ntz"))


def hourly(spark, sf_dir):
    return metrics.ingest_rate(V.log_events(spark, sf_dir), HOUR, ["source"], dense=True)


@query("hourly_rate", HOURLY + "SELECT source, window_start, events, rate FROM series")
def hourly_rate(spark, sf_dir):
    return hourly(spark, sf_dir).select("source", *V.ntz("window_start"), "events", "rate")


@query("trailing_rates", HOURLY + """
SELECT s.source, s.window_start, p.pos, coalesce(e.events, 0) AS events
FROM series s CROSS JOIN (SELECT unnest(range(60)) AS pos) p
LEFT JOIN series e ON e.source = s.source AND e.tick = s.tick - 59 + p.pos""")
def trailing_rates(spark, sf_dir):
    """The last 60 points at every tick, one row per point."""
    frames = metrics.trailing_rates(hourly(spark, sf_dir), tick_seconds=HOUR, by=["source"])
    points = frames.select("source", *V.ntz("window_start"), F.posexplode("points").alias("pos", "rate"))
    return points.select(
        "source", "window_start", F.col("pos").cast("long").alias("pos"),
        F.round(F.col("rate") * HOUR).cast("long").alias("events"),
    )


@query("normalize_rates", S.with_(S.EV, """counts AS (
  SELECT source, date_trunc('hour', received_at) AS window_start, count(*) AS events FROM ev GROUP BY ALL),
spans AS (
  SELECT source, min(window_start) AS first, max(window_start) AS last FROM counts GROUP BY source),
ticks AS (
  SELECT source, unnest(generate_series(first, last, INTERVAL 1 HOUR)) AS window_start FROM spans),
series AS (
  SELECT source, window_start, CAST(coalesce(events, 0) AS DOUBLE) AS rate
  FROM ticks LEFT JOIN counts USING (source, window_start)),
framed AS (
  SELECT *, greatest(max(rate) OVER (PARTITION BY source ORDER BY window_start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 1.0) AS peak
  FROM series)""") + """
SELECT source, window_start, peak, CAST(round(greatest(rate / peak * 100, 1.0) * 1000) AS BIGINT) AS milli_height
FROM framed""")
def normalize_rates(spark, sf_dir):
    """Heights of the hourly counts: the rate here is events per hour, so that peaks exceed 1."""
    rates = hourly(spark, sf_dir).withColumn("rate", F.col("events").cast("double"))
    bars = metrics.normalize_rates(rates, tick_seconds=HOUR, by=["source"])
    return bars.select(
        "source", *V.ntz("window_start"), "peak",
        F.round(F.col("height") * 1000).cast("long").alias("milli_height"),
    )
