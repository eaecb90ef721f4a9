"""Queries over the log table and the table queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import keyed, metrics, queue
from logweir.plans import sql as S
from logweir.plans import views as V
from logweir.plans.ingest import as_of
from logweir.plans.registry import query
from logweir.session import work_dir
from logweir.streaming import sinks

LATEST = S.with_(S.EV, S.VERSIONS, """latest AS (
  SELECT * FROM versions
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY batch_id DESC, ms DESC, seq DESC) = 1)""")
LOG_COLUMNS = ("event_id", "source", "level", "message", "metadata")
FIRST_BATCHES = 2
ORDER = ("batch_id", "message_id.ms", "message_id.seq")


@query("upsert", LATEST + "SELECT event_id, received_at, event_time, source, level, message, metadata FROM latest")
def upsert(spark, sf_dir):
    """The first batches as the table, all later versions as one batch."""
    versions = V.versions(spark, sf_dir)
    first = versions.where(F.col("batch_id") < FIRST_BATCHES)
    columns = ["event_id", "received_at", "event_time", "source", "level", "message", "metadata"]
    target = keyed.latest_by_key(first, "event_id", ORDER).select(*columns)
    later = versions.where(F.col("batch_id") >= FIRST_BATCHES)
    state = keyed.upsert(target, later, order=ORDER)
    return state.select(*LOG_COLUMNS, *V.ntz("received_at", "event_time"))


def stored_logs(spark, sf_dir):
    """A log table of all versions."""
    path = work_dir(spark, "logs")
    versions = V.versions(spark, sf_dir)
    for batch in range(5):
        sinks.append_logs(versions.where(F.col("batch_id") == batch), path, batch)
    return sinks.current_logs(spark, path)


@query("current_logs", LATEST + """
SELECT event_id, event_time, source, level, message, metadata,
       strftime(event_time, '%Y-%m-%d') AS event_date FROM latest""")
def current_logs(spark, sf_dir):
    return stored_logs(spark, sf_dir).select(
        *LOG_COLUMNS, *V.ntz("event_time"), F.col("event_date").cast("string").alias("event_date")
    )


@query("count_logs", LATEST + "SELECT count(*) AS events FROM latest")
def count_logs(spark, sf_dir):
    return metrics.count_logs(stored_logs(spark, sf_dir))


@query("filter_logs", LATEST + """
SELECT event_id, event_time, source, level FROM latest
WHERE event_time >= TIMESTAMP '2024-01-05 06:00:00' AND event_time < TIMESTAMP '2024-01-20'
  AND source IN ('svc-1', 'svc-2', 'svc-5') AND level IN ('error', 'purchase')""")
def filter_logs(spark, sf_dir):
    moment = lambda text: F.to_timestamp_ntz(F.lit(text)).cast("timestamp")
    rows = metrics.filter_logs(
        stored_logs(spark, sf_dir), moment("2024-01-05 06:00:00"), moment("2024-01-20 00:00:00"),
        ["svc-1", "svc-2", "svc-5"], ["error", "purchase"],
    )
    return rows.select("event_id", *V.ntz("event_time"), "source", "level")


@query("insert_if_absent", S.with_(S.EV, S.QUEUE, S.VERSIONS, """fresh AS (
  SELECT * FROM versions WHERE event_id NOT IN (SELECT id FROM log_dlq)
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY batch_id, ms, seq) = 1)""") + """
SELECT id, source, message FROM log_dlq
UNION ALL SELECT event_id, source, message FROM fresh""")
def insert_if_absent(spark, sf_dir):
    target = V.log_dlq(spark, sf_dir).select("id", "source", "message")
    rows = V.versions(spark, sf_dir).select(F.col("event_id").alias("id"), "source", "message", "batch_id", "message_id")
    return keyed.insert_if_absent(target, rows, "id", ORDER)


@query("insert_queue", S.with_(S.EV, S.QUEUE) + """
SELECT event_id AS id, event_time, message, 0 AS retry_count, level = 'click' AND level <> 'click' AS acknowledged,
       CAST(NULL AS VARCHAR) AS consumer_group
FROM ev WHERE level <> 'click'
UNION ALL
SELECT id, event_time, message, 0, acknowledged, consumer_group FROM log_buffer WHERE level = 'click'""")
def insert_queue(spark, sf_dir):
    """All events offered to a queue that holds the clicks already."""
    queued = V.log_buffer(spark, sf_dir).where(F.col("level") == "click")
    state = queue.insert_queue(queued, V.log_events(spark, sf_dir))
    return state.select("id", *V.ntz("event_time"), "message", "retry_count", "acknowledged", "consumer_group")


MOVED = S.with_(S.EV, S.QUEUE, """moved AS (
  SELECT event_id AS id, event_time, source, level, message, metadata FROM ev WHERE level = 'error'
  UNION ALL
  SELECT replace(event_id, '-8000-', '-9000-'), event_time, source, level, message, metadata
  FROM ev WHERE level = 'purchase')""")


@query("move_to_dlq", MOVED + """
SELECT id, failed_at, reason, event_time, source, level, message, metadata FROM log_dlq
UNION ALL
SELECT id, TIMESTAMP '2024-02-01', 'manual DLQ move', event_time, source, level, message, metadata
FROM moved WHERE id NOT IN (SELECT id FROM log_dlq)""")
def move_to_dlq(spark, sf_dir):
    dlq, _ = moved(spark, sf_dir)
    return dlq.select("id", "reason", *LOG_COLUMNS[1:], *V.ntz("failed_at", "event_time"))


@query("move_to_dlq_buffer", MOVED + """
SELECT id, message, consumer_group FROM log_buffer WHERE id NOT IN (SELECT id FROM moved)""")
def move_to_dlq_buffer(spark, sf_dir):
    _, buffer = moved(spark, sf_dir)
    return buffer.select("id", "message", "consumer_group")


def moved(spark, sf_dir):
    """The errors, each given twice, and events that never were in the queue."""
    columns = [F.col("event_id").alias("id"), *LOG_COLUMNS[1:], "event_time"]
    events = V.log_events(spark, sf_dir)
    errors = events.where(F.col("level") == "error").select(*columns)
    never = events.where(F.col("level") == "purchase").withColumn(
        "event_id", F.replace("event_id", F.lit("-8000-"), F.lit("-9000-"))).select(*columns)
    return keyed.move_to_dlq(
        V.log_buffer(spark, sf_dir), V.log_dlq(spark, sf_dir), errors.unionAll(errors).unionAll(never), as_of()
    )


READABLE = "NOT acknowledged AND (consumer_group IS NULL OR consumer_group = 'g1')"


@query("queue_pending", S.with_(S.EV, S.QUEUE) + f"SELECT id FROM log_buffer WHERE {READABLE}")
def queue_pending(spark, sf_dir):
    return V.log_buffer(spark, sf_dir).where(queue.pending_filter("g1")).select("id")


@query("read_queue_batch", S.with_(S.EV, S.QUEUE) + f"""
SELECT id, received_at, event_time, source, level, message, metadata FROM log_buffer
WHERE {READABLE} ORDER BY received_at, id LIMIT 1000""")
def read_queue_batch(spark, sf_dir):
    batch = queue.read_queue_batch(V.log_buffer(spark, sf_dir), "g1", 1000)
    return batch.select("id", *LOG_COLUMNS[1:], *V.ntz("received_at", "event_time"))


@query("claim_queue", S.with_(S.EV, S.QUEUE, f"""batch AS (
  SELECT id FROM log_buffer WHERE {READABLE} ORDER BY received_at, id LIMIT 1000)""") + """
SELECT id, CASE WHEN id IN (SELECT id FROM batch) THEN 'g1' ELSE consumer_group END AS consumer_group, acknowledged
FROM log_buffer""")
def claim_queue(spark, sf_dir):
    state = queue.claim_queue(V.log_buffer(spark, sf_dir), "g1", 1000)
    return state.select("id", "consumer_group", "acknowledged")


@query("ack_queue", S.with_(S.EV, S.QUEUE) + """
SELECT id, consumer_group,
       acknowledged OR coalesce(level = 'error' AND consumer_group = 'g1', FALSE) AS acknowledged
FROM log_buffer""")
def ack_queue(spark, sf_dir):
    state = queue.ack_queue(V.log_buffer(spark, sf_dir), V.error_ids(spark, sf_dir), "g1")
    return state.select("id", "consumer_group", "acknowledged")
