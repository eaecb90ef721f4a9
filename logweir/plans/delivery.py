"""Queries over the delivery ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import ledger
from logweir.plans import sql as S
from logweir.plans import views as V
from logweir.plans.ingest import as_of
from logweir.plans.registry import query

BASE = S.with_(S.EV, S.DELIVERIES)
MIN_IDLE_MS = 15 * 86_400_000
KEEP = 2_500


@query("group_info", BASE + """
SELECT stream, grp, count(DISTINCT consumer) AS consumers,
       CAST(count(*) FILTER (WHERE acked_at IS NULL) AS BIGINT) AS pending,
       max(ms) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq
FROM deliveries GROUP BY stream, grp""")
def group_info(spark, sf_dir):
    info = ledger.group_info(V.deliveries(spark, sf_dir))
    return info.select(
        "stream", "grp", "consumers", "pending",
        F.col("last_delivered_id.ms").alias("last_ms"), F.col("last_delivered_id.seq").alias("last_seq"),
    )


@query("consumer_info", BASE + f"""
SELECT stream, grp, consumer, CAST(count(*) FILTER (WHERE acked_at IS NULL) AS BIGINT) AS pending,
       epoch_us({S.AS_OF}) // 1000 - epoch_us(max(delivered_at)) // 1000 AS idle_ms
FROM deliveries GROUP BY stream, grp, consumer""")
def consumer_info(spark, sf_dir):
    return ledger.consumer_info(V.deliveries(spark, sf_dir), as_of())


@query("pending_summary", BASE + """
SELECT stream, grp, count(*) AS total, min(ms) AS first_ms, arg_min(seq, (ms, seq)) AS first_seq,
       max(ms) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq, count(DISTINCT consumer) AS consumers
FROM deliveries WHERE acked_at IS NULL GROUP BY stream, grp""")
def pending_summary(spark, sf_dir):
    summary = ledger.pending_summary(V.deliveries(spark, sf_dir))
    return summary.select(
        "stream", "grp", "total",
        F.col("first_message_id.ms").alias("first_ms"), F.col("first_message_id.seq").alias("first_seq"),
        F.col("last_message_id.ms").alias("last_ms"), F.col("last_message_id.seq").alias("last_seq"),
        "consumers",
    )


@query("pending_consumers", BASE + """
SELECT stream, grp, consumer, count(*) AS pending FROM deliveries WHERE acked_at IS NULL GROUP BY stream, grp, consumer""")
def pending_consumers(spark, sf_dir):
    return ledger.pending_by_consumer(V.deliveries(spark, sf_dir))


START_MS = 1_704_672_000_000  # 2024-01-08


@query("pending_messages", BASE + f"""
SELECT ms, seq, consumer, epoch_us({S.AS_OF}) // 1000 - epoch_us(delivered_at) // 1000 AS idle_ms, delivery_count AS retry_count
FROM mine WHERE acked_at IS NULL AND ms >= {START_MS}
ORDER BY ms, seq LIMIT 100""")
def pending_messages(spark, sf_dir):
    page = ledger.pending_messages(
        V.deliveries(spark, sf_dir), V.STREAM, V.GROUP, as_of(), start=f"{START_MS}", count=0
    )
    return page.select("message_id.ms", "message_id.seq", "consumer", "idle_ms", "retry_count")


@query("pending_of_consumer", BASE + f"""
SELECT ms, seq, consumer, epoch_us({S.AS_OF}) // 1000 - epoch_us(delivered_at) // 1000 AS idle_ms, delivery_count AS retry_count
FROM mine WHERE acked_at IS NULL AND consumer = 'c2'
ORDER BY ms, seq LIMIT 250""")
def pending_of_consumer(spark, sf_dir):
    page = ledger.pending_messages(
        V.deliveries(spark, sf_dir), V.STREAM, V.GROUP, as_of(), consumer="c2", count=250
    )
    return page.select("message_id.ms", "message_id.seq", "consumer", "idle_ms", "retry_count")


HIT = f"""stream = 'log_events' AND grp = 'log-processors' AND acked_at IS NULL AND consumer IN ('c1', 'c3')
         AND epoch_us({S.AS_OF}) // 1000 - epoch_us(delivered_at) // 1000 >= {MIN_IDLE_MS}"""


def claimed(spark, sf_dir):
    """All messages of two consumers are named; the pending, idle ones go to another."""
    deliveries = V.deliveries(spark, sf_dir)
    named = V.mine(deliveries).where(F.col("consumer").isin("c1", "c3")).select("message_id")
    return ledger.claim_stale(
        deliveries, V.messages(spark, sf_dir), V.STREAM, V.GROUP, "rescue", MIN_IDLE_MS, named, as_of()
    )


@query("claim_stale", BASE + f"""
SELECT stream, grp, ms, seq, CASE WHEN {HIT} THEN 'rescue' ELSE consumer END AS consumer,
       CASE WHEN {HIT} THEN {S.AS_OF} ELSE delivered_at END AS delivered_at,
       CASE WHEN {HIT} THEN delivery_count + 1 ELSE delivery_count END AS delivery_count
FROM deliveries""")
def claim_stale(spark, sf_dir):
    state, _ = claimed(spark, sf_dir)
    return state.select(
        "stream", "grp", "message_id.ms", "message_id.seq", "consumer", *V.ntz("delivered_at"), "delivery_count")


@query("claimed_events", BASE + f"""
SELECT ms, seq, event_id, message, delivered_at AS event_time FROM deliveries WHERE {HIT} AND n % 11 <> 0""")
def claimed_events(spark, sf_dir):
    _, events = claimed(spark, sf_dir)
    return events.select("message_id.ms", "message_id.seq", "event_id", "message", *V.ntz("event_time"))


def acknowledged(spark, sf_dir):
    """The messages of one consumer are named, each twice."""
    deliveries = V.deliveries(spark, sf_dir)
    named = V.mine(deliveries).where(F.col("consumer") == "c0").select("message_id")
    return ledger.ack_deliveries(deliveries, V.STREAM, V.GROUP, named.unionByName(named), as_of())


@query("ack_deliveries", BASE + f"""
SELECT stream, grp, ms, seq, consumer, acked_at FROM deliveries WHERE NOT (stream = 'log_events' AND grp = 'log-processors')
UNION ALL
SELECT stream, grp, ms, seq, consumer, CASE WHEN consumer = 'c0' THEN coalesce(acked_at, {S.AS_OF}) ELSE acked_at END
FROM mine""")
def ack_deliveries(spark, sf_dir):
    state, _ = acknowledged(spark, sf_dir)
    return state.select("stream", "grp", "message_id.ms", "message_id.seq", "consumer", *V.ntz("acked_at"))


@query("ack_count", BASE + "SELECT count(*) AS acknowledged FROM mine WHERE consumer = 'c0' AND acked_at IS NULL")
def ack_count(spark, sf_dir):
    return acknowledged(spark, sf_dir)[1]


@query("trim_kept", BASE + f"""
(SELECT stream, ms, seq, event_id FROM mine ORDER BY ms DESC, seq DESC LIMIT {KEEP})
UNION ALL SELECT stream, ms, seq, event_id FROM deliveries WHERE stream = 'other_events'""")
def trim_kept(spark, sf_dir):
    kept, _ = ledger.trim_stream(V.messages(spark, sf_dir), V.STREAM, KEEP)
    event_id = F.regexp_extract("payload", r'^\{"event_id":"([^"]*)"', 1)
    return kept.select("stream", "message_id.ms", "message_id.seq", event_id.alias("event_id"))


@query("trim_count", BASE + f"SELECT greatest(count(*) - {KEEP}, 0) AS trimmed FROM mine")
def trim_count(spark, sf_dir):
    return ledger.trim_stream(V.messages(spark, sf_dir), V.STREAM, KEEP)[1]
