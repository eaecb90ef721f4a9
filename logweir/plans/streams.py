"""Queries of the stateful streams: dedup, idle redelivery, acknowledgements, batch reports, ticks."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logweir.plans import sql as S
from logweir.plans import views as V
from logweir.plans.delivery import MIN_IDLE_MS
from logweir.plans.ingest import as_of
from logweir.plans.registry import query
from logweir.session import work_dir
from logweir.streaming import jobs, sinks, stateful

TICK = "tick"


def drained(stream, path, name):
    """Run the stream to its end and read what it gave: a folder per batch."""
    out = f"{path}/{name}"
    stream.writeStream.foreachBatch(
        lambda rows, n: sinks.write_once(rows, f"{out}/batch={n}")
    ).option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/batch=*")


@query("stream_dedup", S.with_(S.EV, """newest AS (SELECT max(received_at) AS last FROM ev)""") + """
SELECT event_id, received_at > last - to_days(20) AS held_back,
       CASE WHEN received_at > last - to_days(20) THEN message ELSE 'again ' || message END AS message,
       CASE WHEN received_at > last - to_days(20) THEN 1 ELSE 2 END AS versions
FROM ev, newest""")
def stream_dedup(spark, sf_dir):
    """All events, errors twice; then all again. Ids seen within ten days stay out, older ones pass and are folded."""
    path = work_dir(spark, "dedup")
    events = V.log_events(spark, sf_dir)
    last = events.agg(F.max("received_at").alias("last"))
    again = events.join(F.broadcast(last)).withColumns({
        "first_at": F.col("received_at"), "message": F.concat(F.lit("again "), "message"),
        "received_at": F.col("last") + F.expr("INTERVAL 1 SECOND")})
    for batch, rows in enumerate((events.unionByName(events.where("level = 'error'")), again)):
        sinks.append_buffer(rows, f"{path}/buffer", batch)
        jobs.consume_job(
            spark, f"{path}/buffer", f"{path}/logs", f"{path}/dlq", f"{path}/quarantine", f"{path}/reports",
            f"{path}/checkpoint", once=True, dedup="10 days", dedup_time="received_at",
        ).awaitTermination()
    logs = sinks.current_logs(spark, f"{path}/logs").select("event_id", "message")
    stored = sinks.versions(spark, f"{path}/logs", sinks.stored_batches(spark, f"{path}/logs"))
    counts = stored.groupBy("event_id").agg(F.count("*").cast("int").alias("versions"))
    return logs.join(counts, "event_id").select(
        "event_id", (F.col("versions") == 1).alias("held_back"), "message", "versions")


def ticks(spark, at, **columns):
    """A row of no message that moves the streams' time to ``at``."""
    named = {"stream": F.lit(TICK), "grp": F.lit(TICK), "ms": F.lit(0).cast("long"), "seq": F.lit(0).cast("long"),
             "consumer": F.lit(TICK), **columns}
    return spark.range(1).select(*[value.alias(name) for name, value in named.items()], *at)


BASE = S.with_(S.EV, S.DELIVERIES)


@query("idle_redelivery", BASE + f"""
SELECT stream, grp, ms, seq, 'rescue' AS consumer, {S.AS_OF} AS delivered_at, delivery_count + 1 AS delivery_count
FROM deliveries WHERE acked_at IS NULL AND epoch_us({S.AS_OF}) // 1000 - epoch_us(delivered_at) // 1000 >= {MIN_IDLE_MS}""")
def idle_redelivery(spark, sf_dir):
    """Timers hand on what ``claim_stale`` would claim at the same moment, in all streams and groups."""
    path = work_dir(spark, "idle")
    entries = stateful.ledger_entries(V.deliveries(spark, sf_dir))
    entries.write.parquet(f"{path}/entries")
    ticks(spark, [as_of().alias("at")], kind=F.lit(stateful.ACKED), delivery_count=F.lit(0).cast("long")).select(
        *entries.columns).write.mode("append").parquet(f"{path}/entries")
    stream = spark.readStream.schema(entries.schema).parquet(f"{path}/entries")
    found = drained(stateful.redeliver_idle(stream, "rescue", MIN_IDLE_MS, "0 seconds"), path, "found")
    return found.select("stream", "grp", "ms", "seq", "consumer", *V.ntz("delivered_at"), "delivery_count")


@query("ack_stream", BASE + """
SELECT stream, grp, ms, seq, consumer, delivered_at,
       CASE WHEN seq % 240 <= 120 THEN acked_at + to_minutes(CAST(seq % 240 AS INTEGER)) END AS acked_at
FROM deliveries""")
def ack_stream(spark, sf_dir):
    """Deliveries joined with acks that come up to four hours later, of which two count."""
    path = work_dir(spark, "acks")
    ledger = V.deliveries(spark, sf_dir).select("stream", "grp", "message_id.*", "consumer", "delivered_at", "acked_at")
    later = F.timestamp_micros(F.unix_micros("acked_at") + F.col("seq") % 240 * 60_000_000)
    sides = {
        "delivered_at": ledger.drop("acked_at"),
        "acked_at": ledger.where("acked_at IS NOT NULL").select(*stateful.KEYS, later.alias("acked_at")),
    }
    streams = []
    for name, rows in sides.items():
        rows.write.parquet(f"{path}/{name}")
        ticks(spark, [as_of().alias(name)]).select(*rows.columns).write.mode("append").parquet(f"{path}/{name}")
        streams.append(spark.readStream.schema(rows.schema).parquet(f"{path}/{name}"))
    found = drained(stateful.acks_of(*streams, "2 HOURS"), path, "found").where(F.col("stream") != TICK)
    return found.select(*stateful.KEYS, "consumer", *V.ntz("delivered_at", "acked_at"))


@query("tick_run", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT parse_status = 'ok' AS accepted, count(*) AS lines FROM decoded GROUP BY 1""")
def tick_run(spark, sf_dir):
    """Ingest on the one-second tick while files land: several ticks work them off."""
    path = work_dir(spark, "ticks")
    lines = V.raw_lines(spark, sf_dir)
    part = F.pmod(F.xxhash64("value"), F.lit(3))
    lines.where(part == 0).write.mode("append").text(f"{path}/landing")
    job = jobs.ingest_job(
        spark, f"{path}/landing", f"{path}/buffer", f"{path}/checkpoint", f"{path}/spill", f"{path}/bad",
        reports=f"{path}/reports")
    try:
        job.processAllAvailable()
        for turn in (1, 2):
            lines.where(part == turn).write.mode("append").text(f"{path}/landing")
            job.processAllAvailable()
    finally:
        job.stop()
    sums = sinks.batch_report(spark, f"{path}/reports").agg(
        F.sum("events").alias("events"), F.sum("refused").alias("refused"), F.count("*").alias("ticks"))
    kinds = F.explode(F.array(
        F.struct(F.lit(True).alias("accepted"), F.col("events").alias("lines")),
        F.struct(F.lit(False).alias("accepted"), F.col("refused").alias("lines"))))
    return sums.where("ticks >= 3").select(kinds.alias("x")).select("x.*")


@query("failed_batch_again", S.with_(S.EV) + "SELECT event_id, message, 2 AS runs FROM ev")
def failed_batch_again(spark, sf_dir):
    """A consumer dies after its write and before its commit; the batch comes again and counts once."""
    path = work_dir(spark, "again")
    sinks.append_buffer(V.log_events(spark, sf_dir), f"{path}/buffer", 0)
    runs = []

    def write(rows, n):
        runs.append(n)
        done = sinks.append_logs(rows, f"{path}/logs", n, sinks.checkpoint_origin(spark, "consume"))
        if len(runs) == 1:
            raise RuntimeError("lost after the write")
        return done

    def refuse(rows, n, reason, origin):
        raise RuntimeError("no dead letters either")

    for _ in range(2):
        job = jobs.consume_job(
            spark, f"{path}/buffer", f"{path}/logs", f"{path}/dlq", f"{path}/quarantine", f"{path}/reports",
            f"{path}/checkpoint", attempts=1, write_fn=write, once=True, dlq_fn=refuse)
        try:
            job.awaitTermination()
        except StreamingQueryException:
            continue
    return sinks.current_logs(spark, f"{path}/logs").select("event_id", "message", F.lit(len(runs)).alias("runs"))
