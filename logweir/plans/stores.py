"""Queries that write through a sink and read it back: buffer, dead letters, segments, streams."""

from __future__ import annotations

import os
import shutil
import sys
from itertools import chain, islice
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweir.functions.decode import OK, parse_events
from logweir.operators import auth, metrics
from logweir.plans import sql as S
from logweir.plans import views as V
from logweir.plans.ingest import as_of
from logweir.plans.registry import query
from logweir.schema import LOGS
from logweir.session import folder_names, on_disk, remove, work_dir
from logweir.sources.buffer import read_buffer
from logweir.sources.files import load_api_keys, ordered_segments, scan_json_documents, scan_segments, segment_files
from logweir.streaming import jobs, sinks

STAMP = "'%Y-%m-%dT%H:%M:%S.%fZ'"

# The text of a buffered event.
PAYLOAD = f"""'{{"event_id":"' || event_id || '","received_at":"' || strftime(received_at, {STAMP})
  || '","event_time":"' || strftime(event_time, {STAMP}) || '","source":"' || source || '","level":"' || level
  || '","message":"' || message || '","metadata":' || {S.COMPACT} || '}}'"""


def buffered(spark, sf_dir):
    path = work_dir(spark, "buffer")
    sinks.append_buffer(V.log_events(spark, sf_dir), path, 0)
    return path


@query("append_buffer", S.with_(S.EV) + f"SELECT epoch_us(received_at) // 1000 AS ms, {PAYLOAD} AS payload FROM ev")
def append_buffer(spark, sf_dir):
    entries = spark.read.parquet(buffered(spark, sf_dir))
    return entries.select("message_id.ms", "payload")


@query("read_buffer", S.with_(S.EV) + f"""
SELECT epoch_us(received_at) // 1000 AS ms, event_id, received_at, event_time, source, level, message,
       {S.COMPACT} AS metadata, FALSE AS pii_redacted, 'ok' AS parse_status FROM ev""")
def read_back(spark, sf_dir):
    events = read_buffer(spark, buffered(spark, sf_dir))
    return events.select(
        "message_id.ms", "event_id", *V.ntz("received_at", "event_time"), "source", "level", "message",
        "metadata", "pii_redacted", "parse_status",
    )


@query("write_dlq", S.with_(S.EV) + f"""
SELECT {PAYLOAD} AS payload, event_id AS original_event_id, 'log_events' AS original_stream, 'sink failed' AS reason
FROM ev""")
def write_dlq(spark, sf_dir):
    path = work_dir(spark, "dlq")
    sinks.write_dlq(V.log_events(spark, sf_dir), path, 0)
    return spark.read.parquet(path).select("payload", "original_event_id", "original_stream", "reason")


LEVELS = ("click", "error", "purchase", "signup", "view")


def spilled(spark, sf_dir):
    """A spill with a segment per level, and one of lines from elsewhere, some malformed."""
    path = work_dir(spark, "spill")
    events = V.log_events(spark, sf_dir)
    for batch, level in enumerate(LEVELS):
        sinks.write_spill(events.where(F.col("level") == level), path, batch, max_records=1_000)
    return path


SEGMENT = "'segment-ingest-' || lpad(CAST(list_position(['click','error','purchase','signup','view'], level) - 1 AS VARCHAR), 20, '0')"


@query("scan_segments", S.with_(S.EV) + f"""
SELECT {SEGMENT} AS segment, event_id, message, event_time, 'ok' AS parse_status FROM ev""")
def read_segments(spark, sf_dir):
    lines = parse_events(scan_segments(spark, spilled(spark, sf_dir)))
    return lines.select("segment", "event_id", "message", *V.ntz("event_time"), "parse_status")


@query("segment_usage", S.with_(S.EV) + f"""
SELECT count(DISTINCT {SEGMENT}) AS segments, CAST(sum(strlen({PAYLOAD}) + 1) AS BIGINT) AS bytes,
       sum(strlen({PAYLOAD}) + 1) > 1048576 AS over_quota FROM ev""")
def segment_usage(spark, sf_dir):
    return metrics.segment_usage(segment_files(spark, spilled(spark, sf_dir)), 1_048_576)


@query("replay_report", S.with_(S.EV, S.TEXTS, S.DECODED) + f"""
, lines AS (
  SELECT {SEGMENT} AS segment, 'ok' AS parse_status FROM ev
  UNION ALL SELECT 'segment-lines', parse_status FROM decoded
  UNION ALL SELECT 'segment-lines', 'error_parse' FROM ev WHERE n % 50 = 2)
SELECT segment, CAST(count(*) FILTER (WHERE parse_status = 'ok') AS BIGINT) AS replayed,
       CAST(count(*) FILTER (WHERE parse_status <> 'ok') AS BIGINT) AS malformed
FROM lines GROUP BY ROLLUP (segment)""")
def replay_report(spark, sf_dir):
    path = spilled(spark, sf_dir)
    V.raw_lines(spark, sf_dir).write.text(f"{path}/segment-lines")
    return metrics.replay_report(parse_events(scan_segments(spark, path)))


def unreachable(batch, batch_id):
    raise ConnectionError("connection refused")


@query("spill_and_replay", S.with_(S.EV) + f"""
SELECT event_id, received_at, event_time, message, {S.COMPACT} AS metadata FROM ev""")
def spill_and_replay(spark, sf_dir):
    """The buffer is unreachable, the batch is spilled, and the replay brings it back."""
    path = work_dir(spark, "replay")
    spill, buffer = f"{path}/spill", f"{path}/buffer"
    sinks.sink_with_spill(unreachable, spill, persist=False)(V.log_events(spark, sf_dir), 0)
    jobs.replay_spill(spark, spill, buffer, f"{path}/checkpoint", f"{path}/quarantine")
    events = read_buffer(spark, buffer).where(F.col("parse_status") == OK)
    return events.select("event_id", *V.ntz("received_at", "event_time"), "message", "metadata")


@query("exactly_once", S.with_(S.EV) + """
SELECT event_id, message, received_at FROM ev""")
def exactly_once(spark, sf_dir):
    """Two origins, each batch spilled, delivered again with the buffer up, replayed and consumed."""
    path = work_dir(spark, "once")
    spill, buffer = f"{path}/spill", f"{path}/buffer"
    events = V.log_events(spark, sf_dir)
    for origin, part in (("east", F.col("n") % 2 == 0), ("west", F.col("n") % 2 == 1)):
        append = lambda rows, n, origin=origin: sinks.append_buffer(rows, buffer, n, origin)
        batch = events.where(part)
        sinks.sink_with_spill(unreachable, spill, persist=False, origin=origin)(batch, 0)
        sinks.sink_with_spill(append, spill, persist=False, origin=origin)(batch, 0)
        sinks.sink_with_spill(append, spill, persist=False, origin=origin)(batch.where("n % 3 = 0"), 1)
    for _ in range(2):
        jobs.replay_spill(spark, spill, buffer, f"{path}/cp-replay", f"{path}/quarantine")
    jobs.consume_job(
        spark, buffer, f"{path}/logs", f"{path}/dlq", f"{path}/quarantine", f"{path}/reports", f"{path}/cp-consume",
        once=True, max_files=2,
    ).awaitTermination()
    return sinks.current_logs(spark, f"{path}/logs").select("event_id", "message", *V.ntz("received_at"))


@query("replay_quarantine", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT parse_status, count(*) AS lines FROM decoded WHERE parse_status <> 'ok' GROUP BY parse_status""")
def replay_quarantine(spark, sf_dir):
    """Malformed lines of a spill: none reaches the buffer, each has its place kept."""
    path = work_dir(spark, "malformed")
    V.raw_lines(spark, sf_dir).write.text(f"{path}/spill/segment-lines")
    jobs.replay_spill(spark, f"{path}/spill", f"{path}/buffer", f"{path}/checkpoint", f"{path}/quarantine")
    held = spark.read.parquet(f"{path}/quarantine").dropDuplicates(["file", "block_start", "line_in_block"])
    return held.groupBy("parse_status").agg(F.count("*").alias("lines"))


@query("fold_logs", S.with_(S.EV) + """
SELECT event_id, CASE WHEN n % 4 = 0 THEN 'second ' || message ELSE message END AS message,
       strftime(event_time, '%Y-%m-%d') AS event_date
FROM ev""")
def fold_logs(spark, sf_dir):
    """A fold while a batch is being written: it waits for that batch, which then is not lost."""
    path = work_dir(spark, "fold")
    events = V.log_events(spark, sf_dir).withColumn("message_id", V.message_id())
    sinks.append_logs(events.where("n % 2 = 0"), f"{path}/logs", 0)
    half = sinks.batch_folder(f"{path}/logs", "direct", 1)
    events.where("n % 2 = 1 AND n % 3 = 0").select(*LOGS.fieldNames(), "message_id").write.parquet(half)
    remove(spark, f"{half}/_SUCCESS")
    again = events.where("n % 4 = 0").withColumn("message", F.concat(F.lit("second "), "message"))
    sinks.append_logs(again, f"{path}/logs", 2)
    first = sinks.fold_logs(spark, f"{path}/logs", f"{path}/folded-first")
    sinks.append_logs(events.where("n % 2 = 1"), f"{path}/logs", 1)
    last = sinks.fold_logs(spark, f"{path}/logs", f"{path}/folded")
    folded = spark.read.parquet(f"{path}/folded")
    return folded.where(F.lit((first, last) == ({"direct": 0}, {"direct": 2}))).select(
        "event_id", "message", F.col("event_date").cast("string").alias("event_date"))


# Files of a folder of documents, folders that the driver lists at a time, and the bytes that the id adds to each file: its
# member, padded to one length.
FOLDER_FILES, LISTED_FOLDERS, ID_WIDTH = 1_000, 100, 20
ID_BYTES = len('"event_id":"",') + ID_WIDTH


def _as_files(path, most):
    """Each text of a task as a file, ``most`` in a folder; a rename puts a folder in place when it is whole."""

    def write(batches):
        task = TaskContext.get()
        own, number = f"{path}/_temporary/{task.taskAttemptId()}", task.partitionId()
        texts = (text for batch in batches for text in batch.column(0))
        folders = files = 0
        while (first := next(texts, None)) is not None:
            os.makedirs(own)
            for place, text in enumerate(chain([first], islice(texts, most - 1))):
                with open(f"{own}/part-{place:05d}.txt", "xb") as file:
                    file.write(text.as_buffer())
                    file.write(b"\n")
            files += place + 1
            folder = f"{path}/folder={number}-{folders}"
            folders += 1
            try:
                os.rename(own, folder)
            except OSError:  # a task that ran twice: the same rows are in place
                if not os.path.isdir(folder):
                    raise
                shutil.rmtree(own)
        yield pa.record_batch([pa.array([files], pa.int64())], ["files"])

    return write


def documents_as_files(spark, sf_dir, path):
    """A file per row of ``documents``, with its id in the body, in folders that one task writes and a rename commits.

    On a disk Python writes them: Hadoop starts a ``chmod`` process for each file it makes there. Rows are dealt anew only
    where few tasks would read most of them, as that takes disk for all texts once more.
    """
    docs = V.table(spark, sf_dir, "documents")
    event_id = F.rpad(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), ID_WIDTH, " ")
    bodies = docs.select(F.to_json(F.struct(event_id.alias("event_id"), F.col("text").alias("message"))).alias("value"))
    rows, largest = docs.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    tasks = (rows or 0) // FOLDER_FILES + 1
    disk = on_disk(spark, path)
    if disk is None:
        bodies.repartition(tasks).withColumn("folder", F.spark_partition_id()).write.option(
            "maxRecordsPerFile", 1).partitionBy("folder").text(path)
        return
    os.makedirs(disk)
    if (largest or 0) * min(tasks, spark.sparkContext.defaultParallelism) <= 2 * (rows or 0):
        # A task that runs twice reads its rows in the same order, so its folders are the same ones.
        dealt, most = bodies.coalesce(tasks), FOLDER_FILES
    else:
        # Here in any order, but the same ones: a single folder.
        dealt, most = bodies.repartition(tasks), sys.maxsize
    dealt.mapInArrow(_as_files(disk, most), "files long").write.format("noop").mode("overwrite").save()
    remove(spark, f"{path}/_temporary")
    Path(disk, "_SUCCESS").touch()


@query("scan_json_documents", """
SELECT doc_id, md5(text) AS message_md5, strlen(CAST(to_json(text) AS VARCHAR)) + 12 <= 4096 AS size_ok, 'ok' AS parse_status
FROM documents""")
def scan_documents(spark, sf_dir):
    """Every document as a file of its own; the size is a label and drops none.

    The files are decoded some folders at a time, so that the driver never holds the listing of all of them.
    """
    path = work_dir(spark, "documents")
    documents_as_files(spark, sf_dir, path)
    folders = [f"{path}/folder={name}" for name in folder_names(spark, f"{path}/folder=")]
    for start in range(0, len(folders), LISTED_FOLDERS):
        some = folders[start:start + LISTED_FOLDERS]
        decoded = parse_events(scan_json_documents(spark, some, 4_097 + ID_BYTES).withColumn(
            "raw_event", F.rtrim("raw_event", F.lit("\n"))))
        decoded.select(
            F.col("event_id").try_cast("long").alias("doc_id"), F.md5("message").alias("message_md5"), "size_ok", "parse_status",
        ).coalesce(len(some)).write.mode("append").parquet(f"{path}-decoded")
    fields = "doc_id long, message_md5 string, size_ok boolean, parse_status string"
    return spark.read.schema(fields).parquet(f"{path}-decoded") if folders else spark.createDataFrame([], fields)


@query("ordered_segments", S.with_(S.EV) + f"""
SELECT row_number() OVER (ORDER BY segment) AS place, segment, bytes FROM (
  SELECT {SEGMENT} AS segment, CAST(sum(strlen({PAYLOAD}) + 1) AS BIGINT) AS bytes FROM ev GROUP BY 1)""")
def segments_in_order(spark, sf_dir):
    listed = ordered_segments(spark, spilled(spark, sf_dir))
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long")
    return listed.select(place.alias("place"), "segment", "bytes")


@query("load_api_keys", S.with_(S.KEYS) + """
SELECT key AS api_key FROM valid_keys""")
def stored_keys(spark, sf_dir):
    path = work_dir(spark, "keys")
    V.api_keys(spark, sf_dir).write.parquet(path)
    return auth.valid_keys(load_api_keys(spark, path), as_of())


def landed(spark, sf_dir, path):
    """Land the raw lines and run the ingest job over them."""
    V.raw_lines(spark, sf_dir).write.text(f"{path}/landing")
    jobs.ingest_job(
        spark, f"{path}/landing", f"{path}/buffer", f"{path}/cp-ingest", f"{path}/spill", f"{path}/bad", once=True,
        reports=f"{path}/ingest-reports",
    ).awaitTermination()


@query("ingest_report", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT 'SINKED' AS final_status, 0 AS wal_active, CAST(count(*) FILTER (WHERE parse_status = 'ok') AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE parse_status <> 'ok') AS BIGINT) AS refused
FROM decoded""")
def ingest_report(spark, sf_dir):
    """What the ingest job reported, and the places of the refused lines it kept."""
    path = work_dir(spark, "reported")
    landed(spark, sf_dir, path)
    kept = spark.read.parquet(f"{path}/bad").agg(F.count("*").alias("kept"))
    sums = sinks.batch_report(spark, f"{path}/ingest-reports").groupBy("final_status", "wal_active").agg(
        F.sum("events").alias("accepted"), F.sum("refused").alias("refused"))
    return sums.join(kept, sums["refused"] == kept["kept"]).drop("kept")


@query("quarantined", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT 'event_id is not a uuid' AS reason, count(*) AS entries FROM ev WHERE n % 3 = 0
UNION ALL SELECT 'error_parse', count(*) FROM ev WHERE n % 3 = 1""")
def quarantined(spark, sf_dir):
    """Entries of a buffer that can never be stored, found by the consume job."""
    path = work_dir(spark, "poison")
    events = V.log_events(spark, sf_dir).where("n % 3 <> 1").withColumn(
        "event_id", F.when(F.col("n") % 3 == 0, F.concat("event_id", F.lit("-bad"))).otherwise(F.col("event_id")))
    sinks.append_buffer(events, f"{path}/buffer", 0)
    broken = V.log_events(spark, sf_dir).where("n % 3 = 1").select(
        V.message_id(), F.lit('{"message":').alias("payload"), "received_at")
    sinks.write_once(broken, sinks.batch_folder(f"{path}/buffer", "other", 0))
    jobs.consume_job(
        spark, f"{path}/buffer", f"{path}/logs", f"{path}/dlq", f"{path}/quarantine", f"{path}/reports",
        f"{path}/checkpoint", once=True,
    ).awaitTermination()
    return spark.read.parquet(f"{path}/quarantine").groupBy("reason").agg(F.count("*").alias("entries"))


def consumed(spark, sf_dir, write_fn=None):
    """Ingest and consume jobs over the raw lines; the folder of their tables."""
    path = work_dir(spark, "jobs")
    landed(spark, sf_dir, path)
    jobs.consume_job(
        spark, f"{path}/buffer", f"{path}/logs", f"{path}/dlq", f"{path}/quarantine", f"{path}/reports",
        f"{path}/cp-consume", attempts=2, backoff=0.0, write_fn=write_fn, once=True,
    ).awaitTermination()
    return path


@query("stream_ingest", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT nullif(event_id, '') AS event_id, event_time, source, level, md5(message) AS message_md5,
       redacted AS metadata, hit AS pii_redacted
FROM decoded WHERE parse_status = 'ok'""")
def stream_ingest(spark, sf_dir):
    """Files to buffer to log table, as streams. Ids the engine made up are shown as NULL."""
    logs = sinks.current_logs(spark, f"{consumed(spark, sf_dir)}/logs")
    given = F.when(F.startswith("event_id", F.lit("00000000-0000-4000-8")), F.col("event_id"))
    return logs.select(
        given.alias("event_id"), *V.ntz("event_time"), "source", "level",
        F.md5("message").alias("message_md5"), "metadata", "pii_redacted",
    )


@query("stream_dlq", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT 'batches' AS kind, 'DLQED' AS outcome, 2 AS attempts, count(*) AS events
FROM decoded WHERE parse_status = 'ok'
UNION ALL
SELECT 'dead letters', 'sink failed: ConnectionError: connection refused', 0, count(*) FROM decoded WHERE parse_status = 'ok'""")
def stream_dlq(spark, sf_dir):
    """The sink refuses every batch: reports and dead letters."""
    path = consumed(spark, sf_dir, write_fn=unreachable)
    batches = sinks.batch_report(spark, f"{path}/reports").groupBy(
        F.lit("batches").alias("kind"), F.col("final_status").alias("outcome"), "attempts"
    ).agg(F.sum("events").alias("events"))
    letters = spark.read.parquet(f"{path}/dlq").groupBy(
        F.lit("dead letters").alias("kind"), F.col("reason").alias("outcome"), F.lit(0).alias("attempts")
    ).agg(F.count("*").alias("events"))
    return batches.unionByName(letters)


@query("stream_rate", S.with_(S.EV) + """
SELECT date_trunc('second', received_at) AS window_start, count(*) AS events, CAST(count(*) AS DOUBLE) AS rate
FROM ev GROUP BY 1""")
def stream_rate(spark, sf_dir):
    """Two runs over a buffer whose second batch is older than the first: no event is late."""
    path = work_dir(spark, "rate")
    events = V.log_events(spark, sf_dir)
    middle = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")).cast("timestamp")
    for batch, part in enumerate((F.col("received_at") >= middle, F.col("received_at") < middle)):
        sinks.append_buffer(events.where(part), f"{path}/buffer", batch, "replay" if batch else "ingest", again=bool(batch))
        jobs.rate_job(spark, f"{path}/buffer", f"{path}/rates", f"{path}/checkpoint", once=True).awaitTermination()
    return sinks.read_rates(spark, f"{path}/rates").select(*V.ntz("window_start"), "events", "rate")


@query("two_consumers", S.with_(S.EV) + """
SELECT event_id, message, n % 2 AS half FROM ev""")
def two_consumers(spark, sf_dir):
    """Consumers with checkpoints of their own on one log table: batches of the same numbers, no row lost."""
    path = work_dir(spark, "consumers")
    events = V.log_events(spark, sf_dir)
    for half in (0, 1):
        sinks.append_buffer(events.where(F.col("n") % 2 == half), f"{path}/buffer-{half}", 0)
        jobs.consume_job(
            spark, f"{path}/buffer-{half}", f"{path}/logs", f"{path}/dlq", f"{path}/quarantine", f"{path}/reports",
            f"{path}/cp-{half}", once=True,
        ).awaitTermination()
    stored = sinks.batch_report(spark, f"{path}/reports").where("batch_id = 0 AND final_status = 'SINKED'")
    logs = sinks.current_logs(spark, f"{path}/logs").where(F.lit(stored.count() == 2))
    number = F.substring("event_id", -12, 12).cast("long")
    return logs.select("event_id", "message", (number % 2).alias("half"))


@query("replay_beside_writer", S.with_(S.EV) + """
SELECT event_id, message, CASE WHEN level = 'click' THEN 'second' ELSE 'first' END AS run FROM ev""")
def replay_beside_writer(spark, sf_dir):
    """A segment that is still being written when a replay starts is left alone, and replayed by the next one."""
    path = work_dir(spark, "beside")
    spill, buffer = f"{path}/spill", f"{path}/buffer"
    for batch, level in enumerate(LEVELS):
        sinks.write_spill(V.log_events(spark, sf_dir).where(F.col("level") == level), spill, batch, max_records=1_000)
    open_segment = f"{spill}/{sinks.segment_name(LEVELS.index('click'))}"
    remove(spark, f"{open_segment}/_SUCCESS")
    runs = []
    for name in ("first", "second"):
        jobs.replay_spill(spark, spill, f"{buffer}-{name}", f"{path}/checkpoint", f"{path}/quarantine")
        runs.append(read_buffer(spark, f"{buffer}-{name}").select("event_id", "message", F.lit(name).alias("run")))
        if name == "first":
            sinks.write_spill(V.log_events(spark, sf_dir).where("level = 'click'"), spill, LEVELS.index("click"), max_records=1_000)
    return runs[0].unionByName(runs[1])
