"""Structured Streaming jobs made of the batch transforms.

Progress is the query's checkpoint: a micro-batch is committed when its ``foreachBatch`` function
returns, and comes again under the same number when it does not. One folder per origin and batch that is
written once, ids that follow from a line's place, and last-version-wins reads make each event count once.

The numbers belong to a checkpoint, so the origin carries the checkpoint's query id: several consumers, or one that
starts over with a new checkpoint, share tables without taking each other's batches for their own. The jobs read
entries from a Parquet buffer, or from any streaming DataFrame of its columns, such as ``sources.buffer.kafka_entries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from logweir.functions.decode import OK, parse_events
from logweir.functions.enrich import enrich
from logweir.functions.redact import redact
from logweir.functions.scalars import message_id_text
from logweir.operators.quality import invalid_reason
from logweir.schema import EVENT_COLUMNS
from logweir.session import committed, matches, remove
from logweir.sources.buffer import buffer_entries, decode_entries
from logweir.sources.files import ordered_segments, scan_ndjson, with_place
from logweir.streaming import sinks
from logweir.streaming.stateful import dedup_stream

TICK = "1 second"


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    """Start with the one-second tick, or, for ``once``, to work off what is there and end."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TICK)).start()


PLACE = ("file", "block_start", "line_in_block", "raw_event")


def accept(lines: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Ingest path of one line: decode, stamp, redact. Bad lines keep their status.

    Missing ids follow from the line's place, so a line that is read again gets the same one.
    """
    decoded = parse_events(lines)
    return redact(enrich(decoded, id_mode="deterministic", id_from=PLACE), fields)


def ingest_job(
    spark: SparkSession, landing: str, buffer: str, checkpoint: str,
    spill: str, bad_lines: str, fields: list[str] | None = None,
    once: bool = False, max_files: int = 1_000, origin: str = "ingest",
    spill_quota: int | None = None, reports: str | None = None,
) -> StreamingQuery:
    """Landed NDJSON files to the buffer, or to the spill while the buffer is unreachable.

    With ``reports`` each batch reports its accepted and refused lines and whether it was spilled.
    """
    lines = scan_ndjson(spark.readStream.option("maxFilesPerTrigger", max_files), landing)

    def run(batch: DataFrame, batch_id: int) -> None:
        own = sinks.checkpoint_origin(spark, origin)
        report = sinks.report_writer(spark, reports, own) if reports else None
        rows = accept(with_place(batch), fields).persist()
        good = F.col("parse_status") == OK
        tally = sinks.Tally(rows, {"events": F.count_if(good), "refused": F.count_if(~good)}, good)
        try:
            counts = sinks.sink_with_spill(
                lambda events, n: sinks.append_buffer(events, buffer, n, own), spill, report,
                quota=spill_quota, persist=False, origin=own,
            )(tally, batch_id)
            some = None if counts is None else counts["refused"] > 0
            sinks.write_bad_lines(rows.where(~good), bad_lines, batch_id, own, some)
        finally:
            rows.unpersist()

    return _start(lines.writeStream.foreachBatch(run), checkpoint, once)


def judge_entries(entries: DataFrame) -> DataFrame:
    """Decoded buffer entries with ``reason``, why one can never be stored; NULL for those that can."""
    reason = F.when(F.col("parse_status") != OK, F.col("parse_status")).otherwise(
        invalid_reason(check_metadata=False)
    )
    return entries.withColumn("reason", reason)


def split_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded buffer entries as (storable events, entries to quarantine with their reason)."""
    judged = judge_entries(entries)
    return judged.where(F.col("reason").isNull()), judged.where(F.col("reason").isNotNull())


def consume_job(
    spark: SparkSession, buffer: str | DataFrame, logs: str, dlq: str, quarantine: str, reports: str,
    checkpoint: str, attempts: int = 3, backoff: float = 1.0,
    write_fn: sinks.WriteFn | None = None, once: bool = False, max_files: int = 1_000, origin: str = "consume",
    dedup: str | None = None, dedup_time: str | None = None,
    dlq_fn: Callable[[DataFrame, int, str, str], bool | None] | None = None,
) -> StreamingQuery:
    """Buffer to the log table, with retries, the dead-letter table and a report per batch.

    With ``dedup``, a time, events whose id came within it before are left out early (``dedup_stream``). The log table
    folds what passes, so that this only saves work. ``dlq_fn`` takes a batch, its number, the reason and the origin
    in place of the dead-letter table.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        own = sinks.checkpoint_origin(spark, origin)
        sink = sinks.sink_with_retry(
            write_fn or (lambda rows, n: sinks.append_logs(rows, logs, n, own)),
            lambda rows, n, reason: (
                dlq_fn(rows, n, reason, own) if dlq_fn else sinks.write_dlq(rows, dlq, n, reason, own)),
            attempts, backoff, sinks.report_writer(spark, reports, own), persist=False,
        )
        # Decoded again by what reads it twice: kept, a split of compressed files would be one block of many times its
        # size. Behind a state it is kept, in the state's partitions.
        judged = judge_entries(batch)
        if dedup:
            judged = judged.persist()
        good = F.col("reason").isNull()
        try:
            counts = sink(
                sinks.Tally(judged, {"events": F.count_if(good), "bad": F.count_if(~good)}, good), batch_id)
            some = None if counts is None else counts["bad"] > 0
            sinks.write_quarantine(judged.where(~good), quarantine, batch_id, own, some)
        finally:
            if dedup:
                judged.unpersist()

    events = decode_entries(_entries(spark, buffer, max_files))
    if dedup:
        # An entry that did not decode has no id to compare.
        key = F.when(F.col("parse_status") == OK, F.col("event_id"))
        events = dedup_stream(events, F.coalesce(key, message_id_text(F.col("message_id"))), dedup, dedup_time)
    return _start(events.writeStream.foreachBatch(run), checkpoint, once)


def _entries(spark: SparkSession, buffer: str | DataFrame, max_files: int | None = None) -> DataFrame:
    return buffer_entries(spark, buffer, True, max_files) if isinstance(buffer, str) else buffer


def rate_job(
    spark: SparkSession, buffer: str | DataFrame, rates: str, checkpoint: str, once: bool = False, origin: str = "rate"
) -> StreamingQuery:
    """Buffer to a table of events per second: partial counts per batch, summed by ``sinks.read_rates``.

    Nothing is late: a replayed event counts in the second it was received in. Payloads are not read.
    """
    received = _entries(spark, buffer).select("received_at")
    counting = received.writeStream.foreachBatch(
        lambda batch, n: sinks.append_rates(batch, rates, n, sinks.checkpoint_origin(spark, origin)))
    return _start(counting, checkpoint, once)


def replay_spill(
    spark: SparkSession, spill: str, buffer: str, checkpoint: str, quarantine: str, origin: str = "replay",
) -> StreamingQuery | None:
    """Put all spilled events back into the buffer and then delete their segments; None when there are none.

    Runs to its end. Only segments that were written to their end before the start are read, and only they are
    deleted, after all of them are in the buffer; a segment that is finished meanwhile waits for the next run. The
    checkpoint lists the files that are done, so a run that failed goes on where it stopped. Malformed lines go to the
    quarantine table with their place.
    """
    segments = finished_segments(spark, spill)
    if not segments:
        return None
    lines = scan_ndjson(spark.readStream, f"{spill}/{{{','.join(segments)}}}")

    def run(batch: DataFrame, batch_id: int) -> None:
        own = sinks.checkpoint_origin(spark, origin)
        rows = parse_events(with_place(batch)).persist()
        try:
            sinks.write_bad_lines(rows.where(F.col("parse_status") != OK), quarantine, batch_id, own)
            events = rows.where(F.col("parse_status") == OK).select(*EVENT_COLUMNS)
            sinks.append_buffer(events, buffer, batch_id, own, again=True)
        finally:
            rows.unpersist()

    query = _start(lines.writeStream.foreachBatch(run), checkpoint, once=True)
    query.awaitTermination()
    for segment in segments:
        remove(spark, f"{spill}/{segment}")
    return query


def finished_segments(spark: SparkSession, spill: str) -> list[str]:
    """The segments by age, without folders that lack their commit mark; a plain file has none and is whole."""
    return [
        row["segment"] for row in ordered_segments(spark, spill).collect()
        if committed(spark, f"{spill}/{row['segment']}") or not matches(spark, f"{spill}/{row['segment']}/*")]
