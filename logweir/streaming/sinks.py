"""Sinks: buffer, log table, dead-letter and quarantine tables, spill, and the retry rules.

Every batch of every job writes to a folder of its own, named by the job's ``origin`` and the batch's
number. A folder that was written to its end is never written again: a batch that is delivered once more
finds it and leaves it as it is, so neither a repeated batch nor another job can replace rows.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logweir.functions.scalars import message_id_text
from logweir.operators.keyed import first_by_key, latest_by_key
from logweir.schema import LOGS
from logweir.session import committed, committed_numbers, folder_names, folder_numbers
from logweir.sources.files import segment_files

log = logging.getLogger(__name__)

# Tells whether it wrote the rows just now; None where that is not known.
WriteFn = Callable[[DataFrame, int], bool | None]

BUFFER_STREAM = "log_events"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# Error texts and Java classes that mean the sink cannot be reached.
UNAVAILABLE_TEXTS = ("i/o timeout", "connection refused")
UNAVAILABLE_CLASSES = (
    "java.net.ConnectException", "java.net.SocketTimeoutException", "java.net.UnknownHostException",
    "java.net.NoRouteToHostException", "java.nio.channels.ClosedChannelException",
)


def batch_folder(path: str, origin: str, batch_id: int) -> str:
    return f"{path}/origin={origin}/batch_id={batch_id}"


def checkpoint_origin(spark: SparkSession, origin: str) -> str:
    """The origin with the id of the streaming query that runs in this thread, which its checkpoint keeps.

    Two jobs, or one that starts over with a new checkpoint, never take each other's batches for their own.
    """
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{origin}-{query}" if query else origin


def write_once(rows: DataFrame, target: str, **options: str) -> bool:
    """Write the folder unless it was written to its end before; whether it was written now."""
    if committed(rows.sparkSession, target):
        return False
    rows.write.mode("overwrite").options(**options).parquet(target)
    return True


# Bytes of a row group of the buffer. A reader's tasks are made of whole row groups: with Parquet's default of 128 MB
# a micro-batch of a few files would be decoded by one task a file.
ROW_GROUP = 4 << 20


def event_json() -> Column:
    """The event as JSON text. Empty source, level and metadata, and a false flag, are left out."""
    return F.to_json(
        F.struct(
            "event_id",
            "received_at",
            "event_time",
            F.nullif(F.col("source"), F.lit("")).alias("source"),
            F.nullif(F.col("level"), F.lit("")).alias("level"),
            F.coalesce("message", F.lit("")).alias("message"),
            F.parse_json("metadata").alias("metadata"),
            F.when(F.col("pii_redacted"), True).alias("pii_redacted"),
        ),
        {"timestampFormat": TIME_FORMAT},
    )


def append_buffer(events: DataFrame, path: str, batch_id: int, origin: str = "ingest", again: bool = False) -> bool:
    """Append a batch to the buffer, with message ids in the order of its rows.

    Ids carry the receive time; those of events that come ``again``, from a spill, carry the time of this
    append, since they are newer entries than what was buffered meanwhile. ``received_at`` stands beside the
    payload, so that rates need not decode it. Whether it was written now, and not before.
    """
    ms = F.unix_millis(F.current_timestamp()) if again else F.unix_millis("received_at")
    entries = events.select(
        F.struct(ms.alias("ms"), F.monotonically_increasing_id().alias("seq")).alias("message_id"),
        event_json().alias("payload"),
        "received_at",
    )
    return write_once(entries, batch_folder(path, origin, batch_id), **{"parquet.block.size": str(ROW_GROUP)})


def write_dlq(
    events: DataFrame, path: str, batch_id: int, reason: str = "sink failed", origin: str = "consume"
) -> bool:
    return write_once(events.select(
        event_json().alias("payload"),
        F.col("event_id").alias("original_event_id"),
        F.lit(BUFFER_STREAM).alias("original_stream"),
        F.lit(reason).alias("reason"),
    ), batch_folder(path, origin, batch_id))


def write_quarantine(
    rows: DataFrame, path: str, batch_id: int, origin: str = "consume", some: bool | None = None
) -> None:
    """Keep entries that can never be stored: ``message_id, payload, reason``. Without any, nothing is written."""
    kept = rows.select(message_id_text(F.col("message_id")).alias("message_id"), "payload", "reason")
    if not kept.isEmpty() if some is None else some:
        write_once(kept, batch_folder(path, origin, batch_id))


def write_bad_lines(rows: DataFrame, path: str, batch_id: int, origin: str, some: bool | None = None) -> None:
    """Where the refused lines are, and a digest, but not the text: it was never redacted.

    ``some`` tells whether there are any, where the caller knows.
    """
    kept = rows.select(
        "file", "block_start", "line_in_block", "parse_status", F.octet_length("raw_event").alias("bytes"),
        F.sha2("raw_event", 256).alias("sha256"))
    if not kept.isEmpty() if some is None else some:
        write_once(kept, batch_folder(path, origin, batch_id))


class SpillFull(Exception):
    """The spill would exceed its quota."""


def segment_name(batch_id: int, origin: str = "ingest") -> str:
    return f"segment-{origin}-{batch_id:020d}"


def write_spill(
    events: DataFrame, path: str, batch_id: int, max_records: int = 100_000, quota: int | None = None,
    origin: str = "ingest",
) -> bool:
    """Write a batch as a segment of JSON lines in files of at most ``max_records``.

    With ``quota`` the bytes of all segments together, which are those not replayed yet, stay within it, or
    nothing is written. Whether it was written now, and not before.
    """
    target = f"{path}/{segment_name(batch_id, origin)}"
    if committed(events.sparkSession, target):
        return False
    lines = events.select(event_json().alias("value"))
    if quota is not None:
        used = segment_files(events.sparkSession, path).where(
            F.col("segment") != segment_name(batch_id, origin)).agg(F.sum("bytes")).first()[0] or 0
        size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
        if used + size > quota:
            raise SpillFull(f"spill quota exceeded ({used + size} > {quota})")
    lines.write.mode("overwrite").option("maxRecordsPerFile", max_records).text(target)
    return quota is None  # with a quota the first action was not the write


# --- the log table: one folder of versions per origin and batch -------------------------------

# The later write wins. Numbers of batches only compare within an origin, so the time of the write comes first.
VERSION_ORDER = ("stored_at", "batch_id", "message_id.ms", "message_id.seq", "origin")


def append_logs(events: DataFrame, path: str, batch_id: int, origin: str = "direct") -> bool:
    """Upsert a batch into the log table: its rows become the newest version of their ids.

    Whether it was written now; False means that this origin has stored this batch before.
    """
    rows = events.select(*LOGS.fieldNames(), "message_id", F.current_timestamp().alias("stored_at"))
    return write_once(rows, batch_folder(path, origin, batch_id))


def stored_batches(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Per origin the numbers of the batches written to their end, ascending."""
    return {origin: committed_numbers(spark, f"{path}/origin={origin}/batch_id=") for origin in folder_names(spark, f"{path}/origin=")}


def versions(spark: SparkSession, path: str, batches: dict[str, list[int]]) -> DataFrame | None:
    folders = [batch_folder(path, origin, n) for origin, numbers in batches.items() for n in numbers]
    if not folders:
        return None
    rows = spark.read.option("basePath", path).parquet(*folders)
    return rows.withColumns({"origin": F.col("origin").cast("string"), "batch_id": F.col("batch_id").cast("long")})


def current_logs(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each event, with its ``event_date``, over the batches written to their end.

    A batch is reduced to one row per key before the shuffle, so a hot id costs a task one row per file.
    """
    rows = versions(spark, path, stored_batches(spark, path))
    if rows is None:
        return spark.createDataFrame([], LOGS).withColumn("event_date", F.to_date("event_time"))
    return latest_by_key(rows, "event_id", VERSION_ORDER).select(
        *LOGS.fieldNames(), F.to_date("event_time").alias("event_date"))


def closed_batches(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The stored batches of each origin before the first one that is still being written."""
    closed = {}
    for origin, done in stored_batches(spark, path).items():
        being_written = set(folder_numbers(spark, f"{path}/origin={origin}/batch_id=")) - set(done)
        if numbers := [n for n in done if n < min(being_written, default=n + 1)]:
            closed[origin] = numbers
    return closed


def fold_logs(spark: SparkSession, path: str, folded: str) -> dict[str, int]:
    """Write the present state as a table foldered by ``event_date``, for readers that select dates.

    ``folded`` must be a new folder. The last batch of each origin that it holds is returned; batches up to it are not
    needed any more. It is the last one before the first batch still being written, so that none is passed over.
    Files of a date have even sizes.
    """
    closed = closed_batches(spark, path)
    rows = versions(spark, path, closed)
    if rows is None:
        return {}
    latest = latest_by_key(rows, "event_id", VERSION_ORDER).select(
        *LOGS.fieldNames(), F.to_date("event_time").alias("event_date"))
    latest.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(folded)
    return {origin: numbers[-1] for origin, numbers in closed.items()}


# --- batch control ---------------------------------------------------------------------------


@dataclass
class BatchReport:
    """What became of one micro-batch."""

    batch_id: int
    events: int
    final_status: str
    attempts: int
    wal_active: int = 0
    refused: int = 0
    error: str = ""


def describe(error: BaseException | None) -> str:
    """Class and first line of an error, as dead letters and reports keep it."""
    if error is None:
        return ""
    lines = str(error).strip().splitlines()
    return f"{type(error).__name__}: {lines[0][:300]}" if lines else type(error).__name__


def backoff_delay(base: float, attempt: int) -> float:
    """Seconds to wait after the attempt numbered from 0."""
    return base * 2**attempt


class Tally:
    """Rows to write, and counts over them that come with the action that writes them (``observe``), not from a pass.

    ``keep`` selects what is written; the counts are over all ``rows``.
    """

    def __init__(self, rows: DataFrame, counts: dict[str, Column] | None = None, keep: Column | None = None) -> None:
        self.rows, self.keep = rows, keep
        self.counts = counts or {"events": F.count(F.lit(1))}
        self.seen: Observation | None = None

    def frame(self) -> DataFrame:
        """The rows to write, under an observation of its own: an attempt that failed may have counted some of them."""
        self.seen = Observation()
        rows = self.rows.observe(self.seen, *[count.alias(name) for name, count in self.counts.items()])
        return rows if self.keep is None else rows.where(self.keep)

    def is_empty(self) -> bool:
        return (self.rows if self.keep is None else self.rows.where(self.keep)).isEmpty()

    def read(self, written: bool | None) -> dict[str, int]:
        """The counts. Only a write that says it has just run the frame is known to have observed them."""
        if written is True:
            return self.seen.get
        return self.rows.agg(*[count.alias(name) for name, count in self.counts.items()]).first().asDict()


def _tally(batch: DataFrame | Tally) -> Tally:
    return batch if isinstance(batch, Tally) else Tally(batch)


def sink_with_retry(
    write_fn: WriteFn,
    dlq_fn: Callable[[DataFrame, int, str], bool | None],
    attempts: int = 3,
    backoff: float = 1.0,
    report_fn: Callable[[BatchReport], None] | None = None,
    sleep: Callable[[float], None] = time.sleep,
    persist: bool = True,
) -> Callable[[DataFrame | Tally, int], dict[str, int] | None]:
    """A ``foreachBatch`` function that tries ``write_fn``, then hands the batch to ``dlq_fn`` with the reason.

    ``attempts`` counts all tries; waits double, with none after the last. An error of ``dlq_fn``
    is raised, so the batch is not committed and comes again. An empty batch calls nothing.
    ``persist=False`` is for callers that keep the batch themselves. The counts of the batch are returned; they need
    no pass of their own where the write says that it took place.
    """
    if attempts < 1:
        raise ValueError("attempts must be at least 1")

    def run(batch: DataFrame | Tally, batch_id: int) -> dict[str, int] | None:
        # Retries read the rows again; a lost executor's share is recomputed.
        tally = _tally(batch)
        if persist:
            tally.rows = tally.rows.persist()
        try:
            if tally.is_empty():
                return None
            status, used, failure, written = "SINKED", 0, None, None
            for attempt in range(attempts):
                used = attempt + 1
                try:
                    written = write_fn(tally.frame(), batch_id)
                    break
                except Exception as error:
                    failure = error
                    log.warning("batch %s, attempt %s of %s failed: %s", batch_id, used, attempts, describe(error))
                    if used == attempts:
                        written = dlq_fn(tally.frame(), batch_id, f"sink failed: {describe(error)}")
                        status = "DLQED"
                    else:
                        sleep(backoff_delay(backoff, attempt))
            counts = tally.read(written)
            if report_fn:
                report_fn(BatchReport(batch_id, counts["events"], status, used, error=describe(failure)))
            return counts
        finally:
            if persist:
                tally.rows.unpersist()

    return run


def _causes(error: BaseException):
    """Text of the error and of all its causes, in Python and in the JVM."""
    while error is not None:
        yield str(error)
        java = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
        while java is not None and hasattr(java, "getCause"):
            yield java.toString()
            java = java.getCause()
        error = error.__cause__ or error.__context__


def is_unavailable(error: BaseException) -> bool:
    """Whether the error means that the sink cannot be reached, rather than that it refuses."""
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    return any(
        any(name in text for name in UNAVAILABLE_CLASSES) or any(part in text.lower() for part in UNAVAILABLE_TEXTS)
        for text in _causes(error))


def sink_with_spill(
    primary_fn: WriteFn,
    spill_path: str,
    report_fn: Callable[[BatchReport], None] | None = None,
    unavailable: Callable[[BaseException], bool] = is_unavailable,
    max_records: int = 100_000,
    quota: int | None = None,
    persist: bool = True,
    origin: str = "ingest",
) -> Callable[[DataFrame | Tally, int], dict[str, int] | None]:
    """A ``foreachBatch`` function that spills the batch when the primary sink is unreachable.

    All other errors are raised. A batch that was spilled to its end before the job died is in the spill and
    nowhere else, so when it comes again nothing is written. The report's ``wal_active`` tells which way the
    batch went. With a report the counts of the batch are returned.
    """

    def run(batch: DataFrame | Tally, batch_id: int) -> dict[str, int] | None:
        tally = _tally(batch)
        if persist:
            tally.rows = tally.rows.persist()
        try:
            wal_active, failure, written = 0, None, None
            if committed(tally.rows.sparkSession, f"{spill_path}/{segment_name(batch_id, origin)}"):
                wal_active = 1
            else:
                try:
                    written = primary_fn(tally.frame(), batch_id)
                except Exception as error:
                    if not unavailable(error):
                        raise
                    written = write_spill(tally.frame(), spill_path, batch_id, max_records, quota, origin)
                    wal_active, failure = 1, error
            if not report_fn:
                return None
            counts = tally.read(written)
            status = "SPILLED" if wal_active else "SINKED"
            report_fn(BatchReport(
                batch_id, counts["events"], status, 1, wal_active, counts.get("refused", 0), describe(failure)))
            return counts
        finally:
            if persist:
                tally.rows.unpersist()

    return run


# --- reports ---------------------------------------------------------------------------------

REPORTS = ("origin string, batch_id bigint, events bigint, refused bigint, final_status string, attempts int, "
           "wal_active int, error string, input_rows bigint, duration_ms bigint")


class Reports(StreamingQueryListener):
    """Reports of many batches, kept until there are ``every`` of them, and written together as one file.

    As a listener it adds what the engine tells about a batch after its end: its input rows and its duration. What is
    kept is lost with the driver; a batch that was not committed is reported again when it comes again.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100) -> None:
        self.spark, self.path, self.every = spark, path, every
        self.kept: dict[tuple[str, int], list] = {}
        self.lock = threading.Lock()

    def add(self, report: BatchReport, origin: str) -> None:
        with self.lock:
            self.kept[origin, report.batch_id] = [
                report.events, report.refused, report.final_status, report.attempts, report.wal_active, report.error, None, None]

    def flush(self) -> None:
        # Held until the rows are written: whoever reads next waits for them, and no two writes meet in the folder.
        with self.lock:
            rows = [(*key, *values) for key, values in self.kept.items()]
            if rows:
                self.spark.createDataFrame(rows, REPORTS).coalesce(1).write.mode("append").parquet(self.path)
            self.kept.clear()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        with self.lock:
            for (origin, batch_id), values in self.kept.items():
                if batch_id == progress.batchId and origin.endswith(str(progress.id)):
                    values[-2:] = progress.numInputRows, progress.batchDuration
            full = len(self.kept) >= self.every
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.flush()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()


_OPEN: dict[str, Reports] = {}


def reports_at(spark: SparkSession, path: str) -> Reports:
    """The collector of this driver for the report table at ``path``."""
    if path not in _OPEN or _OPEN[path].spark is not spark:
        _OPEN[path] = Reports(spark, path)
        spark.streams.addListener(_OPEN[path])
    return _OPEN[path]


def report_writer(spark: SparkSession, path: str, origin: str = "consume") -> Callable[[BatchReport], None]:
    """Keeps one report row per batch for the table at ``path``."""
    return lambda report: reports_at(spark, path).add(report, origin)


def batch_report(spark: SparkSession, path: str) -> DataFrame:
    """Per micro-batch of each job: events, refused lines, final status, attempts, spilled or not, last error, and the
    engine's input rows and duration where they were known when the report was written.

    Of a batch that was reported twice, since it came again, one report stays. What this driver keeps is written first.
    """
    if path in _OPEN:
        _OPEN[path].flush()
        if not spark.streams.active:
            spark.streams.removeListener(_OPEN.pop(path))
    rows = spark.read.schema(REPORTS).parquet(path)
    return first_by_key(
        rows.withColumn("_batch", F.struct("origin", "batch_id")), "_batch", ["duration_ms"]).drop("_batch")


# --- the rate table --------------------------------------------------------------------------


def append_rates(entries: DataFrame, path: str, batch_id: int, origin: str = "rate") -> None:
    """Events of a batch per second of receipt; late events count in their own second."""
    ticks = F.date_trunc("second", "received_at").alias("window_start")
    write_once(entries.groupBy(ticks).agg(F.count("*").alias("events")), batch_folder(path, origin, batch_id))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The series over all batches: ``window_start``, ``events`` and ``rate`` per second."""
    sums = spark.read.parquet(path).groupBy("window_start").agg(F.sum("events").alias("events"))
    return sums.withColumn("rate", F.col("events").cast("double"))
