import datetime as dt
import hashlib
import json
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logweir.functions.decode import parse_events
from logweir.operators import metrics
from logweir.plans import stores
from logweir.plans.registry import QUERIES
from logweir.schema import LOG_EVENT
from logweir.session import committed
from logweir.sources.buffer import decode_entries, kafka_entries, read_buffer
from logweir.sources.files import (
    ordered_segments, scan_json_documents, scan_ndjson, scan_segments, segment_files,
)
from logweir.streaming import jobs, sinks

T0 = dt.datetime(2024, 1, 1, 0, 0, 0, 5)


def make_events(spark, *messages, start=0):
    rows = [
        (str(uuid.UUID(int=start + n)), T0, None if n % 2 else T0, "" if n % 2 else "src", "", m, None, False)
        for n, m in enumerate(messages)
    ]
    return spark.createDataFrame(rows, LOG_EVENT)


@pytest.fixture
def two(spark):
    return make_events(spark, "event 1", "event 2")


class Sink:
    """Fails the first ``failures`` writes; keeps the messages of the others."""

    def __init__(self, failures=0, error=RuntimeError("refused")):
        self.failures, self.error, self.calls, self.kept = failures, error, 0, []

    def __call__(self, batch, batch_id, reason=None):
        self.calls += 1
        self.reason = reason
        if self.calls <= self.failures:
            raise self.error
        self.kept += sorted(r["message"] for r in batch.collect())


def run(batch, sink, dlq, **options):
    reports, waits = [], []
    sinks.sink_with_retry(sink, dlq, report_fn=reports.append, sleep=waits.append, **options)(batch, 7)
    return reports, waits


def test_retry(spark, two):
    sink, dlq = Sink(), Sink()
    reports, waits = run(two, sink, dlq)
    assert sink.kept == ["event 1", "event 2"] and not dlq.kept and not waits
    assert (reports[0].events, reports[0].final_status, reports[0].attempts) == (2, "SINKED", 1)

    sink, dlq = Sink(2), Sink()
    reports, waits = run(two, sink, dlq, attempts=3, backoff=1.0)
    assert sink.kept == ["event 1", "event 2"] and waits == [1.0, 2.0]
    assert (reports[0].final_status, reports[0].attempts) == ("SINKED", 3)

    sink, dlq = Sink(9), Sink()
    reports, waits = run(two, sink, dlq, attempts=2)
    assert dlq.kept == ["event 1", "event 2"] and sink.calls == 2 and waits == [1.0]
    assert dlq.reason == "sink failed: RuntimeError: refused" and reports[0].error == "RuntimeError: refused"
    assert (reports[0].final_status, reports[0].events) == ("DLQED", 2)

    with pytest.raises(RuntimeError):
        run(two, Sink(9), Sink(9), attempts=1)
    sink = Sink()
    assert run(two.limit(0), sink, Sink()) == ([], []) and sink.calls == 0
    with pytest.raises(ValueError):
        sinks.sink_with_retry(Sink(), Sink(), attempts=0)


def test_payload_leaves_out_blanks(spark, two):
    rows = [json.loads(r[0]) for r in two.select(sinks.event_json()).collect()]
    assert rows[0] == {
        "event_id": str(uuid.UUID(int=0)), "received_at": "2024-01-01T00:00:00.000005Z",
        "event_time": "2024-01-01T00:00:00.000005Z", "source": "src", "message": "event 1",
    }
    assert set(rows[1]) == {"event_id", "received_at", "message"}
    full = two.limit(1).withColumns({
        "metadata": F.lit('{"a": null, "b": [1]}'), "pii_redacted": F.lit(True), "level": F.lit("x"),
    })
    row = json.loads(full.select(sinks.event_json()).first()[0])
    assert row["metadata"] == {"a": None, "b": [1]} and row["pii_redacted"] is True and row["level"] == "x"


def test_buffer_round_trip_and_first_write_stays(spark, two, tmp_path):
    path = str(tmp_path / "buffer")
    sinks.append_buffer(two, path, 0)
    sinks.append_buffer(make_events(spark, "other"), path, 0)
    sinks.append_buffer(make_events(spark, "later", start=9), path, 1)
    rows = read_buffer(spark, path).collect()
    assert sorted(r["message"] for r in rows) == ["event 1", "event 2", "later"]
    assert len({tuple(r["message_id"]) for r in rows if r["message"] != "later"}) == 2
    assert committed(spark, f"{path}/origin=ingest/batch_id=0")


def test_buffer_entries_that_do_not_decode(spark, tmp_path):
    rows = [((1, 0), None), ((2, 0), "{"), ((3, 0), '{"message":"m"}')]
    rows = [(*row, T0) for row in rows]
    spark.createDataFrame(rows, "message_id struct<ms:bigint,seq:bigint>, payload string, received_at timestamp").write.parquet(
        str(tmp_path / "b")
    )
    good, bad = jobs.split_entries(read_buffer(spark, str(tmp_path / "b")))
    assert good.count() == 0
    assert {tuple(r["message_id"]): r["reason"] for r in bad.collect()} == {
        (1, 0): "error_parse", (2, 0): "error_parse", (3, 0): "event_id is not a uuid",
    }


def test_kafka_records(spark):
    record = [(1, 7, dt.datetime(2024, 1, 1), bytearray(b'{"message":"m"}'))]
    records = spark.createDataFrame(record, "partition int, offset long, timestamp timestamp, value binary")
    row = decode_entries(kafka_entries(records)).first()
    assert row["message"] == "m" and tuple(row["message_id"]) == (1_704_067_200_000, 2**48 + 7)


def test_dlq(spark, two, tmp_path):
    sinks.write_dlq(two, str(tmp_path / "dlq"), 3)
    sinks.write_dlq(two, str(tmp_path / "dlq"), 3)
    rows = spark.read.parquet(str(tmp_path / "dlq")).collect()
    assert len(rows) == 2 and {r["original_stream"] for r in rows} == {"log_events"}
    sinks.write_dlq(two, str(tmp_path / "dlq"), 3, origin="other")
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == 4
    assert all(json.loads(r["payload"])["event_id"] == r["original_event_id"] for r in rows)


def test_spill_segments(spark, tmp_path):
    path = str(tmp_path / "spill")
    assert scan_segments(spark, path).count() == 0 and segment_files(spark, path).count() == 0
    events = make_events(spark, *[f"m{n}" for n in range(5)]).coalesce(1)
    sinks.write_spill(events, path, 1, max_records=2)
    assert segment_files(spark, path).count() == 3
    (tmp_path / "spill" / "segment-9.log").write_bytes(b'{"message":"z"}\r\nbroken\n')
    (tmp_path / "spill" / "unrelated.log").write_text('{"message":"no"}\n')
    lines = parse_events(scan_segments(spark, path))
    order = ["segment", "file", "block_start", "line_in_block"]
    assert [r["message"] for r in lines.orderBy(*order).where("parse_status = 'ok'").collect()] == [
        "z", "m0", "m1", "m2", "m3", "m4"
    ]
    report = {r["segment"]: (r["replayed"], r["malformed"]) for r in metrics.replay_report(lines).collect()}
    assert report == {"segment-ingest-00000000000000000001": (5, 0), "segment-9.log": (1, 1), None: (6, 1)}
    size = sum(f.stat().st_size for f in (tmp_path / "spill").rglob("*") if f.suffix in (".txt", ".log") and "segment" in str(f.relative_to(tmp_path)))
    usage = metrics.segment_usage(segment_files(spark, path), size - 1).first()
    assert tuple(usage) == (2, size, True)
    assert metrics.segment_usage(segment_files(spark, path), size).first()["over_quota"] is False
    assert [r["segment"] for r in ordered_segments(spark, path).collect()] == [
        "segment-9.log", "segment-ingest-00000000000000000001"
    ]


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.ndjson").write_bytes(b'{"message":"a"}\r\n\n\r\n{"message":"b\\r"}\r\r\n \nx\ry')
    rows = [r["raw_event"] for r in scan_ndjson(spark.read, str(tmp_path / "a.ndjson")).collect()]
    assert rows == ['{"message":"a"}', '{"message":"b\\r"}\r', " ", "x\ry"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('{\n"message":\n"whole"}\n')
    (tmp_path / "d" / "two.json").write_text('{"message":"a"}\n{"message":"b"}')
    docs = parse_events(scan_json_documents(spark, str(tmp_path / "d"))).collect()
    assert {(r["parse_status"], r["message"]) for r in docs} == {("ok", "whole"), ("error_parse", None)}
    sized = scan_json_documents(spark, str(tmp_path / "d"), max_bytes=25).collect()
    assert sorted((r["bytes"], r["size_ok"]) for r in sized) == [(22, True), (31, False)]


def test_unreachable_sinks_spill_and_others_raise(spark, two, tmp_path):
    path, reports = str(tmp_path / "spill"), []
    sink = Sink(1, ConnectionError("gone"))
    write = sinks.sink_with_spill(sink, path, reports.append)
    write(two, 0)
    write(make_events(spark, "event 3", start=5), 1)
    assert sink.kept == ["event 3"] and [r.wal_active for r in reports] == [1, 0]
    assert scan_segments(spark, path).count() == 2
    with pytest.raises(RuntimeError):
        sinks.sink_with_spill(Sink(9), path)(two, 2)
    assert sinks.is_unavailable(RuntimeError("dial tcp: Connection refused"))
    assert sinks.is_unavailable(TimeoutError()) and not sinks.is_unavailable(ValueError("bad row"))
    for name in ("net.SocketTimeoutException: Read timed out", "net.ConnectException", "net.UnknownHostException: h",
                 "net.NoRouteToHostException", "nio.channels.ClosedChannelException"):
        assert sinks.is_unavailable(RuntimeError(f"Job aborted.\nCaused by: java.{name}"))
    try:
        try:
            raise RuntimeError("java.net.ConnectException: gone")
        except RuntimeError as inner:
            raise ValueError("write failed") from inner
    except ValueError as error:
        assert sinks.is_unavailable(error)
    assert not sinks.is_unavailable(RuntimeError("java.lang.IllegalArgumentException: bad row"))


def test_jvm_causes_are_walked():
    class Java:
        def __init__(self, text, cause=None):
            self.text, self.cause = text, cause

        def toString(self):  # noqa: N802
            return self.text

        def getCause(self):  # noqa: N802
            return self.cause

    error = RuntimeError("An error occurred while calling o1.parquet")
    error.java_exception = Java("SparkException: Job aborted", Java("java.net.SocketTimeoutException: Read timed out"))
    assert sinks.is_unavailable(error)


def test_spilled_epoch_that_comes_again_is_not_buffered_too(spark, two, tmp_path):
    path, buffer = str(tmp_path / "spill"), str(tmp_path / "buffer")
    sinks.sink_with_spill(Sink(1, ConnectionError("gone")), path)(two, 4)
    sinks.sink_with_spill(lambda batch, n: sinks.append_buffer(batch, buffer, n), path)(two, 4)
    assert not committed(spark, f"{buffer}/origin=ingest/batch_id=4") and scan_segments(spark, path).count() == 2


def test_origins_do_not_share_segments(spark, two, tmp_path):
    path = str(tmp_path / "spill")
    sinks.write_spill(two, path, 0, origin="east")
    sinks.write_spill(make_events(spark, "other", start=9), path, 0, origin="west")
    sinks.write_spill(make_events(spark, "again", start=9), path, 0, origin="west")
    lines = parse_events(scan_segments(spark, path))
    assert sorted(r["message"] for r in lines.collect()) == ["event 1", "event 2", "other"]


def test_spill_quota(spark, two, tmp_path):
    path = str(tmp_path / "spill")
    size = sum(len(r[0]) + 1 for r in two.select(sinks.event_json()).collect())
    sinks.write_spill(two, path, 0, quota=size)
    sinks.write_spill(two, path, 0, quota=size)
    with pytest.raises(sinks.SpillFull):
        sinks.write_spill(two, path, 1, quota=2 * size - 1)
    assert scan_segments(spark, path).count() == 2
    sinks.write_spill(two, path, 1, quota=2 * size)
    with pytest.raises(sinks.SpillFull):
        sinks.sink_with_spill(Sink(1, ConnectionError()), path, quota=2 * size)(two, 2)


def test_replay_removes_what_is_in_the_buffer(spark, two, tmp_path):
    spill, buffer, check, bad = (str(tmp_path / n) for n in ("spill", "buffer", "check", "bad"))
    assert jobs.replay_spill(spark, spill, buffer, check, bad) is None
    size = sum(len(r[0]) + 1 for r in two.select(sinks.event_json()).collect())
    sinks.write_spill(two, spill, 0, quota=size)
    (tmp_path / "spill" / "segment-9.log").write_text('broken\n{"message":"from a file"}\n')
    unfinished = tmp_path / "spill" / "segment-open"
    unfinished.mkdir()
    (unfinished / "part-0.txt").write_text('{"message":"still written"}\n')
    jobs.replay_spill(spark, spill, buffer, check, bad)
    assert sorted(r["message"] for r in read_buffer(spark, buffer).collect()) == [
        "event 1", "event 2", "from a file"]
    assert [r["segment"] for r in ordered_segments(spark, spill).collect()] == ["segment-open"]
    held = spark.read.parquet(bad).first()
    assert held["file"].endswith("segment-9.log") and held["bytes"] == 6 and held["parse_status"] == "error_parse"
    # Replayed segments no longer count against the quota, and a second replay adds nothing.
    sinks.write_spill(make_events(spark, "event 3", start=5), spill, 1, quota=size)
    jobs.replay_spill(spark, spill, buffer, check, bad)
    assert read_buffer(spark, buffer).count() == 4


def test_replayed_entries_are_newer_than_buffered_ones(spark, two, tmp_path):
    buffer = str(tmp_path / "buffer")
    sinks.append_buffer(two, buffer, 0)
    sinks.append_buffer(two, buffer, 0, "replay", again=True)
    by = {}
    for row in read_buffer(spark, buffer).collect():
        by.setdefault(row["event_id"], []).append((row["message_id"]["ms"], row["received_at"]))
    assert all(len({ms for ms, _ in rows}) == 2 and len({at for _, at in rows}) == 1 for rows in by.values())


def log_batch(events, seq=0):
    return events.withColumn("message_id", F.struct(F.lit(1).cast("long").alias("ms"), F.lit(seq).cast("long").alias("seq")))


def test_log_table_versions(spark, tmp_path):
    path = str(tmp_path / "logs")

    def messages():
        return sorted(r["message"] for r in sinks.current_logs(spark, path).collect())

    assert messages() == [] and sinks.fold_logs(spark, path, str(tmp_path / "none")) == {}
    sinks.append_logs(log_batch(make_events(spark, "a", "b", "c")), path, 0)
    sinks.append_logs(log_batch(make_events(spark, "a2")), path, 1)
    assert messages() == ["a2", "b", "c"]
    # A batch that comes again is left as it is.
    sinks.append_logs(log_batch(make_events(spark, "a3", "b3")), path, 1)
    assert messages() == ["a2", "b", "c"]
    # A batch half written is neither read nor passed over by a fold.
    log_batch(make_events(spark, "half", start=80)).write.parquet(f"{path}/origin=direct/batch_id=2")
    (tmp_path / "logs" / "origin=direct" / "batch_id=2" / "_SUCCESS").unlink()
    sinks.append_logs(log_batch(make_events(spark, "d", start=50)), path, 3)
    assert messages() == ["a2", "b", "c", "d"]
    assert sinks.fold_logs(spark, path, str(tmp_path / "folded")) == {"direct": 1}
    sinks.append_logs(log_batch(make_events(spark, "whole", "batch", start=80)), path, 2)
    assert messages() == ["a2", "b", "batch", "c", "d", "whole"]
    assert sinks.fold_logs(spark, path, str(tmp_path / "all")) == {"direct": 3}
    assert sorted(r["message"] for r in spark.read.parquet(str(tmp_path / "all")).collect()) == messages()
    assert metrics.count_logs(sinks.current_logs(spark, path)).first()["events"] == 6


def test_date_filter_selects_folders_of_a_fold(spark, tmp_path):
    path = str(tmp_path / "logs")
    sinks.append_logs(log_batch(make_events(spark, "a", "b")), path, 0)
    sinks.fold_logs(spark, path, str(tmp_path / "folded"))
    day = F.lit(dt.datetime(2024, 1, 1))
    df = metrics.filter_logs(spark.read.parquet(str(tmp_path / "folded")), day, day + F.expr("interval 1 day"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [isnotnull(event_date" in line for line in plan.splitlines() if "FileScan" in line)
    assert [r["message"] for r in df.collect()] == ["a"]


def test_a_file_of_the_buffer_splits_into_tasks(spark, tmp_path):
    """A micro-batch of few files is decoded by more tasks than files: a file has several row groups."""
    n = F.col("id")
    events = spark.range(60_000).coalesce(1).select(
        F.concat(F.lit("e"), n).alias("event_id"), F.timestamp_seconds(n).alias("received_at"), F.timestamp_seconds(n).alias("event_time"),
        F.lit("s").alias("source"), F.lit("l").alias("level"), F.sha2(n.cast("string"), 512).alias("message"),
        F.lit("{}").alias("metadata"), F.lit(False).alias("pii_redacted"))
    sinks.append_buffer(events, str(tmp_path / "buffer"), 0)
    (file,) = (tmp_path / "buffer").rglob("*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups > 2


def test_every_document_is_a_file_in_few_folders(spark, tmp_path):
    """A file a row, also of repeated, negative and missing ids, in one folder a thousand and without checksum files."""
    rows = [(n, f"text {n}") for n in range(1_200)] + [(7, "again"), (-5, "x" * 4_071), (-6, "x" * 4_072), (None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    stores.documents_as_files(spark, str(tmp_path), f"{tmp_path}/files")
    folders = [f for f in (tmp_path / "files").iterdir() if f.is_dir()]
    assert len(folders) == 2 and sum(len(list(f.iterdir())) for f in folders) == len(rows)
    found = {(r["doc_id"], r["message_md5"]): r["size_ok"] for r in QUERIES["scan_json_documents"](spark, str(tmp_path)).collect()}
    assert found == {(n, hashlib.md5(text.encode()).hexdigest()): len(text) + 14 <= 4096 for n, text in rows}
