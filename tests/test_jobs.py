import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from logweir.operators import metrics
from logweir.sources.buffer import kafka_entries, read_buffer
from logweir.streaming import jobs, sinks


class Pipeline:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        (root / "landing").mkdir()

    def path(self, name):
        return str(self.root / name)

    def land(self, name, lines):
        part = self.root / f"{name}.part"
        part.write_text("".join(f"{line}\n" for line in lines))
        part.rename(self.root / "landing" / f"{name}.ndjson")

    def ingest(self):
        jobs.ingest_job(
            self.spark, self.path("landing"), self.path("buffer"), self.path("cp-ingest"),
            self.path("spill"), self.path("bad"), once=True, reports=self.path("ingest-reports"),
        ).awaitTermination()

    def consume(self, **options):
        jobs.consume_job(
            self.spark, self.path("buffer"), self.path("logs"), self.path("dlq"), self.path("quarantine"),
            self.path("reports"), self.path("cp-consume"), backoff=0.0, once=True, **options,
        ).awaitTermination()

    def logs(self):
        return sinks.current_logs(self.spark, self.path("logs"))

    def count(self):
        return metrics.count_logs(self.logs()).first()["events"]


@pytest.fixture
def pipeline(spark, tmp_path):
    return Pipeline(spark, tmp_path)


LINES = [f'{{"event_id": "{uuid.UUID(int=n)}", "message": "integration test event {n}"}}' for n in range(100)]


def test_resending_is_idempotent(pipeline):
    pipeline.land("first", LINES)
    pipeline.ingest()
    pipeline.consume()
    assert pipeline.count() == 100
    pipeline.land("second", LINES)
    pipeline.ingest()
    pipeline.consume()
    assert pipeline.count() == 100
    pipeline.land("third", [LINES[0].replace("event 0", "changed")])
    pipeline.ingest()
    pipeline.consume()
    assert pipeline.count() == 100
    assert pipeline.logs().where("message like '%changed'").count() == 1
    reports = sinks.batch_report(pipeline.spark, pipeline.path("reports")).orderBy("batch_id").collect()
    assert [(r["events"], r["final_status"], r["attempts"]) for r in reports] == [
        (100, "SINKED", 1), (100, "SINKED", 1), (1, "SINKED", 1)
    ]


def test_bad_lines_redaction_and_quarantine(pipeline):
    pipeline.land("mixed", [
        '{"message":"m","metadata":{"email":"x","k":1}}', '{"message":1}', "", "null",
        '{"event_id":"not-a-uuid","message":"q"}',
    ])
    pipeline.ingest()
    pipeline.consume()
    rows = {r["message"]: r for r in pipeline.logs().collect()}
    assert set(rows) == {"m", ""}
    assert rows["m"]["metadata"] == '{"email":"[REDACTED]","k":1}' and rows["m"]["pii_redacted"]
    assert uuid.UUID(rows["m"]["event_id"]) and rows["m"]["received_at"] is not None
    bad = pipeline.spark.read.parquet(pipeline.path("bad")).collect()
    assert [(r["bytes"], r["parse_status"]) for r in bad] == [(13, "error_parse")] and "raw_event" not in bad[0]
    held = pipeline.spark.read.parquet(pipeline.path("quarantine")).collect()
    assert [r["reason"] for r in held] == ["event_id is not a uuid"]


def test_one_id_twice_in_a_batch_keeps_the_last(pipeline):
    same = str(uuid.UUID(int=5))
    pipeline.land("twice", [f'{{"event_id":"{same}","message":"v{n}"}}' for n in range(4)])
    pipeline.ingest()
    pipeline.consume()
    assert [r["message"] for r in pipeline.logs().collect()] == ["v3"]


def test_failing_epoch_comes_again_and_counts_once(pipeline):
    """The sink writes and then fails, with no dead-letter table to take the batch."""
    pipeline.land("first", LINES)
    pipeline.ingest()

    def write_then_fail(batch, batch_id):
        sinks.append_logs(batch, pipeline.path("logs"), batch_id)
        raise RuntimeError("lost after the write")

    (pipeline.root / "dlq").write_text("a file in the way of the dead-letter folder")
    with pytest.raises(StreamingQueryException):
        pipeline.consume(write_fn=write_then_fail, attempts=1)
    pipeline.consume()
    assert pipeline.count() == 100


def test_dead_letters(pipeline):
    pipeline.land("first", LINES[:10])
    pipeline.ingest()

    def refuse(batch, batch_id):
        raise RuntimeError("no")

    pipeline.consume(write_fn=refuse, attempts=2)
    assert pipeline.count() == 0
    letters = pipeline.spark.read.parquet(pipeline.path("dlq"))
    assert letters.count() == 10 and letters.select("original_event_id").distinct().count() == 10
    report = sinks.batch_report(pipeline.spark, pipeline.path("reports")).first()
    assert (report["final_status"], report["attempts"]) == ("DLQED", 2)


def test_unreachable_buffer_spills_and_replays(pipeline, monkeypatch):
    pipeline.land("first", LINES[:10])
    with monkeypatch.context() as patch:
        def gone(*args, **kwargs):
            raise ConnectionError("connection refused")

        patch.setattr(sinks, "append_buffer", gone)
        pipeline.ingest()
    pipeline.land("second", LINES[10:20])
    pipeline.ingest()
    pipeline.consume()
    assert pipeline.count() == 10
    jobs.replay_spill(
        pipeline.spark, pipeline.path("spill"), pipeline.path("buffer"), pipeline.path("cp-replay"), pipeline.path("bad"))
    reports = sinks.batch_report(pipeline.spark, pipeline.path("ingest-reports")).orderBy("batch_id").collect()
    assert [(r["events"], r["final_status"], r["wal_active"]) for r in reports] == [(10, "SPILLED", 1), (10, "SINKED", 0)]
    assert reports[0]["error"] == "ConnectionError: connection refused"
    pipeline.consume()
    assert pipeline.count() == 20


def test_rate_stream(spark, tmp_path):
    rows = spark.range(400).select(
        F.expr("uuid()").alias("event_id"), F.timestamp_seconds(F.col("id") / 4 + 1_704_067_200).alias("received_at"),
        F.lit(None).cast("timestamp").alias("event_time"), F.lit("").alias("source"), F.lit("").alias("level"),
        F.lit("m").alias("message"), F.lit(None).cast("string").alias("metadata"), F.lit(False).alias("pii_redacted"),
    )
    buffer, rates, check = (str(tmp_path / n) for n in ("buffer", "rates", "check"))
    sinks.append_buffer(rows.where("id >= 200"), buffer, 0)
    jobs.rate_job(spark, buffer, rates, check, once=True).awaitTermination()
    sinks.append_buffer(rows.where("id < 200"), buffer, 0, "replay", again=True)
    jobs.rate_job(spark, buffer, rates, check, once=True).awaitTermination()
    got = sinks.read_rates(spark, rates).collect()
    assert len(got) == 100 and all((r["events"], r["rate"]) == (4, 4.0) for r in got)
    assert read_buffer(spark, buffer).count() == 400


def test_jobs_take_any_stream_of_entries(spark, pipeline):
    """Records shaped like those of a topic, as a stream."""
    schema = "partition int, offset long, timestamp timestamp, value binary"
    rows = spark.createDataFrame([(LINES[n].encode(), n) for n in range(5)], "value binary, offset long")
    rows.select(F.lit(0).alias("partition"), "offset", F.timestamp_seconds(F.lit(1_704_067_200)).alias("timestamp"), "value").write.parquet(
        pipeline.path("topic"))
    entries = kafka_entries(spark.readStream.schema(schema).parquet(pipeline.path("topic")))
    jobs.consume_job(
        spark, entries.withColumn("payload", F.regexp_replace("payload", "^[{]", '{"received_at":"2024-01-01T00:00:00Z",')),
        pipeline.path("logs"), pipeline.path("dlq"), pipeline.path("quarantine"), pipeline.path("reports"),
        pipeline.path("cp-consume"), once=True,
    ).awaitTermination()
    assert pipeline.count() == 5


def test_consumers_share_a_log_table(pipeline):
    """Another consumer of the same origin, with a checkpoint of its own, starts at batch 0 again."""
    for turn, part in enumerate((LINES[:60], LINES[60:])):
        pipeline.land(f"part-{turn}", part)
        pipeline.ingest()
        jobs.consume_job(
            pipeline.spark, pipeline.path("buffer"), pipeline.path("logs"), pipeline.path("dlq"), pipeline.path("quarantine"),
            pipeline.path("reports"), pipeline.path(f"cp-consume-{turn}"), once=True,
        ).awaitTermination()
    assert pipeline.count() == 100
    assert len(sinks.stored_batches(pipeline.spark, pipeline.path("logs"))) == 2


def test_ingest_with_a_new_checkpoint_keeps_what_is_buffered(pipeline):
    pipeline.land("first", LINES[:10])
    pipeline.ingest()
    (pipeline.root / "cp-ingest").rename(pipeline.root / "cp-lost")
    pipeline.land("second", LINES[10:30])
    pipeline.ingest()
    pipeline.consume()
    assert pipeline.count() == 30


def test_the_later_write_wins_across_consumers(pipeline):
    """A consumer far ahead in batch numbers does not outrank one that has just begun."""
    changed = [line.replace("integration", "changed") for line in LINES[:5]]
    for turn, part in enumerate((LINES[:5], LINES[:5], LINES[:5])):
        pipeline.land(f"part-{turn}", part)
        pipeline.ingest()
        pipeline.consume()
    pipeline.land("changed", changed)
    pipeline.ingest()
    jobs.consume_job(
        pipeline.spark, pipeline.path("buffer"), pipeline.path("logs"), pipeline.path("dlq"), pipeline.path("quarantine"),
        pipeline.path("reports"), pipeline.path("cp-new"), once=True, max_files=100,
    ).awaitTermination()
    assert {r["message"].split()[0] for r in pipeline.logs().collect()} == {"changed"}


def test_segment_finished_during_a_replay_is_kept(pipeline, monkeypatch):
    """The writer of the second segment ends while the first one is being replayed."""
    spark, spill = pipeline.spark, pipeline.path("spill")
    for number, lines in enumerate((LINES[:2], LINES[2:5])):
        folder = pipeline.root / "spill" / f"segment-ingest-{number:020d}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text("".join(f"{line}\n" for line in lines))
    (pipeline.root / "spill" / f"segment-ingest-{0:020d}" / "_SUCCESS").touch()
    append = sinks.append_buffer

    def finish_other(*args, **kwargs):
        (folder / "part-1.txt").write_text(f"{LINES[5]}\n")
        (folder / "_SUCCESS").touch()
        append(*args, **kwargs)

    monkeypatch.setattr(sinks, "append_buffer", finish_other)
    replay = lambda: jobs.replay_spill(spark, spill, pipeline.path("buffer"), pipeline.path("cp-replay"), pipeline.path("bad"))
    replay()
    assert folder.exists() and read_buffer(spark, pipeline.path("buffer")).count() == 2
    replay()
    messages = sorted(r["message"] for r in read_buffer(spark, pipeline.path("buffer")).collect())
    assert messages == sorted(f"integration test event {n}" for n in range(6)) and replay() is None


def test_a_consumed_batch_is_not_kept_in_memory(pipeline):
    """Tasks stream through the batch, whatever it expands to; retries and the quarantine read it again and lose nothing."""
    spark = pipeline.spark
    pipeline.land("first", LINES[:20] + ['{"event_id": "no id", "message": "bad"}'])
    pipeline.ingest()
    kept = []

    def write(rows, n):
        kept.append(rows.count() and spark.sparkContext._jsc.getPersistentRDDs().size())
        if len(kept) == 1:
            raise RuntimeError("after reading")
        return sinks.append_logs(rows, pipeline.path("logs"), n, "consume")

    spark.catalog.clearCache()
    pipeline.consume(write_fn=write)
    assert kept == [0, 0] and pipeline.count() == 20
    assert [r["reason"] for r in spark.read.parquet(pipeline.path("quarantine")).collect()] == ["event_id is not a uuid"]
    report = sinks.batch_report(spark, pipeline.path("reports")).first()
    assert (report["events"], report["attempts"], report["final_status"]) == (20, 2, "SINKED")
