"""Streams with state: dedup, idle redelivery, acknowledgements, and reports that need no pass of their own."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from logweir.streaming import jobs, sinks, stateful

T0 = dt.datetime(2024, 1, 1)
ENTRY = "stream string, grp string, ms long, seq long, kind string, at timestamp, consumer string, delivery_count long"


def entry(seq, kind, minutes, count=1, consumer="c1"):
    return ("s", "g", 5, seq, kind, T0 + dt.timedelta(minutes=minutes), consumer, count)


class Source:
    """A folder that a stream reads; ``run`` works off what is new and gives the rows of that run."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark, root, schema
        (root / "in").mkdir()
        self.runs = 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(str(self.root / "in"))

    def run(self, stream):
        rows = []
        stream.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect())).option(
            "checkpointLocation", str(self.root / "cp")).trigger(availableNow=True).start().awaitTermination()
        return rows


def test_dedup_by_arrival_loses_no_late_row(spark, tmp_path):
    source = Source(spark, tmp_path, "id string, at timestamp")
    source.put([("a", T0), ("a", T0), ("b", None), (None, T0)])
    run = lambda: sorted(str(r["id"]) for r in source.run(stateful.dedup_stream(source.stream(), F.col("id"), "1 hour")))
    assert run() == ["None", "a", "b"]
    source.put([("a", T0 - dt.timedelta(days=900)), ("c", T0 - dt.timedelta(days=900)), ("b", T0)])
    assert run() == ["c"]


def test_dedup_lets_an_id_pass_again_after_its_time(spark, tmp_path):
    source = Source(spark, tmp_path, "id string, at timestamp")
    run = lambda: [r["id"] for r in source.run(stateful.dedup_stream(source.stream(), F.col("id"), "1 second"))]
    source.put([("a", T0)])
    assert run() == ["a"]
    time.sleep(1.5)
    source.put([("z", T0)])
    run()
    source.put([("a", T0)])
    assert run() == ["a"]


def test_consume_job_with_dedup_keeps_bad_entries_apart(spark, tmp_path):
    rows = [((1, n), payload, T0) for n, payload in enumerate([
        "{", "{", '{"event_id":"00000000-0000-0000-0000-000000000001","received_at":"2024-01-01T00:00:00Z","message":"m"}',
        '{"event_id":"00000000-0000-0000-0000-000000000001","received_at":"2024-01-01T00:00:00Z","message":"m"}'])]
    spark.createDataFrame(rows, "message_id struct<ms:bigint,seq:bigint>, payload string, received_at timestamp").write.parquet(
        str(tmp_path / "buffer"))
    at = lambda name: str(tmp_path / name)
    jobs.consume_job(spark, at("buffer"), at("logs"), at("dlq"), at("bad"), at("reports"), at("cp"), once=True,
                     dedup="1 hour").awaitTermination()
    assert spark.read.parquet(at("bad")).count() == 2
    assert sinks.versions(spark, at("logs"), sinks.stored_batches(spark, at("logs"))).count() == 1


def test_redelivery_goes_on_until_the_ack(spark, tmp_path):
    source = Source(spark, tmp_path, ENTRY)
    hour = 3_600_000

    def run():
        found = source.run(stateful.redeliver_idle(source.stream(), "rescue", hour, "0 seconds"))
        return sorted((r["seq"], (r["delivered_at"] - T0).total_seconds() / 60, r["delivery_count"]) for r in found)

    source.put([entry(1, "delivered", 0), entry(2, "delivered", 0), entry(2, "acked", 10), entry(3, "delivered", 50),
                entry(4, "acked", 0), entry(9, "acked", 70)])
    assert run() == [(1, 70.0, 2)]  # 2 is acknowledged, 3 has not waited long enough
    source.put([entry(4, "delivered", 71), entry(9, "acked", 100)])
    assert run() == []
    source.put([entry(3, "acked", 101), entry(9, "acked", 200)])
    assert run() == [(1, 200.0, 3)]  # 4 was acknowledged before its delivery was seen
    source.put([entry(1, "acked", 201), entry(9, "acked", 900)])
    assert run() == []


def test_redelivery_by_the_clock_of_the_job(spark, tmp_path):
    """On ticks, as timers by the clock have no end that a run could reach."""
    source, rows = Source(spark, tmp_path, ENTRY), []
    source.put([entry(1, "delivered", 0), entry(2, "delivered", 0), entry(2, "acked", 0)])
    stream = stateful.redeliver_idle(source.stream(), "rescue", 3_600_000)
    job = stream.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect())).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    for _ in range(150):
        if rows:
            break
        time.sleep(0.2)
    job.stop()
    assert {(r["seq"], r["consumer"], r["delivery_count"]) for r in rows} == {(1, "rescue", 2)}


def test_acks_beyond_their_time_leave_a_delivery_pending(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a").mkdir()
    key = ("s", "g", 5)
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    deliveries = Source(spark, tmp_path / "d", "stream string, grp string, ms long, seq long, consumer string, delivered_at timestamp")
    acks = Source(spark, tmp_path / "a", "stream string, grp string, ms long, seq long, acked_at timestamp")
    deliveries.put([(*key, n, "c", at(n)) for n in range(4)] + [(*key, 99, "tick", at(999))])
    acks.put([(*key, 0, at(5)), (*key, 1, at(500)), (*key, 2, at(0)), (*key, 98, at(999))])
    rows = deliveries.run(stateful.acks_of(deliveries.stream(), acks.stream(), "60 MINUTES"))
    assert {r["seq"]: r["acked_at"] for r in rows if r["seq"] < 90} == {0: at(5), 1: None, 2: None, 3: None}


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.range(100)
    tally = sinks.Tally(rows, {"events": F.count_if(F.col("id") < 70), "refused": F.count_if(F.col("id") >= 70)}, F.col("id") < 70)
    frame = tally.frame()
    assert sinks.write_once(frame, str(tmp_path / "x")) and tally.read(True) == {"events": 70, "refused": 30}
    assert spark.read.parquet(str(tmp_path / "x")).count() == 70
    tally.frame()
    assert not sinks.write_once(frame, str(tmp_path / "x")) and tally.read(False) == {"events": 70, "refused": 30}


def test_reports_are_written_together(spark, tmp_path):
    path = str(tmp_path / "reports")
    collector = sinks.Reports(spark, path, every=3)
    for n in range(5):
        collector.add(sinks.BatchReport(n, 10 * n, "SINKED", 1), "a")
    collector.flush()
    collector.add(sinks.BatchReport(4, 40, "SINKED", 1), "a")  # the batch came again
    collector.flush()
    assert len(list((tmp_path / "reports").glob("part-*"))) == 2
    rows = sinks.batch_report(spark, path).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["events"]) for r in rows] == [(n, 10 * n) for n in range(5)]


def test_reports_tell_input_rows_and_duration(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "x.ndjson").write_text('{"message":"m"}\n{"message":1}\n')
    job = jobs.ingest_job(spark, at("landing"), at("buffer"), at("cp"), at("spill"), at("bad"), reports=at("reports"))
    try:
        for _ in range(100):
            if job.recentProgress and any(p.numInputRows for p in job.recentProgress):
                break
            time.sleep(0.2)
        time.sleep(1)
    finally:
        job.stop()
    report = sinks.batch_report(spark, at("reports")).first()
    assert (report["events"], report["refused"], report["input_rows"]) == (1, 1, 2) and report["duration_ms"] > 0


@pytest.mark.parametrize("attempt", range(4))
def test_backoff_doubles(attempt):
    assert sinks.backoff_delay(0.5, attempt) == 0.5 * 2**attempt


def test_messages_of_a_minute_share_rows_of_state(spark, tmp_path):
    """200 messages cost a few rows and timers of state, and each is handed on by its own idle time."""
    source, rows = Source(spark, tmp_path, ENTRY), []
    source.put([entry(n, "delivered", n % 3) for n in range(200)] + [entry(n, "acked", 2) for n in range(0, 200, 4)]
               + [entry(999, "acked", 61)])
    stream = stateful.redeliver_idle(source.stream(), "rescue", 3_600_000, "0 seconds")
    job = stream.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect())).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    # 60 minutes after the minutes 0 and 1; those of minute 2 wait on.
    assert {r["seq"] for r in rows} == {n for n in range(200) if n % 4 and n % 3 < 2}
    assert len(rows) == len({r["seq"] for r in rows}) and {r["delivery_count"] for r in rows} == {2}
    assert max(p.stateOperators[0].numRowsUpdated for p in job.recentProgress) <= 10 * stateful.LANES


def test_a_message_that_is_idle_to_the_millisecond(spark, tmp_path):
    """Handed on, alone in its slice or beside messages that have waited longer."""
    source = Source(spark, tmp_path, ENTRY)
    source.put([entry(1, "delivered", 10), entry(999, "acked", 70)])
    alone = source.run(stateful.redeliver_idle(source.stream(), "rescue", 3_600_000, "0 seconds"))
    (tmp_path / "beside").mkdir()
    source = Source(spark, tmp_path / "beside", ENTRY)
    source.put([entry(n, "delivered", 10 * (n == 1)) for n in range(30)] + [entry(999, "acked", 70)])
    beside = source.run(stateful.redeliver_idle(source.stream(), "rescue", 3_600_000, "0 seconds"))
    assert len(alone) == 1 and len(beside) == 30


@pytest.mark.parametrize("ms, seq", [(None, 1), (1, None), (None, None), (-5, 2), (2**62, 3)])
def test_redelivery_of_odd_ids(spark, tmp_path, ms, seq):
    source = Source(spark, tmp_path, ENTRY)
    source.put([("s", "g", ms, seq, "delivered", T0, "c", 1), entry(999, "acked", 99)])
    rows = source.run(stateful.redeliver_idle(source.stream(), "rescue", 3_600_000, "0 seconds"))
    assert [(r["ms"], r["seq"], r["delivery_count"]) for r in rows] == [(ms, seq, 2)]


def two_sides(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a").mkdir()
    key = "stream string, grp string, ms long, seq long"
    return (Source(spark, tmp_path / "d", f"{key}, consumer string, delivered_at timestamp"),
            Source(spark, tmp_path / "a", f"{key}, acked_at timestamp"))


def test_a_join_keeps_one_store_per_partition_and_reads_no_key_to_count_it(spark, tmp_path):
    deliveries, acks = two_sides(spark, tmp_path)
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    deliveries.put([("s", "g", 5, n, "c", at(n)) for n in range(1000)])
    acks.put([("s", "g", 5, n, at(n + 1)) for n in range(0, 1000, 2)])
    rows = []
    job = stateful.acks_of(deliveries.stream(), acks.stream(), "60 MINUTES").writeStream.foreachBatch(
        lambda batch, n: rows.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start()
    job.awaitTermination()
    state = job.recentProgress[0].stateOperators[0]
    assert state.numStateStoreInstances == state.numShufflePartitions and state.numRowsTotal == 0
    assert state.numRowsUpdated == 1500 and sum(row["acked_at"] is not None for row in rows) == 500


def test_a_join_goes_on_from_a_checkpoint_with_four_stores(spark, tmp_path):
    """What was kept under the old settings meets its acks under the new ones, in this run and in one more."""
    deliveries, acks = two_sides(spark, tmp_path)
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    old = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "true",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
           "spark.sql.streaming.join.stateFormatVersion": "2"}
    found = []

    def run():
        rows = deliveries.run(stateful.acks_of(deliveries.stream(), acks.stream(), "60 MINUTES"))
        found.append(sorted((row["seq"], row["acked_at"]) for row in rows if row["seq"] < 90))

    now = {name: spark.conf.get(name) for name in old}
    try:
        for name, value in old.items():
            spark.conf.set(name, value)
        deliveries.put([("s", "g", 5, n, "c", at(n)) for n in range(4)])
        acks.put([("s", "g", 5, 0, at(5))])
        run()
    finally:
        for name, value in now.items():
            spark.conf.set(name, value)
    acks.put([("s", "g", 5, 1, at(6))])
    run()
    deliveries.put([("s", "g", 5, 99, "tick", at(999))])
    acks.put([("s", "g", 5, 2, at(7)), ("s", "g", 5, 98, at(999))])
    run()
    assert found == [[(0, at(5))], [(1, at(6))], [(2, at(7)), (3, None)]]
