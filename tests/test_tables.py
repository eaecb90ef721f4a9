import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import keyed, quality, queue
from logweir.schema import LOG_BUFFER, LOG_DLQ

T0 = dt.datetime(2024, 1, 1)
VERSION = "event_id string, message string, batch_id long, ms long, seq long"
ORDER = ("batch_id", "ms", "seq")


def state(df):
    return {r["event_id"]: r["message"] for r in df.collect()}


def test_upsert_is_the_last_version_however_batches_are_cut(spark):
    rng = random.Random(7)
    # One id has a third of all versions.
    rows = [
        ("hot" if n % 3 == 0 else f"id{rng.randrange(40)}", f"m{n}", n // 25, n // 4, n) for n in range(300)
    ]
    want = {}
    for row in rows:
        want[row[0]] = row[1]
    empty = spark.createDataFrame([], "event_id string, message string")
    for cuts in ([300], [100, 300], [25, 150, 300]):
        target, start = empty, 0
        for cut in cuts:
            batch = rows[start:cut]
            rng.shuffle(batch)
            target = keyed.upsert(target, spark.createDataFrame(batch, VERSION), order=ORDER)
            start = cut
        again = keyed.upsert(target, spark.createDataFrame(rows[cuts[-1] - 25:], VERSION), order=ORDER)
        assert state(target) == want and state(again) == want
        assert again.count() == len(want)


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("event_id"), F.col("id").alias("seq"))
    plan = keyed.latest_by_key(df, "event_id", ["seq"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_insert_if_absent_keeps_the_first(spark):
    target = spark.createDataFrame([("a", "old")], "id string, message string")
    rows = spark.createDataFrame([("a", "x", 1), ("b", "late", 3), ("b", "early", 2)], "id string, message string, n int")
    out = keyed.insert_if_absent(target, rows, "id", ["n"])
    assert {(r["id"], r["message"]) for r in out.collect()} == {("a", "old"), ("b", "early")}


def queue_rows(spark, *rows):
    full = [
        (i, T0 + dt.timedelta(seconds=s), T0, "src", "info", f"m-{i}", None, group, acked, 0)
        for i, s, group, acked in rows
    ]
    return spark.createDataFrame(full, LOG_BUFFER)


@pytest.fixture(scope="module")
def buffer(spark):
    return queue_rows(
        spark, ("a", 3, None, False), ("b", 1, "g1", False), ("c", 0, "g2", False), ("d", 2, None, True),
        ("e", 1, None, False), ("f", 9, "g1", False),
    )


def test_read_and_claim(spark, buffer):
    batch = queue.read_queue_batch(buffer, "g1", 3)
    assert [r["id"] for r in batch.collect()] == ["b", "e", "a"]
    claimed = queue.claim_queue(buffer, "g1", 3)
    owners = {r["id"]: r["consumer_group"] for r in claimed.collect()}
    assert owners == {"a": "g1", "b": "g1", "c": "g2", "d": None, "e": "g1", "f": "g1"}
    # The group reads its batch again until it acknowledges it; others no longer see it.
    assert [r["id"] for r in queue.read_queue_batch(claimed, "g1", 3).collect()] == ["b", "e", "a"]
    assert [r["id"] for r in queue.read_queue_batch(claimed, "g2", 9).collect()] == ["c"]
    assert claimed.columns == buffer.columns


def test_ack(spark, buffer):
    ids = spark.createDataFrame([("b",), ("b",), ("c",), ("a",), ("zz",)], "id string")
    acked = queue.ack_queue(buffer, ids, "g1")
    assert {r["id"] for r in acked.where("acknowledged").collect()} == {"b", "d"}
    assert acked.count() == 6 and acked.columns == buffer.columns
    none = queue.ack_queue(buffer, ids.limit(0), "g1")
    assert {r["id"] for r in none.where("acknowledged").collect()} == {"d"}


def test_insert_queue(spark, buffer):
    events = spark.createDataFrame(
        [("a", T0, T0, "s", "l", "new", None), ("n", T0, T0, "s", "l", "n1", None),
         ("n", T0 + dt.timedelta(1), T0, "s", "l", "n2", None)],
        "event_id string, received_at timestamp, event_time timestamp, source string, level string, "
        "message string, metadata string",
    )
    rows = {r["id"]: r for r in queue.insert_queue(buffer, events).collect()}
    assert len(rows) == 7 and rows["a"]["message"] == "m-a"
    new = rows["n"]
    assert (new["message"], new["consumer_group"], new["acknowledged"], new["retry_count"]) == ("n1", None, False, 0)


def test_move_to_dlq(spark, buffer):
    dlq = spark.createDataFrame([("a", T0, "earlier", T0, "s", "l", "kept", None)], LOG_DLQ)
    rows = [(key, T0, "s", "l", f"m-{key}", None) for key in ("a", "b", "b", "never queued")]
    events = spark.createDataFrame(rows, "id string, event_time timestamp, source string, level string, message string, metadata string")
    now = dt.datetime(2024, 3, 1)
    letters, rest = keyed.move_to_dlq(buffer, dlq, events, F.lit(now))
    rows = {r["id"]: r for r in letters.collect()}
    assert set(rows) == {"a", "b", "never queued"} and letters.count() == 3
    assert rows["a"]["message"] == "kept" and rows["a"]["reason"] == "earlier"
    assert rows["b"]["reason"] == "manual DLQ move" and rows["b"]["failed_at"] == now
    assert rows["never queued"]["message"] == "m-never queued"
    assert {r["id"] for r in rest.collect()} == {"c", "d", "e", "f"}


UUIDS = [
    ("00000000-0000-4000-8000-000000000001", True), ("{00000000-0000-4000-8000-000000000001}", True),
    ("00000000000040008000000000000001", True), ("0000-0000-0000-4000-8000-0000-0000-0001", True),
    ("ABCDEF00-0000-4000-8000-00000000000F", True), ("x", False), ("", False),
    ("{00000000-0000-4000-8000-000000000001", False), ("00000000-0000-4000-8000-00000000000", False),
]


def test_invalid_rows(spark):
    good = UUIDS[0][0]
    rows = [(i, T0, "s", "l", "m", "{}") for i, _ in UUIDS]
    rows += [(None, T0, "s", "l", "m", None), (good, None, "s", "l", "m", None), (good, T0, None, "l", "m", None)]
    rows += [(good, T0, "s", "l", "m", text) for text in ("{} x", "{}]", "{", "", "1", "null", "[1]")]
    events = spark.createDataFrame(
        [(n, *r) for n, r in enumerate(rows)],
        "n int, event_id string, received_at timestamp, source string, level string, message string, metadata string",
    )
    bad = {r["n"]: r["reason"] for r in quality.invalid_rows(events).collect()}
    want = {n: "event_id is not a uuid" for n, (_, ok) in enumerate(UUIDS) if not ok}
    at = len(UUIDS)
    want |= {at: "event_id is null", at + 1: "received_at is null", at + 2: "source is null"}
    want |= {at + n: "metadata is not json" for n in (3, 4, 5, 6)}
    assert bad == want
    assert quality.valid_rows(events).count() == len(rows) - len(want)


def test_batch_conflicts(spark):
    events = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "batch_id int, event_id string")
    assert [tuple(r) for r in quality.batch_conflicts(events).collect()] == [(1, "a", 2)]
