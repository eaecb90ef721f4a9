import pytest
from pyspark.sql import functions as F

from logweir.functions.enrich import enrich
from logweir.functions.scalars import (
    classify_media_type, id_from_rank, id_rank, message_id_text, parse_duration_ms, parse_message_id,
)

MAX = 9_223_372_036_854_775_807


def column(spark, texts, expression):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    return [r[0] for r in df.orderBy("n").select(expression(F.col("t"))).collect()]


def test_durations(spark):
    cases = {
        "30s": 30_000, "1h15m30.5s": 4_530_500, "100ms": 100, "0": 0, "+5s": 5_000, "-1.5h": -5_400_000,
        "1.s": 1_000, ".5s": 500, "1us": 0, "1500µs": 1, "999999ns": 0, "1m1m": 120_000,
        "2562047h47m16.854775807s": 9_223_372_036_854,
        "": None, "5": None, "s": None, ".s": None, "1 s": None, "1d": None, "1h-5m": None, "99999999h": None,
    }
    assert column(spark, list(cases), parse_duration_ms) == list(cases.values())


def test_message_ids(spark):
    cases = {
        "5-7": (5, 7), "5": (5, 0), "-": (0, 0), "+": (MAX, MAX), "a-1": None, "5-": None, "5-x": None, "": None,
    }
    got = column(spark, list(cases), parse_message_id)
    assert [tuple(r) if r else None for r in got] == list(cases.values())


def test_ids_rank_as_numbers(spark):
    ids = [(0, 0), (9, 11), (10, 2), (10, MAX), (MAX, 0), (MAX, MAX)]
    df = spark.createDataFrame([((ms, seq),) for ms, seq in reversed(ids)], "id struct<ms:bigint,seq:bigint>")
    rows = df.orderBy(id_rank(F.col("id"))).select(
        id_from_rank(id_rank(F.col("id"))).alias("id"), message_id_text(F.col("id")).alias("text")
    ).collect()
    assert [tuple(r["id"]) for r in rows] == ids
    assert rows[1]["text"] == "9-11"


def test_media_types(spark):
    cases = {
        "application/json": "json", "application/json; charset=utf-8": "json", "application/x-ndjson": "ndjson",
        "Application/JSON": "error_media_type", "text/plain": "error_media_type", "": "error_media_type",
        None: "error_media_type",
    }
    assert column(spark, list(cases), classify_media_type) == list(cases.values())


def test_enrich(spark):
    events = spark.createDataFrame(
        [("", "f", "a"), (None, "f", "b"), ("given", "f", "c"), ("", "f", "a")],
        "event_id string, file string, message string",
    )
    out = enrich(events).collect()
    assert len({r["event_id"] for r in out}) == 4 and all(r["received_at"] for r in out)
    twice = [
        sorted(r["event_id"] for r in enrich(events, id_mode="deterministic", id_from=("file", "message")).collect())
        for _ in range(2)
    ]
    assert twice[0] == twice[1] and "given" in twice[0]
    with pytest.raises(ValueError):
        enrich(events, id_mode="deterministic")
    with pytest.raises(ValueError):
        enrich(events, id_mode="other")
