import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import metrics

T0 = dt.datetime(2024, 1, 1)


def events(spark, offsets):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in offsets], "received_at timestamp")


def test_rate_and_idle_ticks(spark):
    rates = metrics.ingest_rate(events(spark, [0.0, 0.9, 1.0, 5.5]), dense=True).orderBy("window_start").collect()
    assert [(r["events"], r["rate"]) for r in rates] == [(2, 2.0), (1, 1.0), (0, 0.0), (0, 0.0), (0, 0.0), (1, 1.0)]
    assert [r["window_start"] for r in rates] == [T0 + dt.timedelta(seconds=n) for n in range(6)]
    sparse = metrics.ingest_rate(events(spark, [0.0, 0.9, 5.5]), tick_seconds=2).orderBy("window_start").collect()
    assert [(r["events"], r["rate"]) for r in sparse] == [(2, 1.0), (1, 0.5)]


def test_dense_spans_many_blocks(spark):
    rates = metrics.ingest_rate(events(spark, [0, 10_000]), dense=True)
    assert rates.count() == 10_001 and rates.where("events > 0").count() == 2
    assert rates.select("window_start").distinct().count() == 10_001


def test_dense_counts_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "e")
    events(spark, [0, 3]).write.parquet(path)
    df = metrics.ingest_rate(spark.read.parquet(path), dense=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "ReusedExchange" in final


@pytest.mark.parametrize("chunk", [60, 61, 100, 86_400])
def test_trailing_frames_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(metrics, "CHUNK_TICKS", chunk)
    rng = random.Random(chunk)
    counts = {"a": [rng.randrange(5) for _ in range(260)], "b": [7, 0, 2]}
    rows = [(s, T0 + dt.timedelta(seconds=n), float(c)) for s, cs in counts.items() for n, c in enumerate(cs)]
    rates = spark.createDataFrame(rows, "source string, window_start timestamp, rate double").cache()
    frames = metrics.trailing_rates(rates, by=["source"]).orderBy("source", "window_start").collect()
    bars = metrics.normalize_rates(rates, by=["source"]).orderBy("source", "window_start").collect()
    assert len(frames) == len(rows)
    for row, bar in zip(frames, bars):
        series = counts[row["source"]]
        n = int((row["window_start"] - T0).total_seconds())
        want = ([0.0] * 60 + [float(c) for c in series[: n + 1]])[-60:]
        assert row["points"] == want
        peak = max(max(want), 1.0)
        assert bar["peak"] == peak and bar["height"] == pytest.approx(max(series[n] / peak * 100, 1.0))
    rates.unpersist()


def test_heights_of_a_frame(spark):
    df = spark.createDataFrame([([0.0, 0.5, 4.0],), ([0.0, 0.2],)], "points array<double>")
    got = [r[0] for r in df.select(metrics.frame_heights(F.col("points"))).collect()]
    assert got == [[1.0, 12.5, 100.0], [1.0, 20.0]]


def test_filter_logs(spark):
    logs = spark.createDataFrame(
        [(T0 + dt.timedelta(hours=h), f"s{h % 2}", "info") for h in range(48)],
        "event_time timestamp, source string, level string",
    ).withColumn("event_date", F.to_date("event_time"))
    start, end = F.lit(T0 + dt.timedelta(hours=3)), F.lit(T0 + dt.timedelta(hours=30))
    assert metrics.filter_logs(logs, start, end).count() == 27
    assert metrics.filter_logs(logs, start, end, ["s0"]).count() == 13
    assert metrics.filter_logs(logs, levels=["warn"]).count() == 0
    assert metrics.filter_logs(logs).count() == 48
