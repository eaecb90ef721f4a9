"""Counters, rates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.auth import authenticate, ingest_rows

POINTS = 60
QUOTA_BYTES = 1_073_741_824

# Ticks handled by one window partition of a trailing series.
CHUNK_TICKS = 86_400


def count_logs(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("events"))


def filter_logs(
    logs: DataFrame, start: Column | None = None, end: Column | None = None,
    sources: list[str] | None = None, levels: list[str] | None = None,
) -> DataFrame:
    """Rows with ``start <= event_time < end``, of the sources and levels given.

    With an ``event_date`` partition column the time range also selects the folders to read.
    """
    dated = "event_date" in logs.columns
    if start is not None:
        logs = logs.where(F.col("event_time") >= start)
        if dated:
            logs = logs.where(F.col("event_date") >= start.cast("date"))
    if end is not None:
        logs = logs.where(F.col("event_time") < end)
        if dated:
            logs = logs.where(F.col("event_date") <= end.cast("date"))
    if sources is not None:
        logs = logs.where(F.col("source").isin(sources))
    if levels is not None:
        logs = logs.where(F.col("level").isin(levels))
    return logs


def events_by_status(
    requests: DataFrame, api_keys: DataFrame, as_of: Column | None = None, **limits
) -> DataFrame:
    """The ingest counter per status, over the admitted POST requests."""
    return (
        ingest_rows(requests, api_keys, as_of, **limits)
        .where(~F.col("event_status").isin("uncounted", "past_limit"))
        .groupBy(F.col("event_status").alias("status"))
        .agg(F.count("*").alias("events"))
    )


def bytes_total(requests: DataFrame, api_keys: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Body bytes of the admitted POST requests, whatever their size or type."""
    posts = authenticate(requests.where(F.col("method") == "POST"), api_keys, as_of)
    return posts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes"))


def ingest_rate(
    events: DataFrame, tick_seconds: int = 1, by: list[str] | None = None, dense: bool = False
) -> DataFrame:
    """Events per tick of ``received_at``: ``window_start``, ``events`` and ``rate`` per second.

    ``dense`` adds the idle ticks between the first and the last one, with rate 0.0. It is for
    batches; a stream emits the ticks that have events.
    """
    by = by or []
    ticks = F.window("received_at", f"{tick_seconds} seconds")
    counts = events.groupBy(*by, ticks).agg(F.count("*").alias("events")).select(
        *by, F.col("window.start").alias("window_start"), "events"
    )
    if dense:
        counts = _fill_idle(counts, tick_seconds, by)
    return counts.withColumn("rate", F.col("events") / F.lit(float(tick_seconds)))


def _fill_idle(counts: DataFrame, tick_seconds: int, by: list[str]) -> DataFrame:
    """Add the missing ticks. Spans are cut before they are filled, so no row expands to them all."""
    block = 3_600 * tick_seconds
    # Spans come from the counts, a row per busy tick, not from the events.
    # The sum keeps both uses of the counts alike, so that they share one shuffle.
    spans = counts.groupBy(*by).agg(
        F.min(F.unix_seconds("window_start")).alias("first"),
        F.max(F.unix_seconds("window_start")).alias("last"),
        F.sum("events").alias("all_events"),
    ).where(F.col("all_events") > 0)
    blocks = spans.select(
        *by, "last", F.explode(F.sequence("first", "last", F.lit(block).cast("long"))).alias("begin")
    ).repartition(*by, "begin")
    end = F.least(F.col("last"), F.col("begin") + block - tick_seconds)
    seconds = blocks.select(
        *by, F.explode(F.sequence("begin", end, F.lit(tick_seconds).cast("long"))).alias("second")
    )
    zeros = seconds.select(
        *by, F.timestamp_seconds("second").alias("window_start"), F.lit(0).cast("long").alias("events")
    )
    return (
        counts.unionByName(zeros).groupBy(*by, "window_start").agg(F.sum("events").alias("events"))
    )


def _trailing(rates: DataFrame, n: int, tick_seconds: int, by: list[str], value: Column, name: str) -> DataFrame:
    """``value`` over the last ``n`` ticks, in chunks that also get the ``n - 1`` ticks before them.

    A series has one row per tick; a window over all of it would be a single task.
    """
    chunk = max(CHUNK_TICKS, n)
    tick = F.floor(F.unix_seconds("window_start") / tick_seconds).cast("long")
    placed = rates.withColumn("_tick", tick).withColumn("_home", F.floor(F.col("_tick") / chunk))
    later = F.floor((F.col("_tick") + (n - 1)) / chunk)
    spread = placed.withColumn("_chunk", F.explode(F.array_distinct(F.array("_home", later))))
    frame = Window.partitionBy(*by, "_chunk").orderBy("_tick").rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn(name, value.over(frame))
        .where(F.col("_chunk") == F.col("_home"))
        .drop("_tick", "_home", "_chunk")
    )


def trailing_rates(
    rates: DataFrame, n: int = POINTS, tick_seconds: int = 1, by: list[str] | None = None
) -> DataFrame:
    """Add ``points``: the last ``n`` rates at each tick of a dense series, left-padded with 0."""
    out = _trailing(rates, n, tick_seconds, by or [], F.collect_list("rate"), "points")
    pad = F.array_repeat(F.lit(0.0), n - F.size("points"))
    return out.withColumn("points", F.concat(pad, "points"))


def normalize_rates(
    rates: DataFrame, n: int = POINTS, tick_seconds: int = 1, by: list[str] | None = None
) -> DataFrame:
    """Add ``peak``, the largest of the last ``n`` rates but at least 1, and ``height`` in percent."""
    out = _trailing(rates, n, tick_seconds, by or [], F.max("rate"), "peak")
    peak = F.greatest(F.col("peak"), F.lit(1.0))
    return out.withColumn("peak", peak).withColumn(
        "height", F.greatest(F.col("rate") / F.col("peak") * 100, F.lit(1.0))
    )


def frame_heights(points: Column) -> Column:
    """Percent heights of the bars of one ``points`` frame."""
    peak = F.greatest(F.array_max(points), F.lit(1.0))
    return F.transform(points, lambda value: F.greatest(value / peak * 100, F.lit(1.0)))


def replay_report(decoded: DataFrame) -> DataFrame:
    """Replayed events and malformed lines per segment, and in total (``segment`` NULL)."""
    return decoded.rollup("segment").agg(
        F.count_if(F.col("parse_status") == "ok").alias("replayed"),
        F.count_if(F.col("parse_status") != "ok").alias("malformed"),
    )


def segment_usage(files: DataFrame, quota: int = QUOTA_BYTES) -> DataFrame:
    """Segments, their bytes, and whether they are over the quota."""
    total = F.coalesce(F.sum("bytes"), F.lit(0))
    return files.groupBy("segment").agg(F.sum("bytes").alias("bytes")).agg(
        F.count("*").alias("segments"), total.alias("bytes"), (total > quota).alias("over_quota")
    )


def request_summary(outcomes: DataFrame) -> DataFrame:
    """Requests, successes, errors and requests per second between the first and the last one."""
    seconds = (
        F.unix_micros(F.max("request_received_at")) - F.unix_micros(F.min("request_received_at"))
    ) / F.lit(1_000_000.0)
    return outcomes.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == 202).alias("succeeded"),
        F.count_if(F.col("status") != 202).alias("failed"),
        (F.count("*") / F.nullif(seconds, F.lit(0.0))).alias("requests_per_second"),
    )


def access_log(requests: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per method, path and status: requests, and exact percentiles of ``duration_ms``.

    The percentiles come from counts per duration, which combine before the shuffle: what a group
    brings to its task is its distinct millisecond values, not its requests.
    """
    group = ["method", "path", "status"]
    counts = requests.groupBy(*group, "duration_ms").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy("duration_ms")
    placed = counts.withColumn("upto", F.sum("n").over(order)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*group))
    )
    picks = [
        F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p)), F.col("duration_ms")))
        .alias(f"p{round(p * 100)}_ms")
        for p in percentiles
    ]
    return placed.groupBy(*group).agg(F.sum("n").alias("requests"), *picks)
