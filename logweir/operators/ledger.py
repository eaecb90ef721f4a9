"""Delivery state of consumer groups: reports, claim, acknowledge, trim.

``deliveries`` has one row per (stream, grp, message id) with its owner, last delivery and
acknowledgement; ``messages`` has the payload per (stream, message id).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.decode import OK, parse_events
from logweir.functions.scalars import id_from_rank, id_rank, parse_message_id

DEFAULT_COUNT = 100

# Fan-out of one histogram pass of the trim search.
TRIM_BUCKETS = 4_096


def _pending() -> Column:
    return F.col("acked_at").isNull()


def _idle_ms(since: Column, as_of: Column) -> Column:
    return F.unix_millis(as_of) - F.unix_millis(since)


def group_info(deliveries: DataFrame) -> DataFrame:
    """Per group: consumers, pending messages and the last delivered id.

    Aggregated per consumer first, so that counting the consumers needs no distinct over rows.
    """
    per_consumer = deliveries.groupBy("stream", "grp", "consumer").agg(
        F.count_if(_pending()).alias("pending"),
        F.max(id_rank(F.col("message_id"))).alias("last"),
    )
    return (
        per_consumer.groupBy("stream", "grp")
        .agg(
            F.count("consumer").alias("consumers"),
            F.sum("pending").alias("pending"),
            F.max("last").alias("last"),
        )
        .select("stream", "grp", "consumers", "pending", id_from_rank(F.col("last")).alias("last_delivered_id"))
    )


def consumer_info(deliveries: DataFrame, as_of: Column) -> DataFrame:
    """Per consumer: pending messages and milliseconds since its last delivery."""
    return (
        deliveries.groupBy("stream", "grp", "consumer")
        .agg(F.count_if(_pending()).alias("pending"), F.max("delivered_at").alias("last"))
        .select("stream", "grp", "consumer", "pending", _idle_ms(F.col("last"), as_of).alias("idle_ms"))
    )


def pending_by_consumer(deliveries: DataFrame) -> DataFrame:
    """Pending messages per group and consumer; consumers without any are left out."""
    counts = deliveries.groupBy("stream", "grp", "consumer").agg(F.count_if(_pending()).alias("pending"))
    return counts.where("pending > 0")


def pending_summary(deliveries: DataFrame) -> DataFrame:
    """Per group: total pending, first and last pending id, and the number of consumers with any.

    Groups with nothing pending have total 0 and no ids. The counts of the consumers are rows of
    ``pending_by_consumer``; ``pending_totals`` has them as the map of one named group.
    """
    rank = F.when(_pending(), id_rank(F.col("message_id")))
    per_consumer = deliveries.groupBy("stream", "grp", "consumer").agg(
        F.count_if(_pending()).alias("n"), F.min(rank).alias("first"), F.max(rank).alias("last")
    )
    totals = per_consumer.groupBy("stream", "grp").agg(
        F.sum("n").alias("total"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.count_if(F.col("n") > 0).alias("consumers"),
    )
    return totals.select(
        "stream", "grp", "total",
        id_from_rank(F.col("first")).alias("first_message_id"),
        id_from_rank(F.col("last")).alias("last_message_id"),
        "consumers",
    )


def pending_totals(deliveries: DataFrame, stream: str, group: str) -> DataFrame:
    """The one named group's pending counts as a map from consumer to number."""
    own = pending_by_consumer(deliveries.where((F.col("stream") == stream) & (F.col("grp") == group)))
    return own.agg(F.map_from_entries(F.collect_list(F.struct("consumer", "pending"))).alias("consumer_totals"))


def id_at_least(message_id: Column, ms: Column | int, seq: Column | int) -> Column:
    """``message_id >= (ms, seq)``; the plain bound on ``ms`` reaches the scan's statistics."""
    return (message_id["ms"] >= ms) & ((message_id["ms"] > ms) | (message_id["seq"] >= seq))


def parse_start(start: str) -> tuple[int, int]:
    """(ms, seq) of a range start: ``-``, ``ms`` or ``ms-seq``."""
    if start in ("", "-"):
        return 0, 0
    ms, _, seq = start.partition("-")
    return int(ms), int(seq or 0)


def pending_messages(
    deliveries: DataFrame, stream: str, group: str, as_of: Column,
    consumer: str | None = None, start: str = "-", count: int = DEFAULT_COUNT,
) -> DataFrame:
    """A page of pending messages from ``start`` on, by id; a count of 0 or less means 100.

    The next page starts just after the last id of this one.
    """
    page = deliveries.where(
        (F.col("stream") == stream) & (F.col("grp") == group) & _pending()
    ).where(id_at_least(F.col("message_id"), *map(F.lit, parse_start(start))))
    if consumer:
        page = page.where(F.col("consumer") == consumer)
    return (
        page.select(
            "message_id", "consumer",
            _idle_ms(F.col("delivered_at"), as_of).alias("idle_ms"),
            F.col("delivery_count").alias("retry_count"),
        )
        .orderBy("message_id.ms", "message_id.seq")
        .limit(count if count > 0 else DEFAULT_COUNT)
    )


def message_ids(like: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """Distinct ``message_id`` rows from a DataFrame of them, or from ``ms-seq`` texts."""
    if not isinstance(ids, DataFrame):
        texts = [(text,) for text in ids]
        if not texts:
            raise ValueError("at least one message id is required")
        ids = like.sparkSession.createDataFrame(texts, "text string").select(
            parse_message_id(F.col("text")).alias("message_id")
        )
    return ids.select(F.col("message_id.ms").alias("ms"), F.col("message_id.seq").alias("seq")).distinct()


def _flag_named(deliveries: DataFrame, stream: str, group: str, ids: DataFrame) -> DataFrame:
    """Deliveries with ``_hit``: a pending row of the group whose id is named."""
    named = ids.withColumn("_named", F.lit(True))
    rows = deliveries.withColumn("ms", F.col("message_id.ms")).withColumn("seq", F.col("message_id.seq"))
    hit = (
        F.col("_named") & (F.col("stream") == stream) & (F.col("grp") == group) & _pending()
    )
    return rows.join(named, ["ms", "seq"], "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))


def claim_stale(
    deliveries: DataFrame, messages: DataFrame, stream: str, group: str, consumer: str,
    min_idle_ms: int, ids: DataFrame | Iterable[str], as_of: Column,
) -> tuple[DataFrame, DataFrame]:
    """Hand the named messages that are idle long enough to ``consumer``.

    Returns the new delivery state and the claimed events. Messages that are trimmed, or do not
    decode, are claimed but give no event.
    """
    flagged = _flag_named(deliveries, stream, group, message_ids(deliveries, ids)).withColumn(
        "_hit", F.col("_hit") & (_idle_ms(F.col("delivered_at"), as_of) >= min_idle_ms)
    )
    new_values = {
        "consumer": F.lit(consumer),
        "delivered_at": as_of,
        "delivery_count": F.col("delivery_count") + 1,
    }
    state = flagged.select(
        *[
            F.when(F.col("_hit"), new_values[c]).otherwise(F.col(c)).alias(c) if c in new_values else F.col(c)
            for c in deliveries.columns
        ]
    )
    claimed = flagged.where("_hit").select("ms", "seq")
    entries = (
        messages.where(F.col("stream") == stream)
        .withColumn("ms", F.col("message_id.ms"))
        .withColumn("seq", F.col("message_id.seq"))
        .join(claimed, ["ms", "seq"], "left_semi")
        .select("message_id", "payload")
    )
    events = parse_events(entries, "payload").where(F.col("parse_status") == OK)
    return state, events.drop("payload", "parse_status")


def ack_deliveries(
    deliveries: DataFrame, stream: str, group: str,
    ids: DataFrame | Iterable[str], as_of: Column,
) -> tuple[DataFrame, DataFrame]:
    """Acknowledge the named pending messages: the new state, and how many there were."""
    flagged = _flag_named(deliveries, stream, group, message_ids(deliveries, ids))
    state = flagged.withColumn(
        "acked_at", F.when(F.col("_hit"), as_of).otherwise(F.col("acked_at"))
    ).select(*deliveries.columns)
    return state, flagged.agg(F.count_if("_hit").alias("acknowledged"))


def _newest_cutoff(messages: DataFrame, keep: int) -> int | None:
    """Rank of the ``keep``-th newest id, or None when there are no more than ``keep``.

    Each pass counts the ids per equal slice of the range still in question, at most
    ``TRIM_BUCKETS`` counts, walks them from the newest, and goes on inside the one slice that
    holds the cutoff, between its smallest and largest id, until the slice is one id. A millisecond
    shared by a third of all messages is thus no harder than an even spread.
    """
    rank = id_rank(F.col("message_id"))
    bounds = messages.agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count("*").alias("n")).first()
    if bounds["n"] <= keep:
        return None
    low, high = int(bounds["lo"]), int(bounds["hi"])
    while low < high:
        width = (high - low) // TRIM_BUCKETS + 1
        slices = (
            _between(messages, low, high)
            .groupBy(F.expr(f"int((rank - {low}BD) div {width}BD)").alias("slice"))
            .agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
        )
        for row in sorted(slices.collect(), key=lambda r: -r["slice"]):
            if row["n"] >= keep:
                low, high = int(row["lo"]), int(row["hi"])
                break
            keep -= row["n"]
    return low


def _between(messages: DataFrame, low: int, high: int) -> DataFrame:
    """Ranks from ``low`` to ``high``; the bounds on ``ms`` let the scan skip row groups."""
    first, last = low // 10**19, high // 10**19
    return (
        messages.where((F.col("message_id.ms") >= first) & (F.col("message_id.ms") <= last))
        .select(id_rank(F.col("message_id")).alias("rank"))
        .where(F.expr(f"rank BETWEEN {low}BD AND {high}BD"))
    )


def trim_cutoff(messages: DataFrame, stream: str, max_len: int) -> tuple[int, int] | None:
    """(ms, seq) of the oldest message to keep, or None when all are kept."""
    if max_len <= 0:
        raise ValueError("max_len must be a positive integer")
    cutoff = _newest_cutoff(messages.where(F.col("stream") == stream), max_len)
    return None if cutoff is None else divmod(cutoff, 10**19)


def trim_stream(messages: DataFrame, stream: str, max_len: int) -> tuple[DataFrame, DataFrame]:
    """Keep the newest ``max_len`` messages of the stream exactly: the kept rows and the trimmed count.

    Other streams are untouched. Finding the cutoff runs counting jobs; the trim itself is a filter.
    """
    cutoff = trim_cutoff(messages, stream, max_len)
    if cutoff is None:
        drop = F.lit(False)
    else:
        drop = (F.col("stream") == stream) & ~id_at_least(F.col("message_id"), *map(F.lit, cutoff))
    return messages.where(~drop), messages.agg(F.count_if(drop).alias("trimmed"))

