"""Streaming operators that keep state between micro-batches, in RocksDB (``session.SETTINGS``).

State is dealt by key to the shuffle partitions and checkpointed with the query, so a lost executor's share is
loaded again by another one. What each operator keeps, and when it goes, is stated with it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELIVERED, ACKED = "delivered", "acked"
KEYS = ("stream", "grp", "ms", "seq")


def dedup_stream(rows: DataFrame, key: Column, within: str, time: str | None = None) -> DataFrame:
    """The first row of each key; more rows of it are left out for ``within``.

    By default the time is that of arrival: it never runs backwards, so no row is late and none is lost; a row that
    comes again after ``within`` passes, and the sink has to fold it. With ``time``, a column of the rows, the time is
    theirs, and rows that are more than ``within`` behind the newest one are dropped as late: only for sources in
    order. A NULL time counts as that of arrival. Kept: one time per key, until ``within`` has passed.
    """
    clock = F.current_timestamp() if time is None else F.coalesce(F.col(time), F.current_timestamp())
    timed = rows.withColumns({"_key": key, "_time": clock}).withWatermark("_time", within)
    return timed.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_time")


# --- delivery ---------------------------------------------------------------------------------


def ledger_entries(deliveries: DataFrame) -> DataFrame:
    """A ledger as the entries that led to it: ``KEYS, kind, at, consumer, delivery_count``, one per delivery and ack."""
    entry = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at"))
    entries = F.array_compact(F.array(
        entry(DELIVERED, "delivered_at"), F.when(F.col("acked_at").isNotNull(), entry(ACKED, "acked_at"))))
    return deliveries.select(
        "stream", "grp", F.col("message_id.ms").alias("ms"), F.col("message_id.seq").alias("seq"),
        F.explode(entries).alias("entry"), "consumer", "delivery_count",
    ).select(*KEYS, "entry.kind", "entry.at", "consumer", "delivery_count")


# Messages of a group that share a row of state: those of four minutes of ids, dealt to lanes. The calls to the state
# store are made once a row and batch instead of once a message; a task holds one row of state at a time.
SLICE_MS, LANES = 240_000, 4


class IdleTimers(StatefulProcessor):
    """A slice of one group's messages: their last deliveries, and a timer that hands on those for which no ack has come."""

    def __init__(self, consumer: str, min_idle_ms: int, by_event: bool) -> None:
        self.consumer, self.min_idle_ms, self.by_event = consumer, min_idle_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Per message, in arrays of one order; ``timer`` is the one that is set.
        self.slice = handle.getValueState("slice", (
            "ms array<bigint>, seq array<bigint>, delivered_ms array<bigint>, delivery_count array<bigint>, "
            "done array<boolean>, timer bigint"))

    def _load(self) -> tuple[dict, int | None]:
        """The slice as ``(ms, seq) -> (delivered_ms, delivery_count, done)``, and its timer."""
        kept = self.slice.get()
        if kept is None:
            return {}, None
        ms, seq, delivered, counts, done, timer = kept
        return dict(zip(zip(ms, seq), zip(delivered, counts, done))), timer

    def _save(self, messages: dict, timer: int | None) -> None:
        """Keep the slice, with a timer for the message that is idle first."""
        due = min((ms for ms, _, done in messages.values() if not done and ms is not None), default=None)
        if due is not None:
            due += self.min_idle_ms
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        columns = [list(column) for column in (*zip(*messages), *zip(*messages.values()))]
        self.slice.update((*columns, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        messages, timer = self._load()
        for row in rows:
            message = (row.ms, row.seq)
            ms, count, done = messages.get(message, (None, 0, False))
            if row.kind == ACKED:
                done = True
            elif ms is None or (row.delivery_count, row.at_ms) > (count, ms):
                ms, count = row.at_ms, row.delivery_count
            messages[message] = (ms, count, done)
        self._save(messages, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        messages, _ = self._load()
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        idle = [message for message, (ms, _, done) in messages.items()
                if not done and ms is not None and ms + self.min_idle_ms <= now]
        for message in idle:
            messages[message] = (now, messages[message][1] + 1, False)
        self._save(messages, None)  # the timer that expired is gone
        for ms, seq in idle:
            yield Row(stream=key[0], grp=key[1], ms=ms, seq=seq, consumer=self.consumer,
                      delivered_ms=now, delivery_count=messages[ms, seq][1])

    def close(self) -> None:
        pass


REDELIVERED = "stream string, grp string, ms bigint, seq bigint, consumer string, delivered_ms bigint, delivery_count bigint"


def redeliver_idle(
    entries: DataFrame, consumer: str, min_idle_ms: int, lateness: str | None = None,
    slice_ms: int = SLICE_MS, lanes: int = LANES,
) -> DataFrame:
    """Hand messages on to ``consumer`` when they stay unacknowledged for ``min_idle_ms``, again and again until they are.

    ``entries`` is a stream like ``ledger_entries``. Idle time runs by the clock of the job; with ``lateness`` it runs
    by the entries' own times instead, and entries further behind the newest than that are dropped as late. By the
    job's clock a query needs a tick as its trigger: ``availableNow`` would wait for timers without an end.
    Kept: one entry a message, of an acknowledged one too, since its ack may come before its delivery; the messages of
    ``slice_ms`` of ids are dealt to ``lanes`` rows of state, which are read and written as a whole.
    """
    by_event = lateness is not None
    if by_event:
        entries = entries.withWatermark("at", lateness)
    sliced = entries.withColumns({
        "at_ms": F.unix_millis("at"), "slice": F.expr(f"ms - pmod(ms, {slice_ms}L)"),
        "lane": F.pmod(F.xxhash64("ms", "seq"), F.lit(lanes))})
    return sliced.groupBy("stream", "grp", "slice", "lane").transformWithState(
        IdleTimers(consumer, min_idle_ms, by_event), REDELIVERED, "append", "EventTime" if by_event else "ProcessingTime",
    ).withColumn("delivered_at", F.timestamp_millis("delivered_ms")).drop("delivered_ms")


def acks_of(deliveries: DataFrame, acks: DataFrame, within: str, lateness: str = "0 seconds") -> DataFrame:
    """Deliveries, each with ``acked_at`` of an ack that comes ``within`` the time after it, or NULL: still pending.

    ``deliveries`` has ``KEYS``, ``consumer`` and ``delivered_at``, ``acks`` has ``KEYS`` and ``acked_at``; both are
    streams. A delivery without an ack comes out once both streams are past its time; until then it is kept, as are
    acks for as long as a delivery before them may come.
    """
    left = deliveries.withWatermark("delivered_at", lateness)
    right = acks.select(*[F.col(name).alias(f"ack_{name}") for name in KEYS], "acked_at").withWatermark("acked_at", lateness)
    same = F.lit(True)
    for name in KEYS:
        same = same & (F.col(name) == F.col(f"ack_{name}"))
    timely = F.expr(f"acked_at >= delivered_at AND acked_at <= delivered_at + INTERVAL {within}")
    return left.join(right, same & timely, "left_outer").select(*KEYS, "consumer", "delivered_at", "acked_at")
