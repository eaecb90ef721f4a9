"""Keyed mutations of tables: upsert, insert-if-absent, delete, move to the dead-letter table.

Each takes the table's present state and returns the new one. Batches are reduced to one row per
key first; the reduction also runs before the shuffle, so one hot key costs no task more than a
row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the reason a moved row gets.
MOVE_REASON = "manual DLQ move"


def _pick(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def latest_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (columns, ascending)."""
    return _pick(df, key, [F.col(c).desc_nulls_last() for c in order])


def first_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return _pick(df, key, [F.col(c).asc_nulls_last() for c in order])


def upsert(
    target: DataFrame, events: DataFrame, key: str = "event_id",
    order: Sequence[str] = ("message_id.ms", "message_id.seq"),
) -> DataFrame:
    """Replace or add the events by key; within the batch the last by ``order`` wins.

    ``target`` has one row per key. Only the keys of the batch meet it, so it is not aggregated
    again, and it is not even shuffled while those keys are small enough to broadcast.
    """
    latest = latest_by_key(events, key, order).select(*target.columns)
    untouched = target.join(events.select(key).distinct(), key, "left_anti")
    return untouched.unionByName(latest)


def insert_if_absent(
    target: DataFrame, rows: DataFrame, key: str, order: Sequence[str]
) -> DataFrame:
    """Add the rows whose key is new; within the batch the first by ``order`` wins."""
    return target.unionByName(new_rows(target, rows, key, order).select(*target.columns))


def new_rows(target: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows ``insert_if_absent`` would add: what an appending sink has to write."""
    first = first_by_key(rows, key, order)
    return first.join(target.select(key), key, "left_anti").select(*rows.columns)


def delete_by_id(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is not in ``ids``."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def move_to_dlq(
    log_buffer: DataFrame, log_dlq: DataFrame, events: DataFrame,
    as_of: Column, reason: str = MOVE_REASON,
) -> tuple[DataFrame, DataFrame]:
    """New states of the dead-letter table and of the buffer after moving the events.

    ``events`` has the dead-letter table's data columns under ``id``; an event need not be in the buffer to be
    kept. A row already in the dead-letter table stays as it is, but still leaves the buffer.
    """
    data = ("event_time", "source", "level", "message", "metadata")
    moved = events.select("id", as_of.alias("failed_at"), F.lit(reason).alias("reason"), *data)
    return insert_if_absent(log_dlq, moved, "id", ["event_time", "message"]), delete_by_id(log_buffer, events)
