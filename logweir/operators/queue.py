"""The table queue ``log_buffer``: insert, read the oldest, claim, acknowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.operators.keyed import insert_if_absent
from logweir.schema import LOG_BUFFER


def insert_queue(log_buffer: DataFrame, events: DataFrame) -> DataFrame:
    """Queue the events whose id is not queued yet: no group, not acknowledged, no retries."""
    rows = events.withColumnRenamed("event_id", "id").select(
        *[c for c in LOG_BUFFER.fieldNames()[:7]],
        F.lit(None).cast("string").alias("consumer_group"),
        F.lit(False).alias("acknowledged"),
        F.lit(0).alias("retry_count"),
    )
    return insert_if_absent(log_buffer, rows, "id", ["received_at", "event_time", "message"])


def pending_filter(group: str) -> Column:
    """Rows the group may read: not acknowledged, and free or its own."""
    owner = F.col("consumer_group")
    return ~F.col("acknowledged") & (owner.isNull() | (owner == group))


def read_queue_batch(log_buffer: DataFrame, group: str, count: int) -> DataFrame:
    """The ``count`` oldest rows the group may read; equal times are ordered by id."""
    return (
        log_buffer.where(pending_filter(group))
        .select(*LOG_BUFFER.fieldNames()[:7])
        .orderBy("received_at", "id")
        .limit(count)
    )


def _marked(log_buffer: DataFrame, ids: DataFrame) -> DataFrame:
    named = ids.select("id").distinct().withColumn("_named", F.lit(True))
    return log_buffer.join(named, "id", "left")


def claim_queue(log_buffer: DataFrame, group: str, count: int) -> DataFrame:
    """New queue state: the batch ``read_queue_batch`` returns now belongs to the group."""
    batch = read_queue_batch(log_buffer, group, count)
    owner = F.when(F.col("_named"), F.lit(group)).otherwise(F.col("consumer_group"))
    return (
        _marked(log_buffer, batch)
        .withColumn("consumer_group", owner)
        .select(*log_buffer.columns)
    )


def ack_queue(log_buffer: DataFrame, ids: DataFrame, group: str) -> DataFrame:
    """New queue state: the named rows of the group are acknowledged, all others unchanged."""
    hit = F.col("_named") & (F.col("consumer_group") == group)
    return (
        _marked(log_buffer, ids)
        .withColumn("acknowledged", F.coalesce(hit, F.lit(False)) | F.col("acknowledged"))
        .select(*log_buffer.columns)
    )
