"""Rows and batches the sink's constraints would refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.decode import one_value_sql

# Fixed value: 32 hex digits, a hyphen allowed after each group of four, braces allowed around.
UUID = r"^(\{[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7}\}|[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7})\z"
# A missing event time is kept as NULL, so it is not among them.
REQUIRED = ("received_at", "source", "level", "message")


def invalid_reason(check_metadata: bool = True) -> Column:
    """Why the sink would refuse a row, or NULL. The first broken rule is named.

    ``check_metadata=False`` is for events fresh from the decode, whose metadata is JSON.
    """
    reason = F.when(F.col("event_id").isNull(), "event_id is null").when(
        ~F.col("event_id").rlike(UUID), "event_id is not a uuid"
    )
    for name in REQUIRED:
        reason = reason.when(F.col(name).isNull(), f"{name} is null")
    if not check_metadata:
        return reason
    broken = F.expr(f"metadata IS NOT NULL AND NOT coalesce({one_value_sql('metadata')}, false)")
    return reason.when(broken, "metadata is not json")


def invalid_rows(events: DataFrame) -> DataFrame:
    """The refused rows with ``reason``."""
    return events.withColumn("reason", invalid_reason()).where(F.col("reason").isNotNull())


def valid_rows(events: DataFrame) -> DataFrame:
    return events.where(invalid_reason().isNull())


def batch_conflicts(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once in one batch."""
    return (
        events.groupBy("batch_id", "event_id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    )
