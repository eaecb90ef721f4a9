"""The event buffer: a Parquet dataset of ``message_id``, ``payload`` and ``received_at``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.decode import parse_events
from logweir.schema import BUFFER


def buffer_entries(
    spark: SparkSession, path: str, stream: bool = False, max_per_trigger: int | None = None
) -> DataFrame:
    """Entries of the buffer, not decoded: ``message_id``, ``payload`` and ``received_at``.

    As a stream, ``max_per_trigger`` limits the new files of one micro-batch.
    """
    reader = (spark.readStream if stream else spark.read).schema(BUFFER)
    reader = reader.option("recursiveFileLookup", "true")
    if stream and max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.parquet(path)


def read_buffer(
    spark: SparkSession, path: str, stream: bool = False, max_per_trigger: int | None = None
) -> DataFrame:
    """Buffered entries decoded into event columns, ``message_id``, ``payload`` and ``parse_status``.

    Entries without a payload, or with one that does not decode, have ``error_parse``.
    """
    return decode_entries(buffer_entries(spark, path, stream, max_per_trigger))


def kafka_entries(records: DataFrame) -> DataFrame:
    """Rows of Spark's Kafka source as buffer entries, for clusters that buffer in a topic.

    The id is the record's time, then its partition and offset.
    """
    seq = F.shiftleft(F.col("partition").cast("long"), 48) + F.col("offset")
    return records.select(
        F.struct(F.unix_millis("timestamp").alias("ms"), seq.alias("seq")).alias("message_id"),
        F.col("value").cast("string").alias("payload"),
        F.col("timestamp").alias("received_at"),
    )


def decode_entries(entries: DataFrame) -> DataFrame:
    """Decode the ``payload`` of entries, keeping the message id."""
    return parse_events(entries.select(F.col("message_id"), F.col("payload")), "payload")
