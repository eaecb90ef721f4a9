"""Layouts of the log table: bucketed by key for merges, clustered for selections by time, source and level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.keyed import latest_by_key

BUCKETS = 64
CLUSTER_BITS = 4


def write_bucketed(rows: DataFrame, table: str, path: str, key: str = "event_id", buckets: int = BUCKETS) -> None:
    """A table of one row per key, dealt into ``buckets`` by it: one sorted file each. ``path`` is a new folder."""
    (rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet")
     .saveAsTable(table))


def merged(spark: SparkSession, table: str, changes: DataFrame, order: Sequence[str], key: str = "event_id") -> DataFrame:
    """The bucketed table with the changes: of one key the last by ``order`` replaces what the table has.

    Only the changes are shuffled: reduced to a row per key, then into the table's buckets, since Spark would rather
    deal the table out again than go on with fewer partitions. The table is neither shuffled nor aggregated.
    """
    target = spark.table(table)
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    latest = latest_by_key(changes, key, order).select(*target.columns).repartition(int(described["data_type"]), key)
    return target.join(latest.select(key), key, "left_anti").unionByName(latest)


def merge_bucketed(
    spark: SparkSession, table: str, changes: DataFrame, order: Sequence[str], into: str, path: str,
    key: str = "event_id", buckets: int = BUCKETS,
) -> None:
    """Write ``merged`` as the table ``into``, in the same buckets: rows of the old table stay in their bucket's task."""
    state = merged(spark, table, changes, order, key)
    state.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(into)


def interleaved(*parts: Column, bits: int = CLUSTER_BITS) -> Column:
    """One number of the lowest ``bits`` of each part, bit by bit, so that near parts give near numbers."""
    value = F.lit(0)
    for bit in range(bits):
        for place, part in enumerate(parts):
            value = value.bitwiseOR(F.shiftleft(F.shiftright(part, bit).bitwiseAND(F.lit(1)), bit * len(parts) + place))
    return value


def cluster_logs(logs: DataFrame, path: str, files: int) -> None:
    """Write the logs foldered by ``event_date``, and inside a date clustered by hour, source and level.

    A file holds few sources and levels, so that its dictionaries and Bloom filters rule it out for most others;
    dates rule out folders. ``event_id`` has a Bloom filter too, for lookups. ``path`` is a new folder. Events of one
    date, source, level and 90 minutes stay in one file, as they can't be told apart.
    """
    dealt = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << CLUSTER_BITS)).cast("int")
    slot = F.floor((F.hour("event_time") * 60 + F.minute("event_time")) / 90).cast("int")
    rows = logs.withColumns({
        "event_date": F.to_date("event_time"),
        "_cluster": F.coalesce(interleaved(slot, dealt("source"), dealt("level")), F.lit(0))})
    writer = (rows.repartitionByRange(files, "event_date", "_cluster").sortWithinPartitions("event_date", "_cluster")
              .drop("_cluster").write.partitionBy("event_date"))
    for name in ("event_id", "source", "level"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)
