"""Session settings the transforms rely on, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Event times are compared and printed in UTC.
    "spark.sql.session.timeZone": "UTC",
    # JSON objects may repeat a key; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One key may hold a third of the rows: split its join partition.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streaming operators is kept on disk, not in the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Its writes do not read the key first to tell new ones for a count of rows, which nothing here uses; commits store
    # the changes and leave snapshots to the background; a join keeps one store per partition instead of four. A
    # query that goes on from an older checkpoint keeps the join's layout of that checkpoint.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "logweir", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, as the cluster names it.

    Where neither that setting nor a checkpoint folder of the context is there, a local-mode session, whose
    only executor is the driver, gets a folder of its own; a cluster session is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweir-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/logweir/{name}-{uuid.uuid4().hex}"


def _found(spark: SparkSession, pattern: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [status.getPath() for status in system.globStatus(path) or []]


def on_disk(spark: SparkSession, path: str) -> str | None:
    """The path as Python opens it, where it is on a disk of this machine or a mounted one; None for other stores."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toUri().getPath() if system.getUri().getScheme() == "file" else None


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder matches the path pattern, on whatever file system it names."""
    return bool(_found(spark, pattern)[1])


def folder_names(spark: SparkSession, prefix: str) -> list[str]:
    """What follows the prefix in the names of the folders that start with it, ascending."""
    name = prefix.rsplit("/", 1)[-1]
    return sorted(path.getName().removeprefix(name) for path in _found(spark, f"{prefix}*")[1])


def folder_numbers(spark: SparkSession, prefix: str) -> list[int]:
    """The numbers n for which there is a folder ``<prefix>n``, ascending. Only names are listed."""
    return sorted(int(number) for number in folder_names(spark, prefix))


def committed_numbers(spark: SparkSession, prefix: str) -> list[int]:
    """The numbers n whose folder ``<prefix>n`` was written to its end, ascending, from one listing."""
    name = prefix.rsplit("/", 1)[-1]
    done = _found(spark, f"{prefix}*/_SUCCESS")[1]
    return sorted(int(path.getParent().getName().removeprefix(name)) for path in done)


def remove(spark: SparkSession, pattern: str) -> None:
    """Delete the files and folders that match the path pattern."""
    system, paths = _found(spark, pattern)
    for path in paths:
        system.delete(path, True)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a batch write to the folder ran to its end."""
    return matches(spark, f"{path}/_SUCCESS")
