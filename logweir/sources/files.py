"""File scans: NDJSON, whole JSON documents, spill segments and the API-key dimension."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from logweir.functions.scalars import MAX_BODY_BYTES
from logweir.session import matches

SEGMENT_GLOB = "segment-*"


def drop_cr(line: Column) -> Column:
    """A line without one trailing carriage return."""
    return F.when(
        F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)
    ).otherwise(line)


def scan_ndjson(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """One payload per non-empty line: ``raw_event``, its ``file`` and the block it is in.

    Takes ``spark.read`` or ``spark.readStream``. Only a line feed ends a line, so large files
    still split. Decode with ``parse_events``.
    """
    lines = reader.option("lineSep", "\n").text(path)
    return lines.select(
        drop_cr(F.col("value")).alias("raw_event"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ).where(F.octet_length("raw_event") > 0)


def with_place(lines: DataFrame) -> DataFrame:
    """Scanned lines of a batch with ``line_in_block``: with file and block it tells lines apart.

    The same files, read again by the same batch, give the same places.
    """
    return lines.withColumn("line_in_block", F.monotonically_increasing_id())


def scan_json_documents(
    spark: SparkSession, path: str | list[str], max_bytes: int = MAX_BODY_BYTES
) -> DataFrame:
    """One payload per file, whatever its size; ``size_ok`` tells whether a body limit would admit it.

    The driver lists the files. Give very many a part of their folders at a time.
    """
    endings = _packed_endings(spark)
    # The text reader copies the configuration and looks up codecs for each file; only packed ones need that.
    whole = spark.read.format("binaryFile").load(path).where(
        ~F.col("_metadata.file_name").rlike(rf"(?i)({'|'.join(map(re.escape, endings))})\z"))
    globs = [re.sub("[a-z]", lambda letter: f"[{letter[0]}{letter[0].upper()}]", ending) for ending in endings]
    packed = spark.read.option("pathGlobFilter", f"*{{{','.join(globs)}}}").text(path, wholetext=True)
    size = F.col("_metadata.file_size")
    parts = [
        files.select(
            content.alias("raw_event"), F.col("_metadata.file_path").alias("file"),
            size.alias("bytes"), (size <= max_bytes).alias("size_ok"))
        for files, content in ((whole, F.col("content").cast("string")), (packed, F.col("value")))
    ]
    return parts[0].unionByName(parts[1])


def _packed_endings(spark: SparkSession) -> list[str]:
    """What the names of compressed files end with, in either case, for the codecs of the session."""
    factory = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory
    codecs = factory.getCodecClasses(spark._jsc.hadoopConfiguration())
    return sorted({codec.newInstance().getDefaultExtension().lower() for codec in codecs})


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all segments with a sortable place: ``segment, file, block_start, line_in_block``.

    A segment is a file or folder named ``segment-...`` in ``path``. The place orders lines as they
    were written; nothing is sorted here, since most readers need no order. Malformed lines are
    told apart by ``parse_events``.
    """
    if not matches(spark, f"{path}/{SEGMENT_GLOB}"):
        return spark.createDataFrame(
            [], "segment string, file string, block_start long, line_in_block long, raw_event string"
        )
    lines = spark.read.option("lineSep", "\n").text(f"{path}/{SEGMENT_GLOB}")
    return lines.select(
        _segment(F.col("_metadata.file_path")).alias("segment"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_in_block"),
        drop_cr(F.col("value")).alias("raw_event"),
    )


def _segment(path: Column) -> Column:
    return F.regexp_extract(path, r"/(segment-[^/]+)(/[^/]+)?$", 1)


def segment_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of each segment file, from the listing alone: no content is read."""
    if not matches(spark, f"{path}/{SEGMENT_GLOB}"):
        return spark.createDataFrame([], "segment string, bytes long")
    files = spark.read.format("binaryFile").load(f"{path}/{SEGMENT_GLOB}")
    return files.select(_segment(F.col("path")).alias("segment"), F.col("length").alias("bytes"))


def ordered_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments by name, which is their age, with their size."""
    return segment_files(spark, path).groupBy("segment").agg(F.sum("bytes").alias("bytes")).orderBy("segment")


def load_api_keys(spark: SparkSession, path: str) -> DataFrame:
    """The API-key table; ``operators.auth.valid_keys`` selects the usable ones."""
    return spark.read.parquet(path)
