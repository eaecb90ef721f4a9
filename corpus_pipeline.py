"""From raw documents to packed training sequences: five stages, each a table that the next one reads.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet below the shared
folder and reads it back, so a lost executor costs at most the stage it was in. All stages but the last return the
columns of their input, with ``text`` and ``n_chars`` changed where the stage takes text out.

Defined results: a NULL or blank text does not pass the quality rules; rows that repeat an id are kept or dropped
together by near-dedup and decontamination; stages on an empty table return an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import decontaminate, linededup, neardup, packing, quality
from logweir.session import configure, work_dir


SIMILAR = 80


def _with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The fields of ``doc``, with the text replaced and its length brought up to date."""
    changed = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[changed.get(name, F.col("doc")[name]).alias(name) for name in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that failed."""
    return _with_text(quality.clean_lines(docs).where("quality.kept"), docs.columns, F.col("quality.text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a line that many of them share stays in one."""
    return _with_text(linededup.dedup_lines(docs), docs.columns, F.col("lines.text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, from ``SIMILAR`` percent on: the one with the smallest id."""
    kept = neardup.near_duplicates(docs, percent=SIMILAR).where("kept").select(F.col("id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequence, capacity and place."""
    return packing.pack(docs, packing.count_tokens(F.col("text")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Edit distance and best-fit have no SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
