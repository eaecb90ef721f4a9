"""The registered corpus queries, each beside the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import (
    ann, decontaminate, hardnegatives, licenses, linededup, neardup, packing, ppm, quality, resample, tokens, warc, wrapper,
)
from logweir.llm.text import table
from logweir.session import configure, work_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: function(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


@query("op6_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.clean_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return docs.select("doc.doc_id", *[f"quality.{name}" for name in names])


@query("op8_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> f.keeper, false) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc.doc_id", F.col("lines.n").alias("n_lines"), F.col("lines.dropped").alias("n_dropped"),
                       F.sha2("lines.text", 256).alias("kept_sha256"))


@query("op3_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    starts = F.transform("base", lambda x: x["i"])
    base = F.array_distinct(F.transform("base", lambda x: x["label"]))
    more = F.coalesce(F.col("found.labels"), F.array().cast("array<string>"))
    named = F.when(F.size("base") > 0, F.lit(licenses.FORMS["named"][1])).otherwise(F.lit(0.0))
    return docs.select(
        "doc.doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.greatest(named, F.coalesce("found.score", F.lit(0.0))).alias("score"))


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), packing.count_tokens(F.col("text")))


@query("op1_html_wrapper")
def html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op10_warc_derivatives")
def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.derive(warc.responses_of_pages(pages), "page_id").withColumnRenamed("key", "page_id")


@query("op7_rans_tokens")
def rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return tokens.read(spark, path, zlib.crc32, "bigint").withColumnRenamed("taken", "ids_crc32")


@query("op5_ppm_score")
def ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_hyperminhash_dedup", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
  WHERE 100 * p.shared >= 85 * (x.n + y.n - p.shared)
), r AS (
  WITH RECURSIVE c AS (
    SELECT doc_id, doc_id AS reached FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.reached = e.a
  ) SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON d.doc_id = r.doc_id
""")
def hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"), "kept")


@query("op2_cgk_decontamination")
def cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op11_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents", "doc_id", "text"),
                              table(spark, sf_dir, "benchmark", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op12_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
  ) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").select(
        F.col("vec_id").alias("id"), hardnegatives.shifted_label(F.col("vec_id"), F.col("label")).alias("label"),
        F.col("embedding").alias("vector"))
    return hardnegatives.mine(rows)


@query("op13_learned_partitions")
def learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding").toDF("id", "vector"))
