"""Queries of table layouts and of sketches, each checked against exact rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logweir.functions import variants
from logweir.operators import keyed, layout, metrics, sketches
from logweir.plans import sql as S
from logweir.plans import views as V
from logweir.plans.ingest import outcomes
from logweir.plans.registry import query
from logweir.plans.tables import FIRST_BATCHES, LATEST, LOG_COLUMNS, ORDER
from logweir.session import work_dir


@query("bucketed_upsert", LATEST + "SELECT event_id, source, level, message, metadata, event_time FROM latest")
def bucketed_upsert(spark, sf_dir):
    """The first batches as a bucketed table, the next one merged into it, the last one merged on reading."""
    versions = V.versions(spark, sf_dir)
    columns = ["event_id", "source", "level", "message", "metadata", "event_time"]
    names = [f"logs_{uuid.uuid4().hex}" for _ in range(2)]
    first = keyed.latest_by_key(versions.where(F.col("batch_id") < FIRST_BATCHES), "event_id", ORDER)
    layout.write_bucketed(first.select(*columns), names[0], work_dir(spark, "bucketed"), buckets=8)
    next_batch = versions.where(F.col("batch_id") == FIRST_BATCHES)
    layout.merge_bucketed(spark, names[0], next_batch, ORDER, names[1], work_dir(spark, "bucketed"), buckets=8)
    last = layout.merged(spark, names[1], versions.where(F.col("batch_id") > FIRST_BATCHES), ORDER)
    return last.select(*LOG_COLUMNS, *V.ntz("event_time"))


@query("clustered_filter", S.with_(S.EV) + """
SELECT event_id, event_time, source, level FROM ev
WHERE event_time >= TIMESTAMP '2024-01-05 06:00:00' AND event_time < TIMESTAMP '2024-01-20'
  AND source IN ('svc-1', 'svc-2', 'svc-5') AND level IN ('error', 'purchase')""")
def clustered_filter(spark, sf_dir):
    path = work_dir(spark, "clustered")
    layout.cluster_logs(V.log_events(spark, sf_dir), path, 64)
    moment = lambda text: F.to_timestamp_ntz(F.lit(text)).cast("timestamp")
    rows = metrics.filter_logs(
        spark.read.parquet(path), moment("2024-01-05 06:00:00"), moment("2024-01-20 00:00:00"),
        ["svc-1", "svc-2", "svc-5"], ["error", "purchase"])
    return rows.select("event_id", *V.ntz("event_time"), "source", "level")


@query("latency_rollup", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT method, path, status, count(*) AS requests, TRUE AS p50_ok, TRUE AS p95_ok, TRUE AS p99_ok
FROM answered GROUP BY method, path, status""")
def latency_rollup(spark, sf_dir):
    """Percentiles from hourly sketches; their true ranks, over all rows, are within the stated error."""
    rows = outcomes(spark, sf_dir)
    group = ["method", "path", "status"]
    found = sketches.latency_rollup(sketches.latency_sketches(rows))
    ranks = []
    for p in (50, 95, 99):
        value = F.col(f"p{p}_ms")
        below, upto = F.avg((F.col("duration_ms") < value).cast("double")), F.avg((F.col("duration_ms") <= value).cast("double"))
        error = sketches.RANK_ERROR + F.lit(1.0) / F.count("*")
        ranks.append(((below - error <= p / 100) & (upto + error >= p / 100)).alias(f"p{p}_ok"))
    return rows.join(found, group).groupBy(*group, "requests").agg(*ranks).where(F.col("requests") > 0)


@query("distinct_deliveries", S.with_(S.EV, S.DELIVERIES) + """
SELECT stream, grp, count(DISTINCT consumer) AS consumers, TRUE AS ids_ok FROM deliveries GROUP BY stream, grp""")
def distinct_deliveries(spark, sf_dir):
    """Distinct consumers and ids from hourly sketches; the ids are within the stated error of the exact count."""
    rows = V.deliveries(spark, sf_dir)
    found = sketches.distinct_deliveries(sketches.delivery_sketches(rows))
    exact = rows.groupBy("stream", "grp").agg(F.count_distinct("message_id").alias("n"))
    off = F.abs(F.col("ids") - F.col("n")) / F.col("n")
    return found.join(exact, ["stream", "grp"]).select(
        "stream", "grp", "consumers", (off <= sketches.DISTINCT_ERROR).alias("ids_ok"))


def variant_logs(spark, sf_dir):
    """Log events stored with their metadata as a shredded VARIANT."""
    path = work_dir(spark, "variants")
    variants.with_variant(V.log_events(spark, sf_dir)).select(
        "event_id", "level", "metadata", "metadata_other").write.parquet(path)
    return spark.read.parquet(path)


@query("variant_filter", S.with_(S.EV) + """
SELECT event_id, level, user_id AS "user" FROM ev
WHERE level IN ('signup', 'error') AND user_id BETWEEN 100 AND 400""")
def variant_filter(spark, sf_dir):
    """A path predicate on stored metadata; errors and signups have a user."""
    user = variants.at_path(F.col("metadata"), "$.user", "bigint")
    rows = variant_logs(spark, sf_dir).where(user.between(100, 400) & F.col("level").isin("signup", "error"))
    return rows.select("event_id", "level", user.alias("user"))


@query("variant_redact", S.with_(S.EV) + f"""
SELECT event_id, coalesce(cleaned, {S.COMPACT}) AS metadata, cleaned IS NOT NULL AS pii_redacted FROM ev""")
def variant_redact(spark, sf_dir):
    """Stored metadata redacted as a value; the text is only made for the result."""
    rows = variants.redact_variant(variant_logs(spark, sf_dir))
    return rows.select("event_id", F.to_json(variants.whole()).alias("metadata"), "pii_redacted")
