"""Queries of the ingest path: decode, enrich, redact, requests, keys, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.decode import OK, parse_events
from logweir.functions.enrich import enrich
from logweir.functions.redact import redact
from logweir.functions.scalars import (
    classify_media_type, message_id_text, parse_duration_ms, parse_message_id, within_size,
)
from logweir.operators import auth, metrics, quality
from logweir.plans import sql as S
from logweir.plans import views as V
from logweir.plans.registry import query
from logweir.session import work_dir
from logweir.sources.files import scan_ndjson
from logweir.sources.requests import explode_requests

TEXT_LIMIT, TEXT_LINE = 8_192, 4_096
# A size in the middle of the bodies, for the label alone.
LABEL_LIMIT = 260


def as_of() -> Column:
    return F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")).cast("timestamp")


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "ndjson")
    V.raw_lines(spark, sf_dir).write.text(path)
    return scan_ndjson(spark.read, path)


@query("parse_ndjson", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT event_id, event_time, source, level, strlen(message) AS message_bytes, md5(message) AS message_md5,
       metadata, parse_status
FROM decoded""")
def parse_ndjson(spark, sf_dir):
    decoded = parse_events(scanned_lines(spark, sf_dir))
    return decoded.select(
        "event_id", *V.ntz("event_time"), "source", "level",
        F.octet_length("message").cast("long").alias("message_bytes"),
        F.md5("message").alias("message_md5"), "metadata", "parse_status",
    )


@query("parse_counts", S.with_(S.EV, S.TEXTS, S.DECODED) + """
SELECT parse_status, level, count(*) AS lines, CAST(sum(strlen(message)) AS BIGINT) AS message_bytes
FROM decoded GROUP BY ALL""")
def parse_counts(spark, sf_dir):
    lines = V.raw_lines(spark, sf_dir).where(F.octet_length("value") > 0)
    return parse_events(lines, "value").groupBy("parse_status", "level").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("message")).alias("message_bytes")
    )


@query("redact", S.with_(S.EV) + """
SELECT event_id, coalesce(cleaned, metadata) AS metadata, cleaned IS NOT NULL AS pii_redacted FROM ev""")
def redacted(spark, sf_dir):
    return redact(V.log_events(spark, sf_dir)).select("event_id", "metadata", "pii_redacted")


@query("redact_field", """
SELECT event_id AS n, json_merge_patch(props, '{"k":"[REDACTED]"}') AS metadata, TRUE AS pii_redacted FROM events""")
def redact_field(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("props").alias("metadata"))
    return redact(events, ["k"])


@query("redacted_per_day", S.with_(S.EV) + """
SELECT strftime(event_time, '%Y-%m-%d') AS event_date, level, count(*) AS events,
       CAST(count(*) FILTER (WHERE cleaned IS NOT NULL) AS BIGINT) AS redacted
FROM ev GROUP BY ALL""")
def redacted_per_day(spark, sf_dir):
    """Decode, redact and count: the whole narrow path under one aggregation."""
    lines = V.log_events(spark, sf_dir).select(
        F.to_json(F.struct("event_id", "event_time", "level", F.parse_json("metadata").alias("metadata")),
                  {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("raw_event")
    )
    events = redact(parse_events(lines).where(F.col("parse_status") == OK))
    days = events.groupBy(F.to_date("event_time").alias("event_date"), "level").agg(
        F.count("*").alias("events"), F.count_if("pii_redacted").alias("redacted")
    )
    return days.withColumn("event_date", F.col("event_date").cast("string"))


@query("enrich_ids", S.with_(S.EV, """named AS (
  SELECT *, sha256(source || chr(31) || message) AS h FROM ev)""") + """
SELECT n, TIMESTAMP '2024-02-01' AS received_at,
       CASE WHEN level = 'click' THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4)
              || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
            ELSE event_id END AS event_id
FROM named""")
def enrich_ids(spark, sf_dir):
    events = V.log_events(spark, sf_dir).withColumn(
        "event_id", F.when(F.col("level") == "click", "").otherwise(F.col("event_id"))
    )
    named = enrich(events, as_of(), "deterministic", ("source", "message"))
    return named.select("n", *V.ntz("received_at"), "event_id")


@query("media_and_size", S.with_(S.EV, S.KEYS, S.REQUESTS) + f"""
SELECT request_id, media, bytes <= {LABEL_LIMIT} AS size_ok FROM sized""")
def media_and_size(spark, sf_dir):
    return V.requests(spark, sf_dir).select(
        "request_id", classify_media_type(F.col("content_type")).alias("media"),
        within_size(F.col("body"), LABEL_LIMIT).alias("size_ok"),
    )


@query("explode_requests", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
placed AS (
  SELECT doc_id, pos, line, strlen(CAST(to_json(line) AS VARCHAR)) + 12 AS bytes FROM lines),
ended AS (
  SELECT *, CAST(sum(bytes + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS stop,
         max(CASE WHEN bytes >= {TEXT_LINE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS stopped
  FROM placed)
SELECT doc_id AS request_id, pos AS line_no, TRUE AS decoded, md5(line) AS message_md5,
       stopped = 1 OR stop > {TEXT_LIMIT} AS past_limit
FROM ended""")
def exploded(spark, sf_dir):
    """All lines of long texts as request bodies, with those beyond the limits marked."""
    rows = explode_requests(V.text_requests(spark, sf_dir), TEXT_LIMIT, TEXT_LINE)
    return parse_events(rows).select(
        "request_id", F.col("line_no").cast("long").alias("line_no"),
        (F.col("parse_status") == OK).alias("decoded"), F.md5("message").alias("message_md5"), "past_limit",
    )


@query("request_outcome", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT request_id, api_key, media, bytes AS body_bytes, authenticated, status, label FROM answered""")
def request_outcome(spark, sf_dir):
    return outcomes(spark, sf_dir).select(
        "request_id", "api_key", "media", F.col("body_bytes").cast("long").alias("body_bytes"),
        "authenticated", "status", "label",
    )


def outcomes(spark, sf_dir):
    return auth.request_outcome(V.requests(spark, sf_dir), V.api_keys(spark, sf_dir), as_of())


@query("events_by_status", S.with_(S.EV, S.KEYS, S.REQUESTS, """parts AS (
  SELECT label AS status, 1 AS k FROM outcomes
  WHERE method = 'POST' AND authenticated AND label IN ('error_media_type', 'error_size')
  UNION ALL SELECT 'accepted', CASE media WHEN 'json' THEN 1 ELSE 3 END FROM outcomes WHERE label = 'accepted'
  UNION ALL SELECT 'error_parse', 1 FROM outcomes
  WHERE label = 'error_parse' OR (media = 'ndjson' AND label = 'accepted'))""") + """
SELECT status, CAST(sum(k) AS BIGINT) AS events FROM parts GROUP BY status""")
def events_by_status(spark, sf_dir):
    return metrics.events_by_status(V.requests(spark, sf_dir), V.api_keys(spark, sf_dir), as_of())


def refused(spark, sf_dir):
    """The first event of every ninth request, and a line that does not exist."""
    first = V.requests(spark, sf_dir).where("request_id % 9 = 0").select("request_id", F.lit(0).alias("line_no"))
    return first.unionAll(first).unionAll(first.select("request_id", F.lit(99).alias("line_no")))


@query("error_buffer_outcome", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT request_id, CASE WHEN failed THEN 400 ELSE status END AS status,
       CASE WHEN failed THEN 'error_buffer' ELSE label END AS label
FROM (SELECT *, label = 'accepted' AND media = 'json' AND request_id % 9 = 0 AS failed FROM answered)""")
def error_buffer_outcome(spark, sf_dir):
    rows = auth.request_outcome(
        V.requests(spark, sf_dir), V.api_keys(spark, sf_dir), as_of(), refused=refused(spark, sf_dir))
    return rows.select("request_id", "status", "label")


@query("error_buffer_events", S.with_(S.EV, S.KEYS, S.REQUESTS, """taken AS (
  SELECT *, request_id % 9 = 0 AS refused FROM outcomes WHERE method = 'POST' AND authenticated),
parts AS (
  SELECT label AS status, 1 AS k FROM taken WHERE label IN ('error_media_type', 'error_size')
  UNION ALL SELECT CASE WHEN refused THEN 'error_buffer' ELSE 'accepted' END, 1 FROM taken WHERE label = 'accepted'
  UNION ALL SELECT 'accepted', 2 FROM taken WHERE label = 'accepted' AND media = 'ndjson'
  UNION ALL SELECT 'error_parse', 1 FROM taken
  WHERE label = 'error_parse' OR (media = 'ndjson' AND label = 'accepted'))""") + """
SELECT status, CAST(sum(k) AS BIGINT) AS events FROM parts GROUP BY status""")
def error_buffer_events(spark, sf_dir):
    return metrics.events_by_status(
        V.requests(spark, sf_dir), V.api_keys(spark, sf_dir), as_of(), refused=refused(spark, sf_dir))


@query("bytes_total", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT CAST(sum(bytes) AS BIGINT) AS bytes FROM sized WHERE method = 'POST' AND authenticated""")
def bytes_total(spark, sf_dir):
    return metrics.bytes_total(V.requests(spark, sf_dir), V.api_keys(spark, sf_dir), as_of())


@query("request_summary", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT count(*) AS requests, CAST(count(*) FILTER (WHERE status = 202) AS BIGINT) AS succeeded,
       CAST(count(*) FILTER (WHERE status <> 202) AS BIGINT) AS failed,
       CAST(round(1e9 * count(*) / ((epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6)) AS BIGINT) AS nano_rate
FROM answered""")
def request_summary(spark, sf_dir):
    summary = metrics.request_summary(outcomes(spark, sf_dir))
    return summary.select(
        "requests", "succeeded", "failed",
        F.round(F.col("requests_per_second") * 1e9).cast("long").alias("nano_rate"),
    )


@query("access_log", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT method, path, status, count(*) AS requests, quantile_disc(duration_ms, 0.5) AS p50_ms,
       quantile_disc(duration_ms, 0.95) AS p95_ms, quantile_disc(duration_ms, 0.99) AS p99_ms
FROM answered GROUP BY method, path, status""")
def access_log(spark, sf_dir):
    return metrics.access_log(outcomes(spark, sf_dir))


@query("valid_keys", S.with_(S.KEYS) + "SELECT key AS api_key FROM valid_keys")
def valid_keys(spark, sf_dir):
    return auth.valid_keys(V.api_keys(spark, sf_dir), as_of())


@query("authenticate", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT request_id, api_key FROM requests
WHERE EXISTS (SELECT 1 FROM valid_keys WHERE key = api_key)""")
def authenticate(spark, sf_dir):
    admitted = auth.authenticate(V.requests(spark, sf_dir), V.api_keys(spark, sf_dir), as_of())
    return admitted.select("request_id", "api_key")


@query("reject_unauthenticated", S.with_(S.EV, S.KEYS, S.REQUESTS) + """
SELECT request_id, api_key, CASE WHEN api_key = '' THEN 'missing' ELSE 'invalid' END AS reason FROM requests
WHERE NOT EXISTS (SELECT 1 FROM valid_keys WHERE key = api_key)""")
def reject(spark, sf_dir):
    refused = auth.reject_unauthenticated(V.requests(spark, sf_dir), V.api_keys(spark, sf_dir), as_of())
    return refused.select("request_id", "api_key", "reason")


@query("invalid_rows", S.with_(S.EV) + """
SELECT n, CASE WHEN level IN ('click', 'signup') AND user_id % 2 = 0 THEN 'event_id is not a uuid'
               WHEN level = 'error' AND user_id % 2 = 0 THEN 'source is null'
               ELSE 'metadata is not json' END AS reason
FROM ev WHERE (level IN ('click', 'signup') AND user_id % 2 = 0) OR (level = 'error' AND user_id % 2 = 0) OR level = 'view'""")
def invalid_rows(spark, sf_dir):
    level, even = F.col("level"), F.col("user_id") % 2 == 0
    events = V.log_events(spark, sf_dir).withColumns({
        "event_id": F.when((level == "click") & even, F.concat("event_id", F.lit("x"))).when(
            (level == "signup") & even, F.concat("event_id", F.lit("\n"))).otherwise(F.col("event_id")),
        "source": F.when(~((level == "error") & even), F.col("source")),
        "metadata": F.when(level == "view", F.concat("metadata", F.lit("]"))).otherwise(F.col("metadata")),
    })
    return quality.invalid_rows(events).select("n", "reason")


@query("batch_conflicts", S.with_(S.EV, S.VERSIONS) + """
SELECT batch_id, event_id, count(*) AS rows FROM versions GROUP BY batch_id, event_id HAVING count(*) > 1""")
def batch_conflicts(spark, sf_dir):
    return quality.batch_conflicts(V.versions(spark, sf_dir))


@query("parse_duration", """
SELECT event_id AS n,
       CASE event_type WHEN 'click' THEN CAST((user_id * 3600 + (event_id % 60) * 60) * 1000 + 500 AS VARCHAR)
                       WHEN 'view' THEN CAST(event_id * 1000 + user_id AS VARCHAR)
                       WHEN 'signup' THEN CAST(-60000 * user_id AS VARCHAR)
                       WHEN 'purchase' THEN CAST(event_id // 1000 AS VARCHAR)
                       WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN CAST(event_id * 1000 + 999 AS VARCHAR) ELSE 'invalid' END
                       ELSE 'invalid' END AS millis
FROM events""")
def parse_duration(spark, sf_dir):
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(user, F.lit("h"), n % 60, F.lit("m0.5s")))
        .when(kind == "view", F.concat(n, F.lit("s"), user, F.lit("ms")))
        .when(kind == "signup", F.concat(F.lit("-"), user, F.lit("m")))
        .when(kind == "purchase", F.concat(n, F.lit("µs")))
        .when((kind == "error") & (n % 3 == 0), F.concat(n, F.lit(".9999999999s")))
        .when((kind == "error") & (n % 3 == 1), F.concat(n, F.lit("s\n")))
        .otherwise(F.concat(n, F.lit(" s")))
    )
    millis = F.coalesce(parse_duration_ms(text).cast("string"), F.lit("invalid"))
    return V.table(spark, sf_dir, "events").select(n.alias("n"), millis.alias("millis"))


@query("parse_message_id", """
SELECT event_id AS n,
       CASE event_type WHEN 'error' THEN 'invalid' WHEN 'signup' THEN '0-0'
                       WHEN 'purchase' THEN '9223372036854775807-9223372036854775807'
                       WHEN 'click' THEN (epoch_us(ts) // 1000) || '-' || event_id
                       ELSE (epoch_us(ts) // 1000) || '-0' END AS message_id
FROM events""")
def message_id(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_type")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = (
        F.when(kind == "click", F.concat_ws("-", ms, n))
        .when(kind == "view", ms.cast("string"))
        .when(kind == "signup", "-")
        .when(kind == "purchase", "+")
        .when(n % 2 == 0, F.concat(ms, F.lit("-5\n")))
        .otherwise(F.concat(ms, F.lit("-x")))
    )
    parsed = V.table(spark, sf_dir, "events").select(n.alias("n"), parse_message_id(text).alias("id"))
    shown = F.when(F.col("id").isNotNull(), message_id_text(F.col("id"))).otherwise("invalid")
    return parsed.select("n", shown.alias("message_id"))
