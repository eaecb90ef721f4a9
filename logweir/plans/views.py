"""The given tables seen as log events, requests, queue rows and deliveries.

``events`` gives the structured log traffic; ``documents``, ``conversations`` and ``pages`` give
long message texts. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.scalars import JSON_TYPE, NDJSON_TYPE

STREAM = "log_events"
OTHER_STREAM = "other_events"
GROUP = "log-processors"
HOT_ID = "00000000-0000-4000-8000-ffffffffffff"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(*names: str) -> list[Column]:
    """Timestamps as plain date-times for the result tables."""
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def _uuid(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(f"00000000-0000-4000-{prefix}-"), F.lpad(number.cast("string"), 12, "0"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log events, with ``n`` (the event's number) and ``user_id``.

    Metadata depends on the type: keys to redact at the top level, below it, or none at all.
    """
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    metadata = (
        F.when(kind == "signup", F.concat(
            F.lit('{"email": '), quoted(F.concat(F.lit("user"), user, F.lit("@example.com"))),
            F.lit(', "plan": "basic", "user": '), user, F.lit("}")))
        .when(kind == "purchase", F.concat(
            F.lit('{"amount": '), n, F.lit(', "credit_card": '), quoted(F.concat(F.lit("4000-"), n)), F.lit("}")))
        .when(kind == "error", F.concat(
            F.lit('{"detail": {"email": "a@example.com"}, "user": '), user, F.lit("}")))
        .when(kind == "view", F.concat(F.lit('['), n, F.lit(', {"email": "b@example.com"}]')))
        .otherwise(F.col("props"))
    )
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        n.alias("n"),
        user.alias("user_id"),
        _uuid("8000", n).alias("event_id"),
        F.timestamp_micros(F.unix_micros(ts) + (n % 5) * 1_000_000).alias("received_at"),
        ts.alias("event_time"),
        F.concat(F.lit("svc-"), user % 8).alias("source"),
        kind.alias("level"),
        F.concat(kind, F.lit(" "), n).alias("message"),
        metadata.alias("metadata"),
        F.lit(False).alias("pii_redacted"),
    )


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of ``documents``, ``conversations`` and ``pages`` as log messages."""
    documents = table(spark, sf_dir, "documents").select(
        _uuid("8001", F.col("doc_id")).alias("event_id"), "source", F.col("lang").alias("level"),
        F.col("text").alias("message"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        _uuid("8002", F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"),
        F.lit("chat").alias("source"), F.col("role").alias("level"), F.col("text").alias("message"),
    )
    pages = table(spark, sf_dir, "pages").select(
        _uuid("8003", F.col("page_id")).alias("event_id"), F.col("url").alias("source"),
        F.lit("").alias("level"), F.col("html").alias("message"),
    )
    return documents.unionByName(turns).unionByName(pages)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column ``value``: every event and text as a JSON line, many of them malformed by number.

    The shapes are those the decode rules tell apart; see the matching oracle.
    """
    n = F.col("n")
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    head = F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('"'))
    time = F.concat(F.lit(',"event_time":"'), stamp, F.lit('Z"'))
    rest = F.concat(F.lit(',"source":"'), F.col("source"), F.lit('","level":"'), F.col("level"),
                    F.lit('","metadata":'), F.col("metadata"))
    message = F.concat(F.lit(',"message":"'), F.col("message"), F.lit('"'))
    good = F.concat(head, time, rest, message, F.lit("}"))
    case = n % 50
    value = (
        F.when(case == 0, F.concat(head, time, rest, message))
        .when(case == 1, F.concat(head, time, rest, F.lit(',"message":'), n, F.lit("}")))
        .when(case == 2, F.lit(""))
        .when(case == 3, F.concat(head, time, rest, F.replace(message, F.lit('"message"'), F.lit('"Message"')), F.lit("}")))
        .when(case == 4, F.concat(good, F.lit(" x")))
        .when(case == 5, F.concat(head, F.replace(time, F.lit("event_time"), F.lit("timestamp")), rest, message, F.lit("}")))
        .when(case == 6, F.concat(head, time, rest, F.lit(',"message":"old"'), message, F.lit("}")))
        .when(case == 7, F.lit("null"))
        .when(case == 8, F.concat(head, F.lit(',"event_time":"2024-13-01T00:00:00Z"'), rest, message, F.lit("}")))
        .when(case == 9, F.concat(head, F.replace(time, F.lit('Z"'), F.lit('+02:00"')), rest, message, F.lit("}")))
        .when(case == 10, F.concat(good, F.lit("]")))
        .when(case == 11, F.concat(F.lit(" "), good, F.lit("\r")))
        .when(case == 12, F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(good)
    )
    events = log_events(spark, sf_dir).select(value.alias("value"))
    texts = log_texts(spark, sf_dir).select(
        F.to_json(F.struct("event_id", "source", "level", "message")).alias("value")
    )
    return events.unionByName(texts)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events in four batches by date, signups again in batch 4 with a changed message.

    Clicks and views also give versions of one hot event, a quarter of all rows.
    """
    base = log_events(spark, sf_dir).withColumn(
        "batch_id", F.floor((F.dayofmonth("event_time") - 1) / 8).cast("long")
    ).withColumn(
        "message_id", F.struct(F.unix_millis("event_time").alias("ms"), F.col("n").alias("seq"))
    )
    again = base.where(F.col("level") == "signup").withColumn("batch_id", F.lit(4).cast("long")).withColumn(
        "message", F.concat("message", F.lit(" again"))
    )
    hot = base.where(F.col("level").isin("click", "view")).withColumn("event_id", F.lit(HOT_ID))
    return base.unionByName(again).unionByName(hot)


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as API keys: inactive when in debt, a third of them without an end."""
    number = F.col("c_custkey")
    expires = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).cast("timestamp")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("key-"), number).alias("key"),
        F.col("c_name").alias("description"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        expires.alias("created_at"),
        F.when(
            number % 3 != 0,
            F.timestamp_micros(F.unix_micros(expires) + (number % 60) * 86_400_000_000),
        ).alias("expires_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a request, as JSON, NDJSON or another type by its number."""
    n = F.col("n")
    tail = F.concat(F.lit('","metadata":'), F.col("metadata"), F.lit("}"))
    good = F.concat(F.lit('{"message":"'), F.col("message"), tail)
    # Single documents are of very different sizes.
    document = F.concat(F.lit('{"message":"'), F.repeat("message", (n % 20 + 1).cast("int")), tail)
    bad = F.concat(F.lit('{"message":'), n, F.lit("}"))
    body = (
        F.when(n % 10 >= 6, F.concat_ws("\n", good, bad, F.lit(""), F.concat(good, F.lit("\r")), good))
        .when(n % 7 == 0, bad)
        .otherwise(document)
    )
    media = (
        F.when(n % 10 <= 4, JSON_TYPE)
        .when(n % 10 == 5, f"{JSON_TYPE}; charset=utf-8")
        .when(n % 10 <= 8, NDJSON_TYPE)
        .otherwise("text/plain")
    )
    return log_events(spark, sf_dir).select(
        n.alias("request_id"),
        "received_at",
        F.when(n % 25 == 0, "GET").otherwise("POST").alias("method"),
        F.lit("/ingest").alias("path"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("remote_addr"),
        F.when(n % 20 == 1, "").otherwise(F.concat(F.lit("key-"), F.col("user_id"))).alias("api_key"),
        media.alias("content_type"),
        body.cast("binary").alias("body"),
        (n * 37 % 1000).alias("duration_ms"),
    )


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one NDJSON request, a line of text per event."""
    lines = F.transform(
        F.split("text", "\n", -1), lambda line: F.to_json(F.struct(line.alias("message")))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("key-"), F.col("doc_id") % 150).alias("api_key"),
        F.lit(NDJSON_TYPE).alias("content_type"),
        F.concat_ws("\n", lines).cast("binary").alias("body"),
    )


def log_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events as queue rows: free, or owned by one of two groups, clicks acknowledged."""
    return log_events(spark, sf_dir).select(
        F.col("event_id").alias("id"), "received_at", "event_time", "source", "level", "message", "metadata",
        F.when(F.col("n") % 3 == 1, "g1").when(F.col("n") % 3 == 2, "g2").alias("consumer_group"),
        (F.col("level") == "click").alias("acknowledged"),
        F.lit(0).alias("retry_count"),
    )


def log_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older errors, and all signups, are in the dead-letter table already."""
    failed = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")).cast("timestamp")
    older = (F.col("level") == "error") & (F.dayofmonth("event_time") <= 10)
    return log_events(spark, sf_dir).where(older | (F.col("level") == "signup")).select(
        F.col("event_id").alias("id"), failed.alias("failed_at"), F.lit("earlier").alias("reason"),
        "event_time", "source", "level", "message", "metadata",
    )


def error_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the error events, each twice."""
    ids = log_events(spark, sf_dir).where(F.col("level") == "error").select(F.col("event_id").alias("id"))
    return ids.unionByName(ids)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery state of the events, in two groups of one stream and one of another.

    Errors, or views, are pending; the rest is acknowledged on delivery.
    """
    events = log_events(spark, sf_dir)
    n = F.col("n")

    def of(rows: DataFrame, stream: str, group: str, consumers: int, count: Column, pending: str) -> DataFrame:
        return rows.select(
            F.lit(stream).alias("stream"),
            F.lit(group).alias("grp"),
            F.concat(F.lit("c"), F.col("user_id") % consumers).alias("consumer"),
            message_id(),
            F.col("event_time").alias("delivered_at"),
            count.cast("long").alias("delivery_count"),
            F.when(F.col("level") != pending, F.col("event_time")).alias("acked_at"),
        )

    return (
        of(events, STREAM, GROUP, 4, n % 3 + 1, "error")
        .unionAll(of(events.where(n % 2 == 0), STREAM, "auditors", 3, F.lit(1), "view"))
        .unionAll(of(events.where(n % 3 == 0), OTHER_STREAM, GROUP, 4, F.lit(2), "error"))
    )


def mine(deliveries: DataFrame) -> DataFrame:
    return deliveries.where((F.col("stream") == STREAM) & (F.col("grp") == GROUP))


def message_id() -> Column:
    return F.struct(
        F.unix_millis("event_time").alias("ms"), F.col("n").alias("seq")
    ).alias("message_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as entries of two streams; every eleventh payload is cut and does not decode."""
    whole = F.to_json(F.struct(
        "event_id", "event_time", "source", "level", "message", F.parse_json("metadata").alias("metadata"),
    ), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    cut = F.substring(whole, F.lit(1), F.length(whole) - 1)
    streams = F.when(F.col("n") % 3 == 0, F.array(F.lit(STREAM), F.lit(OTHER_STREAM))).otherwise(F.array(F.lit(STREAM)))
    return log_events(spark, sf_dir).select(
        F.explode(streams).alias("stream"), message_id(),
        F.when(F.col("n") % 11 == 0, cut).otherwise(whole).alias("payload"),
    )
