"""API-key checks and request outcomes.

The key table may be of any size: Catalyst broadcasts it while its size is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides beyond that, where AQE splits the
partition of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.decode import ERROR_PARSE, OK, parse_events
from logweir.functions.scalars import MAX_BODY_BYTES
from logweir.sources.requests import LINE_LIMIT, request_lines


def valid_key(as_of: Column | None = None) -> Column:
    """Active and not expired; a key expires at the very moment ``expires_at`` names."""
    now = F.current_timestamp() if as_of is None else as_of
    return F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def valid_keys(api_keys: DataFrame, as_of: Column | None = None) -> DataFrame:
    return api_keys.where(valid_key(as_of)).select(F.col("key").alias("api_key"))


def authenticate(requests: DataFrame, api_keys: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The requests with a valid key."""
    return requests.where(F.col("api_key") != "").join(
        valid_keys(api_keys, as_of), "api_key", "left_semi"
    )


def reject_unauthenticated(
    requests: DataFrame, api_keys: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """The other requests, with ``reason`` ``missing`` or ``invalid``."""
    given = F.coalesce(F.col("api_key"), F.lit("")) != ""
    # A blank key never matches, so that the table cannot make it valid.
    keys = valid_keys(api_keys, as_of).where(F.col("api_key") != "")
    return requests.join(keys, "api_key", "left_anti").withColumn(
        "reason", F.when(given, "invalid").otherwise("missing")
    )


def with_auth(requests: DataFrame, api_keys: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All requests, with ``authenticated``."""
    keys = valid_keys(api_keys, as_of).where(F.col("api_key") != "").distinct()
    return (
        requests.join(keys.withColumn("authenticated", F.lit(True)), "api_key", "left")
        .withColumn("authenticated", F.coalesce("authenticated", F.lit(False)))
    )


def _with_refused(rows: DataFrame, refused: DataFrame | None) -> DataFrame:
    """Rows with ``_refused``: whether the buffer refused the event of their request and line."""
    if refused is None:
        return rows.withColumn("_refused", F.lit(False))
    named = refused.select("request_id", "line_no").distinct().withColumn("_refused", F.lit(True))
    return rows.join(named, ["request_id", "line_no"], "left").withColumn("_refused", F.coalesce("_refused", F.lit(False)))


def request_outcome(
    requests: DataFrame, api_keys: DataFrame, as_of: Column | None = None,
    max_bytes: int = MAX_BODY_BYTES, line_limit: int | None = LINE_LIMIT, refused: DataFrame | None = None,
) -> DataFrame:
    """HTTP ``status`` and ``label`` of each request; the first rule broken decides.

    Bad NDJSON lines do not fail their request. Only bodies that get that far are decoded. ``refused`` names
    events, by ``request_id`` and ``line_no``, that the buffer did not take: a JSON request fails with its event.
    """
    staged = request_lines(with_auth(requests, api_keys, as_of), max_bytes, line_limit)
    admitted = (F.col("method") == "POST") & F.col("authenticated")
    document = F.when(admitted & (F.col("media") == "json"), F.try_element_at("lines", F.lit(1)))
    kept = [c for c in requests.columns if c not in ("body", "received_at")]
    judged = parse_events(
        staged.select(
            *kept, F.col("received_at").alias("request_received_at"),
            F.octet_length("body").alias("body_bytes"),
            "authenticated", "media", "size_ok", "line_ok", document.alias("raw_event"),
        )
    )
    judged = _with_refused(judged.withColumn("line_no", F.lit(0)), refused)
    rules = [
        (F.col("method") != "POST", 405, "method_not_allowed"),
        (~F.col("authenticated"), 401, "unauthorized"),
        (F.col("media") == "error_media_type", 415, "error_media_type"),
        ((F.col("media") == "ndjson") & ~F.col("line_ok"), 400, "error_line"),
        (~F.col("size_ok"), 413, "error_size"),
        ((F.col("media") == "json") & (F.col("parse_status") != OK), 400, ERROR_PARSE),
        ((F.col("media") == "json") & F.col("_refused"), 400, "error_buffer"),
    ]
    status, label = F.lit(202), F.lit("accepted")
    for broken, code, name in reversed(rules):
        status = F.when(broken, code).otherwise(status)
        label = F.when(broken, name).otherwise(label)
    return judged.select(
        *kept, "request_received_at", "body_bytes", "authenticated", "media",
        status.alias("status"), label.alias("label"),
    )


def ingest_rows(
    requests: DataFrame, api_keys: DataFrame, as_of: Column | None = None,
    max_bytes: int = MAX_BODY_BYTES, line_limit: int | None = LINE_LIMIT, refused: DataFrame | None = None,
) -> DataFrame:
    """Decoded payloads of admitted requests plus one row per request-level error.

    ``event_status`` is ``accepted``, ``error_parse``, ``error_size``, ``error_media_type``, ``error_buffer`` for
    events in ``refused`` (``request_id``, ``line_no``), which the buffer did not take, or, for
    good lines of an NDJSON request that ended in an error, ``uncounted``: those are ingested, but
    no counter has them. Lines past the limits are decoded like all others, under ``past_limit``.
    """
    admitted = authenticate(requests.where(F.col("method") == "POST"), api_keys, as_of)
    staged = request_lines(admitted, max_bytes, line_limit)
    request_error = F.when(F.col("media") == "error_media_type", "error_media_type").when(
        ~F.col("size_ok") & F.col("line_ok"), "error_size"
    )
    entry = F.filter(
        F.transform("lines", lambda line, i: F.struct(
            F.lit(None).cast("string").alias("request_error"), line.alias("raw"), (i >= F.col("read_to")).alias("past"),
            i.alias("line_no"))),
        lambda x: (F.col("media") == "json") | ~x["raw"].isin("", "\r"),
    )
    error_entry = F.when(
        request_error.isNotNull(),
        F.array(F.struct(request_error.alias("request_error"), F.lit(None).cast("string").alias("raw"),
                         F.lit(False).alias("past"), F.lit(-1).alias("line_no"))),
    ).otherwise(F.array().cast("array<struct<request_error:string,raw:string,past:boolean,line_no:int>>"))
    rows = staged.select(
        "request_id", "media", (F.col("size_ok") & F.col("line_ok")).alias("finished"),
        F.explode(F.concat(entry, error_entry)).alias("entry"),
    ).select("request_id", "media", "finished", "entry.request_error", F.col("entry.raw").alias("raw_event"), "entry.past",
             "entry.line_no")
    # A trailing carriage return is blank space to JSON, so lines need no trimming here.
    return _with_refused(parse_events(rows), refused).withColumn(
        "event_status",
        F.when(F.col("request_error").isNotNull(), F.col("request_error"))
        .when(F.col("past"), "past_limit")
        .when(F.col("parse_status") != OK, ERROR_PARSE)
        .when(F.col("_refused"), "error_buffer")
        .when(F.col("finished"), "accepted")
        .otherwise("uncounted"),
    )
