"""Landed HTTP requests as event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.scalars import MAX_BODY_BYTES, classify_media_type, within_size
from logweir.sources.files import drop_cr

# Fixed value: a line of this many bytes, or more, is over-long.
LINE_LIMIT = 65_536


def request_lines(
    requests: DataFrame, max_bytes: int = MAX_BODY_BYTES, line_limit: int | None = LINE_LIMIT
) -> DataFrame:
    """Add ``media``, ``size_ok``, ``line_ok``, ``lines`` and ``read_to`` to each request.

    ``lines`` has all payloads of the whole body: a JSON body is one, an NDJSON body one per line. The
    limits cut nothing. They are labels: ``size_ok`` and ``line_ok`` of the body, and ``read_to``, the
    number of payloads a reader that stops at the limits would have seen whole.
    """
    staged = requests.withColumn("media", classify_media_type(F.col("content_type"))).withColumn(
        "size_ok", within_size(F.col("body"), max_bytes)
    )
    text = F.coalesce(F.col("body").cast("string"), F.lit(""))
    staged = staged.withColumn(
        "lines",
        F.when(F.col("media") == "json", F.array(text))
        .when(F.col("media") == "ndjson", F.split(text, "\n", -1))
        .otherwise(F.array().cast("array<string>")),
    )
    if line_limit is None:
        long_at = F.lit(0)
    else:
        # A body below the line limit cannot hold such a line.
        long_at = F.when(
            (F.col("media") == "ndjson") & (F.octet_length("body") >= line_limit),
            F.array_position(F.transform("lines", lambda line: F.octet_length(line) >= line_limit), True),
        )
    staged = staged.withColumn("_long_at", F.coalesce(long_at, F.lit(0)).cast("int"))
    # Pieces within the size limit; the last one counts when the limit happens to fall behind it.
    within = F.split(F.substring("body", 1, max_bytes).cast("string"), "\n", -1)
    last = F.octet_length(F.try_element_at(within, F.lit(-1)))
    whole = F.size(within) - (last < F.octet_length(F.get(F.col("lines"), F.size(within) - 1))).cast("int")
    by_size = F.when(F.col("size_ok"), F.size("lines")).when(F.col("media") == "json", 0).otherwise(whole)
    by_line = F.when(F.col("_long_at") > 0, F.col("_long_at") - 1).otherwise(F.size("lines"))
    return (
        staged.withColumn("line_ok", F.col("_long_at") == 0)
        .withColumn("read_to", F.least(by_size, by_line))
        .drop("_long_at")
    )


def explode_requests(
    requests: DataFrame, max_bytes: int = MAX_BODY_BYTES, line_limit: int | None = LINE_LIMIT
) -> DataFrame:
    """One row per payload: the request's columns without the body, ``line_no``, ``raw_event``.

    Every line of every body is there; ``past_limit`` marks those beyond the limits.
    ``received_at`` becomes ``request_received_at``, as decoding brings its own.
    """
    staged = request_lines(requests, max_bytes, line_limit)
    kept = [
        F.col(c).alias("request_received_at") if c == "received_at" else F.col(c)
        for c in staged.columns
        if c not in ("body", "lines", "read_to")
    ]
    rows = staged.select(*kept, "read_to", F.posexplode("lines").alias("line_no", "raw_event"))
    rows = rows.withColumn("past_limit", F.col("line_no") >= F.col("read_to")).drop("read_to")
    rows = rows.withColumn(
        "raw_event",
        F.when(F.col("media") == "ndjson", drop_cr(F.col("raw_event"))).otherwise(F.col("raw_event")),
    )
    return rows.where((F.col("media") == "json") | (F.octet_length("raw_event") > 0))
