"""Small column functions: media type, size, durations and message ids."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted media types, their default size limit, and duration units in ns.
JSON_TYPE = "application/json"
NDJSON_TYPE = "application/x-ndjson"
MAX_BODY_BYTES = 1_048_576
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
DURATION_TERM = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"

MIN_SEQ = 0
MAX_LONG = 9_223_372_036_854_775_807

# ms * RANK_BASE + seq orders message ids as one number.
RANK_BASE = Decimal(10**19)


def classify_media_type(content_type: Column) -> Column:
    """``json``, ``ndjson`` or ``error_media_type``, by case-sensitive prefix."""
    return (
        F.when(F.startswith(content_type, F.lit(JSON_TYPE)), "json")
        .when(F.startswith(content_type, F.lit(NDJSON_TYPE)), "ndjson")
        .otherwise("error_media_type")
    )


def within_size(body: Column, max_bytes: int = MAX_BODY_BYTES) -> Column:
    """Whether the whole body is within the limit; a missing body has no bytes."""
    return F.coalesce(F.octet_length(body), F.lit(0)) <= max_bytes


def _term_nanos(number: Column, unit: Column) -> Column:
    """Whole nanoseconds of one term. Digits after the point are cut, never rounded up."""
    whole = F.coalesce(F.regexp_extract(number, r"^\d*", 0).try_cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    digits = F.substring(F.regexp_extract(number, r"\.(\d*)", 1), 1, 18)
    part = F.coalesce(digits.try_cast("double"), F.lit(0.0)) * (unit / F.pow(F.lit(10.0), F.length(digits)))
    return (whole * unit.cast("decimal(19,0)") + F.floor(part).cast("decimal(19,0)")).cast("decimal(38,0)")


def parse_duration_ms(text: Column) -> Column:
    """Whole milliseconds of a duration such as ``1h15m30.5s``; NULL when malformed or too long."""
    whole = text.rlike(rf"^[+-]?({DURATION_TERM})+\z")
    amounts = F.regexp_extract_all(text, F.lit(DURATION_TERM), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(DURATION_TERM), F.lit(2))
    table = F.create_map(*[F.lit(x) for pair in UNIT_NANOS.items() for x in pair])
    nanos = F.aggregate(
        F.zip_with(
            amounts,
            units,
            lambda n, u: _term_nanos(n, F.try_element_at(table, u)),
        ),
        F.lit(0).cast("decimal(38,0)"),
        lambda total, term: (total + term).cast("decimal(38,0)"),
    )
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    in_range = F.when(nanos <= F.lit(MAX_LONG), nanos)
    millis = F.floor(in_range / F.lit(1_000_000)).cast("long")
    return F.when(text.isin("0", "+0", "-0"), F.lit(0).cast("long")).when(whole, sign * millis)


def parse_message_id(text: Column) -> Column:
    """Struct (ms, seq) of ``ms-seq``; ``-`` is the lowest id, ``+`` the highest, ``ms`` is ``ms-0``."""
    low = F.struct(F.lit(0).cast("long").alias("ms"), F.lit(MIN_SEQ).cast("long").alias("seq"))
    high = F.struct(
        F.lit(MAX_LONG).cast("long").alias("ms"), F.lit(MAX_LONG).cast("long").alias("seq")
    )
    ms = F.split_part(text, F.lit("-"), F.lit(1)).try_cast("long")
    seq = F.when(F.contains(text, F.lit("-")), F.split_part(text, F.lit("-"), F.lit(2))).otherwise("0")
    exact = F.struct(ms.alias("ms"), seq.try_cast("long").alias("seq"))
    return (
        F.when(text == "-", low).when(text == "+", high).when(text.rlike(r"^\d+(-\d+)?\z"), exact)
    )


def message_id_text(message_id: Column) -> Column:
    return F.concat_ws("-", message_id["ms"], message_id["seq"])


def id_rank(message_id: Column) -> Column:
    """One sortable number per message id, so that min and max aggregate by hash, not by sort."""
    return (
        message_id["ms"].cast("decimal(19,0)") * F.lit(RANK_BASE).cast("decimal(20,0)")
        + message_id["seq"].cast("decimal(19,0)")
    ).cast("decimal(38,0)")


def id_from_rank(rank: Column) -> Column:
    base = F.lit(RANK_BASE).cast("decimal(20,0)")
    seq = (rank % base).cast("long")
    ms = F.floor((rank - (rank % base)) / base).cast("long")
    return F.when(rank.isNotNull(), F.struct(ms.alias("ms"), seq.alias("seq")))
