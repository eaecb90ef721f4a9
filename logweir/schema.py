"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE_ID = T.StructType(
    [T.StructField("ms", T.LongType()), T.StructField("seq", T.LongType())]
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _TS, _L, _B = T.StringType(), T.TimestampType(), T.LongType(), T.BooleanType()

LOG_EVENT = _struct(
    ("event_id", _S), ("received_at", _TS), ("event_time", _TS), ("source", _S),
    ("level", _S), ("message", _S), ("metadata", _S), ("pii_redacted", _B),
)
EVENT_COLUMNS = tuple(LOG_EVENT.fieldNames())

LOGS = _struct(
    ("event_id", _S), ("received_at", _TS), ("event_time", _TS), ("source", _S),
    ("level", _S), ("message", _S), ("metadata", _S), ("pii_redacted", _B),
)
API_KEYS = _struct(
    ("key", _S), ("description", _S), ("is_active", _B), ("created_at", _TS), ("expires_at", _TS),
)
REQUESTS = _struct(
    ("request_id", _L), ("received_at", _TS), ("method", _S), ("path", _S), ("remote_addr", _S),
    ("api_key", _S), ("content_type", _S), ("body", T.BinaryType()),
)
LOG_BUFFER = _struct(
    ("id", _S), ("received_at", _TS), ("event_time", _TS), ("source", _S), ("level", _S),
    ("message", _S), ("metadata", _S), ("consumer_group", _S), ("acknowledged", _B),
    ("retry_count", T.IntegerType()),
)
LOG_DLQ = _struct(
    ("id", _S), ("failed_at", _TS), ("reason", _S), ("event_time", _TS), ("source", _S),
    ("level", _S), ("message", _S), ("metadata", _S),
)
BUFFER = _struct(("message_id", MESSAGE_ID), ("payload", _S), ("received_at", _TS))
MESSAGES = _struct(("stream", _S), ("message_id", MESSAGE_ID), ("payload", _S))
DELIVERIES = _struct(
    ("stream", _S), ("grp", _S), ("consumer", _S), ("message_id", MESSAGE_ID),
    ("delivered_at", _TS), ("delivery_count", _L), ("acked_at", _TS),
)
