"""PII redaction of top-level metadata keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.decode import objects_sql, one_value_sql

# The placeholder and the fields redacted unless configured otherwise.
PLACEHOLDER = "[REDACTED]"
DEFAULT_FIELDS = "email,password,credit_card,ssn"


def parse_redaction_fields(csv: str = DEFAULT_FIELDS) -> list[str]:
    """Field names of a comma-separated setting. Blanks are part of a name."""
    return csv.split(",")


def redact(events: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Replace the value of each top-level ``metadata`` key in ``fields`` and flag the event.

    Metadata that is no JSON object, or has no such key, is left as it is. A key can only be there
    when its text is, or when the text has an escape, so all other rows skip the JSON parse. A suspect
    text that cannot be read as JSON is never passed on: all of it is replaced, and the event flagged.
    """
    if fields is None:
        fields = parse_redaction_fields()
    columns = events.columns
    if "pii_redacted" not in columns:
        events = events.withColumn("pii_redacted", F.lit(False))
        columns = events.columns
    if not fields:
        return events
    metadata = F.col("metadata")
    needles = [F.contains(metadata, F.lit(field)) for field in fields]
    suspect = reduce(lambda a, b: a | b, needles, F.contains(metadata, F.lit("\\")))
    names = F.array(*[F.lit(field) for field in fields])
    staged = events.withColumn("_suspect", F.coalesce(suspect, F.lit(False)))
    staged = staged.withColumn("_docs", F.expr(f"CASE WHEN _suspect THEN {objects_sql('metadata')} END"))
    # The same text must be one value both as an array element and as a member.
    staged = staged.withColumn("_valid", F.expr(f"CASE WHEN _suspect THEN coalesce({one_value_sql('metadata')}, false) END"))
    staged = staged.withColumn("_object", F.when((F.size("_docs") == 1) & F.col("_valid"), F.try_element_at("_docs", F.lit(1))))
    staged = staged.withColumn("_hit", F.coalesce(F.arrays_overlap(F.map_keys("_object"), names), F.lit(False)))
    unread = F.col("_suspect") & ~F.col("_valid")
    placeholder = F.parse_json(F.lit(f'"{PLACEHOLDER}"'))
    cleaned = F.to_json(
        F.transform_values(
            "_object",
            lambda key, value: F.when(F.array_contains(names, key), placeholder).otherwise(value),
        )
    )
    replaced = {
        "metadata": F.when(F.col("_hit"), cleaned).when(unread, F.lit(f'"{PLACEHOLDER}"')).otherwise(metadata),
        "pii_redacted": F.col("_hit") | unread | F.coalesce(F.col("pii_redacted"), F.lit(False)),
    }
    return staged.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in columns])
