"""Metadata as VARIANT: parsed once, filtered by path and redacted without going through text again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.redact import PLACEHOLDER, parse_redaction_fields

# Values that aren't objects stand in a column of their own: Spark writes the keys that most objects share as columns
# (shredding), from which a filter on a path reads just its own, but only where all values are objects.
OTHER = "_other"


def with_variant(events: DataFrame, column: str = "metadata") -> DataFrame:
    """The events with the objects of ``column`` parsed, and its other values in ``<column>_other``.

    What is not JSON is NULL in both.
    """
    value = F.try_parse_json(column)
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT<"))
    return events.withColumns({column: F.when(is_object, value), f"{column}{OTHER}": F.when(~is_object, value)})


def whole(column: str = "metadata") -> Column:
    """The value as it was given, whichever column it stands in."""
    return F.coalesce(F.col(column), F.col(f"{column}{OTHER}"))


def at_path(variant: Column, path: str, kind: str) -> Column:
    """The value at a path like ``$.user``, or NULL where it is missing or of another kind."""
    return F.try_variant_get(variant, path, kind)


def redact_variant(events: DataFrame, fields: list[str] | None = None, column: str = "metadata") -> DataFrame:
    """``redact`` for a VARIANT column: masks the fields at the top level and sets ``pii_redacted``.

    What is not an object, or has none of the fields, stays as it is. Nested fields stay.
    """
    names = F.array(*[F.lit(name) for name in (parse_redaction_fields() if fields is None else fields)])
    entries = F.try_variant_get(F.col(column), "$", "map<string,variant>")
    hit = F.coalesce(F.arrays_overlap(F.map_keys(entries), names), F.lit(False))
    masked = F.transform_values(
        entries, lambda key, value: F.when(F.array_contains(names, key), F.lit(PLACEHOLDER).cast("variant")).otherwise(value))
    return events.withColumns({
        column: F.when(hit, F.to_variant_object(masked)).otherwise(F.col(column)), "pii_redacted": hit})
