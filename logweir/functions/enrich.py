"""Server-side enrichment: receive time and event ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid_from(*parts: Column) -> Column:
    """UUID-shaped text from the SHA-256 of the parts: the same input gives the same id."""
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def enrich(
    events: DataFrame,
    received_at: Column | None = None,
    id_mode: str = "random",
    id_from: tuple[str, ...] = (),
) -> DataFrame:
    """Stamp ``received_at`` and fill an empty ``event_id``.

    ``id_mode="random"`` draws a UUID, which differs when a task is run again; use
    ``"deterministic"`` with the columns in ``id_from`` (file, position, payload) where the rows
    may be computed twice.
    """
    if id_mode == "random":
        fresh = F.expr("uuid()")
    elif id_mode == "deterministic":
        if not id_from:
            raise ValueError("deterministic ids need id_from columns")
        fresh = uuid_from(*[F.col(c) for c in id_from])
    else:
        raise ValueError("id_mode must be 'random' or 'deterministic'")
    stamp = F.current_timestamp() if received_at is None else received_at
    return events.withColumn("received_at", stamp).withColumn(
        "event_id", F.coalesce(F.nullif(F.col("event_id"), F.lit("")), fresh)
    )
