"""Hourly sketches that merge: latency quantiles, distinct consumers and distinct message ids.

A sketch has a bounded size whatever it has seen, so hours can be kept and rolled up to any coarser group without
reading their rows again. Errors: ``RANK_ERROR`` of a quantile's rank, ``DISTINCT_ERROR`` of a count of ids, both at
more than 99 % confidence; groups smaller than a sketch's size are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# KLL keeps some K values: a rank is off by 1 % at most.
K = 400
RANK_ERROR = 0.01
# Of HLL 2^12 registers, of Theta 2^14 hashes: three standard errors.
LOG_REGISTERS = 12
LOG_HASHES = 14
DISTINCT_ERROR = 0.025


def _hour(column: str):
    return F.date_trunc("hour", F.col(column)).alias("hour")


def latency_sketches(requests: DataFrame, time: str = "request_received_at") -> DataFrame:
    """Per hour, method, path and status: requests and a sketch of ``duration_ms``."""
    return requests.groupBy(_hour(time), "method", "path", "status").agg(
        F.count("*").alias("requests"), F.kll_sketch_agg_bigint("duration_ms", F.lit(K)).alias("durations"))


def latency_rollup(
    sketches: DataFrame, by: tuple[str, ...] = ("method", "path", "status"), percentiles: tuple[float, ...] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """Requests and percentiles of the duration of each group, from the sketches of its hours alone."""
    merged = sketches.groupBy(*by).agg(
        F.sum("requests").alias("requests"), F.kll_merge_agg_bigint("durations", F.lit(K)).alias("durations"))
    return merged.select(*by, "requests", *[
        F.kll_sketch_get_quantile_bigint("durations", F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in percentiles])


def delivery_sketches(deliveries: DataFrame) -> DataFrame:
    """Per hour, stream and group: sketches of the consumers and of the message ids that were delivered."""
    id = F.concat_ws("-", "message_id.ms", "message_id.seq")
    return deliveries.groupBy(_hour("delivered_at"), "stream", "grp").agg(
        F.hll_sketch_agg("consumer", F.lit(LOG_REGISTERS)).alias("consumers"),
        F.theta_sketch_agg(id, F.lit(LOG_HASHES)).alias("ids"))


def distinct_deliveries(sketches: DataFrame, by: tuple[str, ...] = ("stream", "grp")) -> DataFrame:
    """Distinct consumers and message ids of each group over all its hours."""
    return sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("consumers")).alias("consumers"),
        F.theta_sketch_estimate(F.theta_union_agg("ids", F.lit(LOG_HASHES))).alias("ids"))


def ids_in_both(sketches: DataFrame, a: dict[str, str], b: dict[str, str]) -> DataFrame:
    """``ids``: how many message ids two groups have in common; ``a`` and ``b`` give the columns that name them."""
    def union(named: dict[str, str], name: str) -> DataFrame:
        rows = sketches
        for column, value in named.items():
            rows = rows.where(F.col(column) == value)
        return rows.agg(F.theta_union_agg("ids", F.lit(LOG_HASHES)).alias(name))

    both = union(a, "a").join(F.broadcast(union(b, "b")))  # one row each
    return both.select(F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("ids"))
