"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import work_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``label`` (the smallest id that can be reached) for every id of the edges ``a``, ``b``.

    Each round takes the smallest label among the neighbours, then the label of that label, so the number of
    rounds grows with the logarithm of a component's width. Nothing but a count reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id"))
                .agg(F.min("label").alias("near")))
        nearest = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        pointers = labels.select(F.col("id").alias("via"), F.col("label").alias("jump"))
        labels = stored(nearest.join(pointers, "via", "left").select(
            "id", F.least("via", "jump").alias("label"), "old"), "labels")
        if labels.where("label != old").isEmpty():
            return labels.select("id", "label")
        labels = labels.select("id", "label")
