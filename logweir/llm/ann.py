"""Approximate nearest neighbours by cosine with learned partitions.

A sample of about ``SAMPLE`` distinct vectors, bounded whatever the corpus, gives the index: the graph of its nearest
neighbours is cut into balanced partitions, and a small network learns which partitions hold the neighbours of
a vector. Every vector is indexed: it goes to its most probable partition. A query goes to its most probable partitions
until their probabilities reach a mass, and the candidates there are scored exactly.

- The mass is measured, not chosen: on sampled vectors that the network was not trained on, it is the least one that
  reaches ``TARGET`` of their true neighbours (a target of 1 takes all partitions). So vectors without structure are searched widely, clustered ones narrowly.
- Copies of one vector have the same neighbours, so they're searched once and indexed once, with the ids of the first
  ``K + 1``: a search needs no more of them, one of which may be the query itself. Spark cuts a vector's copies down to
  these before its shuffle, so that a vector with a third of all rows is not hot.
- A crowded partition is cut into slots and its queries into blocks (``cells``). Tasks hold a block, a tile and heaps.
- The driver sees the sample, the network and counts per partition, of which there are at most ``PARTITIONS``.

Scores are computed in double precision from the original vectors, scaled by powers of two, row by row in one order, so
that equal vectors have equal scores. Defined results: rows with a NULL id or vector, a zero vector, or a
component that is NULL or not finite take no part; shorter vectors are filled up with zeros; rows that repeat an id are
rows of their own, and may find each other; where there are no more than ``K`` other rows all are found; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm import cells, partitions
from logweir.llm.cells import Heaps
from logweir.llm.components import stored

K = 5
QUERY_EVERY = 50
SAMPLE = 8_192
SAMPLE_NUMBERS = 1 << 20
NEAR = 10
HIDDEN = 128
EPOCHS = 20
TARGET = 0.95
PARTITIONS = 256
ROWS_A_TILE = 256
PAIRS = 1 << 15
# More than the rounding error of a cosine in double precision.
ROUNDING = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows with their largest component between 1/2 and 1, by a power of two, which loses nothing."""
    exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))[1]
    return np.ldexp(vectors, -exponent[:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / norms(vectors)[:, None]


class Index:
    """The network and the mass of probability that a query's partitions must have."""

    def __init__(self, sample: np.ndarray, parts: int, near: int = NEAR, target: float = TARGET, k: int = K) -> None:
        self.width, self.parts = sample.shape[1], parts
        graph = partitions.neighbours(sample, near)
        part = partitions.balanced(sample, graph, parts)
        self.router = partitions.Router(self.width, parts, HIDDEN)
        asked = np.arange(len(sample)) % 8 == 7
        if graph.shape[1] == 0 or not asked.any():
            self.mass = math.inf
            return
        self.router.train(sample[~asked], partitions.shares(part, graph, parts)[~asked], EPOCHS)
        if target >= 1:
            self.mass = math.inf
            return
        shares = self.router.probabilities(sample)
        before = partitions.mass_before(shares[asked], shares.argmax(axis=1)[graph[asked, :k]])
        self.mass = float(np.quantile(before, target, method="higher"))

    def fitted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors beyond the sample's width can't come up: the sample is filled up to the widest vector."""
        return units(cells.widened(vectors, self.width))


def _index_part(index):
    def run(batches):
        for batch in batches:
            vectors = index.value.fitted(cells.matrix(batch.column("vector")))
            part = index.value.router.probabilities(vectors).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))],
                                             [*batch.schema.names, "part"])

    return run


def _route(index, sizes, needed: int):
    """Adds ``parts``: the most probable ones up to the mass, and on until they hold as many entries as needed."""

    def run(batches):
        for batch in batches:
            vectors = index.value.fitted(cells.matrix(batch.column("vector")))
            shares = index.value.router.probabilities(vectors)
            order = np.argsort(-shares, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(shares, order, 1), axis=1) - np.take_along_axis(shares, order, 1)
            entries = np.cumsum(sizes[order], axis=1) - sizes[order]
            taken = ((before <= index.value.mass) | (entries < needed)) & (sizes[order] > 0)
            counts = taken.sum(axis=1)
            parts = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(order[taken].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "parts"])

    return run


class _Search:
    def __init__(self, asked: pa.RecordBatch) -> None:
        self.row = asked.column("row").to_numpy()
        self.vectors = scaled(cells.matrix(asked.column("vector")))
        self.norms = norms(self.vectors)
        self.heaps = Heaps(len(self.row), K + 1, np.float64)

    def feed(self, candidates: pa.RecordBatch) -> None:
        entries = candidates.column("entries")
        counts = np.diff(entries.offsets.to_numpy())
        starts = np.cumsum(counts) - counts
        flat = entries.flatten()
        ids, rows = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("id", "row"))
        theirs = scaled(cells.matrix(candidates.column("vector")))
        width = max(theirs.shape[1], self.vectors.shape[1])
        mine, theirs = cells.widened(self.vectors, width), cells.widened(theirs, width)
        their_norms = norms(theirs)
        for low in range(0, len(mine), ROWS_A_TILE):
            here = slice(low, low + ROWS_A_TILE)
            rough = mine[here] @ theirs.T / (self.norms[here, None] * their_norms)
            floor = self.heaps.floor[here]
            if rough.shape[1] > K + 1:
                floor = np.maximum(floor, np.partition(rough, -K - 1, axis=1)[:, -K - 1])
            a, b = np.nonzero(rough >= floor[:, None] - ROUNDING)
            a += low
            score = np.zeros(len(a))
            for at in range(0, len(a), PAIRS):
                x, y = a[at:at + PAIRS], b[at:at + PAIRS]
                score[at:at + PAIRS] = (mine[x] * theirs[y]).sum(axis=1) / (self.norms[x] * their_norms[y])
            each = counts[b]
            entry = np.repeat(starts[b], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            self.heaps.offer(np.repeat(a, each), np.repeat(score, each), ids[entry], rows[entry])

    def result(self) -> dict[str, np.ndarray]:
        self.heaps.settle()
        return {"asked": self.row[self.heaps.group], "score": self.heaps.score, "id": self.heaps.id,
                "row": self.heaps.row}


FOUND = "asked bigint, score double, id bigint, row bigint"


def _sampled(vectors: DataFrame, n: int, size: int) -> DataFrame:
    """About ``size`` of the n vectors, by their hashes."""
    whole = 1 << 30
    return vectors.where(F.pmod(F.xxhash64("vector"), F.lit(whole)) < min(whole, -(-whole * size // max(1, n))))


def search(rows: DataFrame, is_query: Column | None = None, target: float = TARGET) -> DataFrame:
    """The ``K`` nearest rows of each query among ``rows`` (``id``, ``vector``): ``query_id, rank, vec_id, score``."""
    spark = rows.sparkSession
    is_query = F.col("id") % QUERY_EVERY == 0 if is_query is None else is_query
    takes_part = (F.col("id").isNotNull() & cells.finite(F.col("vector"))
                  & F.exists("vector", lambda x: x != 0))
    numbered = stored(rows.where(takes_part).select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("bigint").alias("id"),
        F.col("vector").cast("array<double>").alias("vector"), is_query.alias("asked")), "ann-rows")

    first = F.row_number().over(Window.partitionBy("vector").orderBy("id", "row"))
    distinct = stored(
        numbered.withColumn("copy", first).where(F.col("copy") <= K + 1).groupBy("vector").agg(
            F.min("row").alias("row"), F.sort_array(F.collect_list(F.struct("id", "row"))).alias("entries")), "ann-vectors")
    n, entries, width = distinct.agg(
        F.count("*"), F.coalesce(F.sum(F.size("entries")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    size = max(64, min(SAMPLE, SAMPLE_NUMBERS // max(1, width)))
    sample = _sampled(distinct, n, size).select("row", "vector").toArrow().sort_by("row")
    parts = max(1, min(PARTITIONS, sample.num_rows // 16, math.isqrt(n) // 4))
    index = spark.sparkContext.broadcast(Index(
        units(cells.widened(cells.matrix(sample.column("vector")), width)) if sample.num_rows else np.zeros((1, width)),
        parts, target=target))

    indexed = stored(distinct.mapInArrow(
        _index_part(index), "vector array<double>, row bigint, entries array<struct<id bigint, row bigint>>, part int"),
        "ann-index")
    of_part = {row["part"]: row for row in indexed.groupBy("part").agg(
        F.count("*").alias("n"), F.sum(F.size("entries")).alias("entries")).collect()}  # at most PARTITIONS
    sizes = np.asarray([of_part[p]["entries"] if p in of_part else 0 for p in range(parts)], np.int64)

    asking = numbered.where("asked")
    routed = stored(asking.groupBy("vector").agg(F.min("row").alias("row")).mapInArrow(
        _route(index, sizes, K + 1), "vector array<double>, row bigint, parts array<int>"), "ann-queries")
    to_parts = routed.select("row", "vector", F.explode("parts").alias("part"))
    asked_of = {row["part"]: row["count"] for row in to_parts.groupBy("part").count().collect()}

    shape, block = [], 0
    each = max(1, spark.sparkContext.defaultParallelism // max(1, len(of_part)))
    for p in sorted(of_part):
        blocks = max(1, -(-asked_of.get(p, 0) // cells.block_rows(width)))
        shape.append((p, block, blocks, cells.slots_for(of_part[p]["n"], blocks, each)))
        block += blocks
    layout = F.broadcast(spark.createDataFrame(shape, "part int, first int, blocks int, slots int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    queries = to_parts.join(layout, "part").select(
        "row", "vector", F.lit(0).alias("kind"), (F.col("first") + dealt("blocks")).alias("block"), every("slots").alias("slot"))
    candidates = indexed.join(layout, "part").select(
        "row", "vector", "entries", F.lit(1).alias("kind"), "first", dealt("slots").alias("slot"),
        every("blocks").alias("nth")).withColumn("block", F.col("first") + F.col("nth")).drop("first", "nth")
    met = cells.by_cell(queries.unionByName(candidates, allowMissingColumns=True), sum(s[2] * s[3] for s in shape))
    found = met.mapInArrow(cells.stream(_Search, FOUND), FOUND)

    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).where(
        F.col("place") <= K + 1).drop("place")
    # Each query row beside the search of its vector, whose own entry goes.
    names = asking.select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "vector").join(
        routed.select(F.col("row").alias("asked"), "vector"), "vector").drop("vector")
    others = names.join(best, "asked").where("row != query_row")
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order)))
    return ranked.where(F.col("rank") <= K).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
