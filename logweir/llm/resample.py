"""Importance resampling towards a target distribution of hashed word runs.

A text's features are its runs of one to three consecutive words, hashed into ``BUCKETS`` buckets. A bucket's gain
is the log ratio of its share in the target texts to its share in the documents, both with one added; a
document's weight is the sum over its features, and Gumbel noise from a hash of its id turns the highest scores
into a draw without replacement.

- One pass counts the buckets: per task an array of ``BUCKETS`` numbers, summed by Spark. Only these sums and the
  gains, both of that fixed size, pass the driver.
- A second pass scores each text by the array of gains and writes the narrow table of scores with a row number.
- The cutoff is found on that table by bisection: exact counts of the rows up to a value, over the score, then over
  the ids that tie with it, then over the row numbers of repeated ids. One job answers ``LEVELS`` halvings, and
  nothing is sorted or ranked to find it.
- Only drawn rows are ranked: range partitioned by (score, id, row), which no two rows share, so that no score or
  id is hot; a rank is the place in the partition after the sizes of those before. Rows not drawn aren't moved.

Texts of any length are counted whole, in chunks. Defined results: a NULL text has no words; a NULL id counts as ''
in the noise and comes after all others in ties; rows that repeat an id are drawn one by one, ties between
them by the place at which they were read; an empty table gives an empty result, and without target texts all buckets
have a target count of 0; columns beside the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.components import stored
from logweir.llm.ngrams import runs

BUCKETS = 10_000
LONGEST = 3
PERCENT = 5
MIN_WORDS = 20
SEED = 42
LEVELS = 4
LAST_ID = (1 << 63) - 1


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for found in runs(_texts(batch), LONGEST):
            counts += np.bincount(found.sums % np.uint32(BUCKETS), minlength=BUCKETS)
    bucket = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "n": pa.array(counts[bucket])})


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """The number of features in each bucket over the column ``text``: ``BUCKETS`` numbers, whatever the input."""
    counts = np.zeros(BUCKETS, np.int64)
    found = texts.select("text").mapInArrow(_count_buckets, "bucket int, n bigint")
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.asarray([
        math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for found in runs(_texts(batch), LONGEST):
                here = slice(found.first, found.first + len(found.words))
                words[here] += found.words
                features[here] += np.bincount(found.of, minlength=len(found.words))
                # Sums of whole numbers below 2^53 are exact.
                weights[here] += np.bincount(
                    found.of, gain[found.sums % np.uint32(BUCKETS)], len(found.words)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n_words": pa.array(words), "n_features": pa.array(features),
                "weight": pa.array(weights)})

    return run


def noise(id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, from the first 32 bits of a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def cutoff(rows: DataFrame, keys: list[str], k: int) -> list[int]:
    """Bounds of the first ``k`` rows in the order of the whole-numbered ``keys``, with k at most the rows there are.

    The rows below the first bound, and those equal to it and below the second one, and so on, up to and with the last
    bound: see ``within``. Fewer bounds than keys are needed where a whole tie is taken.
    """
    bounds: list[int] = []
    tied = rows
    for key in keys:
        low, high = tied.agg(F.min(key), F.max(key)).first()  # the bound is in here
        below, upto = 0, None
        while low < high:
            middles = sorted({low + (high - low) * i // (1 << LEVELS) for i in range(1 << LEVELS)})
            counts = tied.agg(*[F.count_if(F.col(key) <= F.lit(m)) for m in middles]).first()
            enough = [(m, n) for m, n in zip(middles, counts) if n >= k]
            short = [(m, n) for m, n in zip(middles, counts) if n < k]
            if enough:
                high, upto = enough[0]
            if short:
                low, below = short[-1][0] + 1, short[-1][1]
        if upto is None:
            upto = tied.agg(F.count_if(F.col(key) <= F.lit(high))).first()[0]
        bounds.append(high)
        k -= below
        if upto - below == k:
            break
        tied = tied.where(F.col(key) == F.lit(high))
    return bounds


def within(keys: list[str], bounds: list[int]) -> Column:
    """Whether a row comes before the bounds of ``cutoff`` or on them."""
    holds = F.lit(True)
    for last, (key, bound) in enumerate(reversed(list(zip(keys, bounds)))):
        holds = (F.col(key) <= F.lit(bound)) if not last else (
            (F.col(key) < F.lit(bound)) | ((F.col(key) == F.lit(bound)) & holds))
    return holds


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``rank`` from 1 on in the order of ``keys``, none of which may be NULL."""
    order = [F.col(key) for key in keys]
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()), "resample-ranks")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    before, offsets = 0, {}
    for row in sorted(sizes):
        offsets[row["part"]] = before
        before += row["n"]
    starts = placed.sparkSession.createDataFrame(list(offsets.items()), "part int, start bigint")
    return (placed.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part")
            .withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
            .drop("part", "place", "start"))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is NULL for those not drawn.

    ``percent`` of the documents with at least ``min_words`` words are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    weighed = docs.select(F.col(id).cast("bigint").alias("id"), "text").mapInArrow(
        _weigh(gain), "id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = stored(
        weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumns({
            "descending": -F.col("score"), "tie": F.coalesce("id", F.lit(LAST_ID)),
            "row": F.monotonically_increasing_id()}), "resample-scores")
    keys = ["descending", "tie", "row"]
    long_enough = F.col("n_words") >= min_words
    n = scored.where(long_enough).count()
    names = ["id", "n_words", "n_features", "weight", "score"]
    drawn = F.lit(False)
    if k := percent * n // 100:
        drawn = long_enough & within(keys, cutoff(scored.where(long_enough), keys, k))
    rest = scored.where(~drawn).select(*names, F.lit(None).cast("bigint").alias("rank"))
    return rest.unionAll(ranked(scored.where(drawn), keys).select(*names, "rank")) if k else rest


def drawn(docs: DataFrame, resampled: DataFrame, id: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, whose id was drawn."""
    ids = resampled.where("rank IS NOT NULL").select(F.col("id").alias("drawn_id")).distinct()
    return docs.join(ids, docs[id].eqNullSafe(ids["drawn_id"]), "left_semi")
