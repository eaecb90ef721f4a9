"""Hard negatives: rows of other labels whose score lies in a window below that of an anchor's positives.

Components become whole numbers, so every score is an exact integer inner product. Anchors and candidates meet in
cells (``cells``): a tile of scores is the product of an anchor tile and a candidate tile by Strassen's recursion
over int64, with a row or column of zeros where a side is odd. Sums and products wrap around modulo 2^64 in
between, which cancels out as long as the results fit.

1. Cells of all anchors and all rows: heaps of the best rows of the anchor's label, per cell, merged by Spark.
2. The same cells again, with the score window of each positive: heaps of the best rows of other labels inside it.

All anchors meet all rows, in blocks; that is the task. A candidate is copied once for each ``BLOCK_NUMBERS`` of the
anchors' numbers, and only heaps leave the tasks.

Defined results: rows with a NULL id, label, vector or component, or a component that isn't finite, take no part;
vectors of different lengths are filled up with zeros, empty ones score 0; rows that repeat an id are rows of
their own, each with its own anchor, positive or negative places; an anchor without positives, or a positive without
rows in its window, has no rows; an empty table gives an empty result; other columns are not read. Numbers so large
that a score may not be exact (beyond 2^56) are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm import cells
from logweir.llm.cells import Heaps
from logweir.llm.components import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
ANCHOR_EVERY = 100
LEAF = 16
ANCHORS = 256  # rows of an anchor tile
EXACT = 1 << 56


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices by seven products of halves, down to sides of ``LEAF``."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    diagonal = strassen(a11 + a22, b11 + b22)
    lower = strassen(a21 + a22, b11)
    right = strassen(a11, b12 - b22)
    left = strassen(a22, b21 - b11)
    upper = strassen(a11 + a12, b22)
    outer = strassen(a21 - a11, b11 + b12)
    far = strassen(a12 - a22, b21 + b22)
    product = np.empty((2 * r, 2 * c), np.int64)
    product[:r, :c] = diagonal + left - upper + far
    product[:r, c:] = right + upper
    product[r:, :c] = lower + left
    product[r:, c:] = diagonal - lower + right + outer
    return product[:rows, :columns]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both, exact."""
    width = max(a.shape[1], b.shape[1])
    if not width or not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if width * largest[0] * largest[1] >= EXACT:
        raise ValueError("vector components too large for exact scores in 64 bits")
    return strassen(cells.widened(a, width), np.ascontiguousarray(cells.widened(b, width).T))


class _Cell:
    def __init__(self, asked: pa.RecordBatch) -> None:
        column = lambda name: asked.column(name).to_numpy(zero_copy_only=False)
        self.row, self.id, self.label = column("row"), column("id"), column("label")
        self.vectors = cells.matrix(asked.column("vector"))

    def tiles(self, candidates: pa.RecordBatch):
        """Per anchor tile: its first anchor, whether the labels agree, whether it is another row, the scores."""
        self.at = [candidates.column(name).to_numpy() for name in ("id", "row")]
        label, vectors = candidates.column("label").to_numpy(), cells.matrix(candidates.column("vector"))
        for low in range(0, len(self.row), ANCHORS):
            here = slice(low, low + ANCHORS)
            yield (low, self.label[here, None] == label, self.row[here, None] != self.at[1],
                   scores(self.vectors[here], vectors))

    def offer(self, heaps: Heaps, groups: np.ndarray, fits: np.ndarray, score: np.ndarray) -> None:
        """``groups``: the heap of each row of ``fits``, which tells the entries to offer."""
        fits &= score >= heaps.floor[groups][:, None]
        a, b = np.nonzero(fits)
        if len(a):
            heaps.offer(groups[a], score[a, b], self.at[0][b], self.at[1][b])


class _Positives(_Cell):
    def __init__(self, asked: pa.RecordBatch) -> None:
        super().__init__(asked)
        self.heaps = Heaps(len(self.row), POSITIVES)

    def feed(self, candidates: pa.RecordBatch) -> None:
        for low, same, other, score in self.tiles(candidates):
            self.offer(self.heaps, np.arange(low, low + len(score)), same & other, score)

    def result(self) -> dict[str, np.ndarray]:
        heaps = self.heaps
        heaps.settle()
        return {"row": self.row[heaps.group], "positive_row": heaps.row, "positive_id": heaps.id,
                "positive_score": heaps.score}


class _Negatives(_Cell):
    def __init__(self, asked: pa.RecordBatch) -> None:
        super().__init__(asked)
        self.heaps = Heaps(POSITIVES * len(self.row), NEGATIVES)
        found = asked.column("positives")
        counts = np.diff(found.offsets.to_numpy())
        of = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = found.flatten()
        shape = (len(counts), POSITIVES)
        self.positive = {}
        for name in ("positive_row", "positive_id", "positive_score"):
            self.positive[name] = np.zeros(shape, np.int64)
            self.positive[name][of, place] = flat.field(name).to_numpy(zero_copy_only=False)
        score = self.positive["positive_score"]
        self.low, self.high = -(-LOW * score // 100), HIGH * score // 100
        self.high[np.arange(POSITIVES) >= counts[:, None]] = np.iinfo(np.int64).min
        self.low[np.arange(POSITIVES) >= counts[:, None]] = np.iinfo(np.int64).max

    def feed(self, candidates: pa.RecordBatch) -> None:
        for first, same, _, score in self.tiles(candidates):
            here = slice(first, first + len(score))
            for k in range(POSITIVES):
                inside = ~same & (score >= self.low[here, k, None]) & (score <= self.high[here, k, None])
                self.offer(self.heaps, np.arange(first, first + len(score)) * POSITIVES + k, inside, score)

    def result(self) -> dict[str, np.ndarray]:
        heaps = self.heaps
        heaps.settle()
        anchor, k = heaps.group // POSITIVES, heaps.group % POSITIVES
        return {"row": self.row[anchor], "anchor_id": self.id[anchor],
                **{name: values[anchor, k] for name, values in self.positive.items()},
                "negative_row": heaps.row, "negative_id": heaps.id, "negative_score": heaps.score}


FOUND_POSITIVES = "row bigint, positive_row bigint, positive_id bigint, positive_score bigint"
FOUND_NEGATIVES = ("row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_score bigint, "
                   "negative_row bigint, negative_id bigint, negative_score bigint")


def shifted_label(id: Column, label: Column) -> Column:
    """The label, or the next one of ten where the id is divisible by 7."""
    return F.when(id % 7 == 0, (label + 1) % 10).otherwise(label)


def mine(rows: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (``id``, ``label``, ``vector``); a score is an integer product.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    is_anchor = F.col("id") % ANCHOR_EVERY == 0 if is_anchor is None else is_anchor
    whole = F.transform(F.col("vector").cast("array<double>"), lambda x: F.floor(SCALE * x).cast("bigint"))
    takes_part = F.col("id").isNotNull() & F.col("label").isNotNull() & cells.finite(F.col("vector"))
    numbered = stored(rows.where(takes_part).select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("bigint").alias("id"),
        F.col("label").cast("bigint").alias("label"), whole.alias("vector"), is_anchor.alias("anchor")), "negatives")
    anchors, candidates = numbered.where("anchor").drop("anchor"), numbered.drop("anchor")
    n, n_anchors, width = numbered.agg(
        F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n_anchors // cells.block_rows(width)))
    slots = cells.slots_for(n, blocks, rows.sparkSession.sparkContext.defaultParallelism)

    def best(found: DataFrame, keys: list[str], kind: str, size: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(f"{kind}_score"), f"{kind}_id", f"{kind}_row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)

    met = cells.spread(anchors, candidates, blocks, slots).mapInArrow(
        cells.stream(_Positives, FOUND_POSITIVES), FOUND_POSITIVES)
    positives = best(met, ["row"], "positive", POSITIVES).groupBy("row").agg(
        F.collect_list(F.struct("positive_row", "positive_id", "positive_score")).alias("positives"))
    asked = stored(anchors.join(positives, "row"), "negatives-asked")
    met = cells.spread(asked, candidates, blocks, slots).mapInArrow(
        cells.stream(_Negatives, FOUND_NEGATIVES), FOUND_NEGATIVES)
    return best(met, ["row", "positive_row"], "negative", NEGATIVES).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
