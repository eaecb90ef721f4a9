"""Asked vectors beside candidate vectors, cell by cell, without a join.

Asked rows are dealt into blocks of a bounded size, candidates into slots. A cell is a block and a slot: one shuffle
brings the rows of a cell together, sorted so that its asked rows come first, and a task streams the candidates
past them in tiles. A task holds one block, one tile and the best pairs so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers in a block of asked vectors and in a tile of candidates.
BLOCK_NUMBERS = 1 << 18
TILE = 512
# Candidates that share one copy of a block.
SLOT_ROWS = 1 << 16
WAITING = 1 << 16


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as one row per vector; shorter vectors get zeros at their end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    widest = max(width, int(lengths.max(initial=0)))
    if len(lengths) and lengths.min() == widest:
        return values.reshape(len(lengths), widest)
    rows = np.zeros((len(lengths), widest), values.dtype)
    at = np.repeat(np.arange(len(lengths)), lengths)
    rows[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return rows


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def block_rows(width: int) -> int:
    return max(16, BLOCK_NUMBERS // max(1, width))


def slots_for(rows: int, blocks: int, parallel: int) -> int:
    """Enough slots that no task gets many candidates and that all cores have cells, without copying blocks more."""
    return max(1, -(-rows // SLOT_ROWS), min(-(-rows // TILE), -(-2 * parallel // max(1, blocks))))


def spread(asked: DataFrame, candidates: DataFrame, blocks: int, slots: int) -> DataFrame:
    """Both with ``block``, ``slot`` and ``kind`` (0 asked, 1 candidate), by cells; the rows need a unique ``row``."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    a = asked.withColumns({"kind": F.lit(0), "block": dealt(blocks)}).withColumn("slot", every(slots))
    b = candidates.withColumns({"kind": F.lit(1), "slot": dealt(slots)}).withColumn("block", every(blocks))
    return by_cell(a.unionByName(b, allowMissingColumns=True), blocks * slots)


def by_cell(rows: DataFrame, cells: int) -> DataFrame:
    spark = rows.sparkSession
    parts = min(max(1, cells), max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells // 8))
    return rows.repartition(parts, "block", "slot").sortWithinPartitions("block", "slot", "kind")


def stream(open_cell: Callable, out: str) -> Callable:
    """For ``mapInArrow``: ``open_cell(asked)`` gives an object with ``feed(candidates)`` and ``result()``.

    ``asked`` and each tile of ``candidates`` are record batches; ``result`` is one, with the columns of ``out``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key, asked = None, None, []
        for batch in batches:
            block, slot, kind = (batch.column(name).to_numpy() for name in ("block", "slot", "kind"))
            edges = np.flatnonzero(np.diff(block, prepend=-1) | np.diff(slot, prepend=-1) | np.diff(kind, prepend=-1))
            if not len(edges) or edges[0]:
                edges = np.concatenate([[0], edges])
            for low, high in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                if low == high:
                    continue
                if key != (here := (int(block[low]), int(slot[low]))):
                    if cell is not None:
                        yield from _out(cell.result(), out)
                    cell, key, asked = None, here, []
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    asked.append(part)
                    continue
                if cell is None:
                    if not asked:
                        continue
                    cell = open_cell(pa.Table.from_batches(asked).combine_chunks().to_batches()[0])
                for at in range(0, part.num_rows, TILE):
                    cell.feed(part.slice(at, TILE))
        if cell is not None:
            yield from _out(cell.result(), out)

    return run


def _out(columns: dict[str, np.ndarray], out: str) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in out.split(",")]
    if len(columns[names[0]]):
        yield pa.RecordBatch.from_arrays([pa.array(columns[name]) for name in names], names)


@dataclass
class Heaps:
    """The best entries of many groups: higher scores first, then smaller ids, then smaller rows; ``size`` of each.

    Heaps of other tiles, tasks or cells merge by the same order, so it doesn't matter where an entry was met.
    """

    groups: int
    size: int
    score_type: type = np.int64

    def __post_init__(self) -> None:
        self.group = np.zeros(0, np.int64)
        self.score = np.zeros(0, self.score_type)
        self.id, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lowest = np.iinfo(np.int64).min if self.score_type is np.int64 else -np.inf
        #: Entries below it can't get in any more.
        self.floor = np.full(self.groups, lowest, self.score_type)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.offered = 0

    def offer(self, group: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        """Entries wait until there are as many as the heaps hold, so that a merge is paid for by what it takes in."""
        self.waiting.append((group, score, id, row))
        self.offered += len(group)
        if self.offered > max(WAITING, len(self.group)):
            self.settle()

    def settle(self) -> None:
        if not self.offered:
            return
        group, score, id, row = (np.concatenate(part) for part in zip(
            (self.group, self.score, self.id, self.row), *self.waiting))
        self.waiting, self.offered = [], 0
        order = np.lexsort((row, id, -score, group))
        group = group[order]
        first = np.searchsorted(group, group)  # where each entry's group begins
        place = np.arange(len(group)) - first
        kept = place < self.size
        last = place == self.size - 1
        self.floor[group[last]] = score[order][last]
        order = order[kept]
        self.group, self.score, self.id, self.row = group[kept], score[order], id[order], row[order]
