"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Each document has a number of tokens (an end token included). What exceeds the largest capacity is cut into
full sequences of that length; the remainder is packed. Remainders are dealt at random over shards of about
``SHARD_DOCS`` documents, so memory and time of a task do not grow with the corpus, and each shard packs its
own, longest first:

- a remainder goes to the open bin that it fills best (the smallest free space that still fits);
- if none fits, the capacity with the least cost per usable token is opened. A bin of capacity c costs
  ``c + OVERHEAD``; usable are the remainder itself and what is still to come that would fit beside it, so
  large bins are opened while there is enough to fill them and small ones towards the end;
- when all is placed, each bin shrinks to the smallest capacity that holds its contents.

Defined results: a document without tokens is not packed and gives no row; repeated rows and ids are packed
one by one; NULL ids are kept as NULL; ties in length are packed by id; an empty table gives an empty result;
only the id and the token count are read, so extra columns never clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.text import words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
SHARD_DOCS = 40_000
SCHEMA = "doc_id bigint, piece int, start bigint, n_tokens bigint, bin_id bigint, capacity int, bin_offset int"


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD):
    """Bin, offset in the bin, and the bins' final capacities, for lengths sorted from long to short."""
    lengths = np.asarray(lengths, dtype=np.int64)
    capacities = sorted(capacities)
    later = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])  # tokens from this one on
    ascending = lengths[::-1]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled: list[int] = []
    room: dict[int, list[int]] = {}
    spaces: list[int] = []  # the sorted keys of room

    def opened(i: int, length: int) -> int:
        def cost(c: int) -> float:
            first = max(i + 1, len(lengths) - int(np.searchsorted(ascending, c - length, "right")))
            return (c + overhead) / min(c, length + int(later[min(first, len(lengths))]))

        return min((c for c in capacities if c >= length), key=cost)

    for i, length in enumerate(lengths.tolist()):
        at = bisect_left(spaces, length)
        if at < len(spaces):
            space = spaces[at]
            k = room[space].pop()
            if not room[space]:
                del room[space], spaces[at]
        else:
            space, k = opened(i, length), len(filled)
            filled.append(0)
        bins[i], offsets[i] = k, filled[k]
        filled[k] += length
        if left := space - length:
            if left not in room:
                room[left] = []
                insort(spaces, left)
            room[left].append(k)
    final = np.asarray(capacities)[np.searchsorted(capacities, filled)] if filled else np.zeros(0, np.int64)
    return bins, offsets, final


def _pack_shard(capacities: tuple[int, ...], overhead: int):
    largest = max(capacities)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rest", "p_id"], ascending=[False, True], kind="stable", na_position="first")
        shard = int(rows["p_shard"].iloc[0])
        n, rest = rows["p_tokens"].to_numpy(np.int64), rows["rest"].to_numpy(np.int64)
        ids, full = rows["p_id"], n // largest
        some = rest > 0
        bins, offsets, final = best_fit(rest[some], capacities, overhead)
        whole = np.repeat(np.arange(len(rows)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        parts = [
            pd.DataFrame({"doc_id": ids[some], "piece": full[some], "start": full[some] * largest,
                          "n_tokens": rest[some], "bin_id": bins, "capacity": final[bins], "bin_offset": offsets}),
            pd.DataFrame({"doc_id": ids.iloc[whole], "piece": piece, "start": piece * largest, "n_tokens": largest,
                          "bin_id": len(final) + np.arange(len(whole)), "capacity": largest, "bin_offset": 0}),
        ]
        packed = pd.concat([part for part in parts if len(part)] or parts)
        packed["bin_id"] += shard << 32
        return packed

    return pack


def count_tokens(text: Column) -> Column:
    """Words of the text and one end token."""
    return F.size(words(text)) + 1


def pack(docs: DataFrame, tokens: Column, id: str = "doc_id", capacities: Sequence[int] = CAPACITIES,
         overhead: int = OVERHEAD, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: the token range of its document, its bin, the bin's capacity, its place in the bin."""
    capacities = tuple(sorted(capacities))
    shards = max(1, -(-docs.count() // shard_docs))
    # Rows are dealt by their place in the input, not by id: one id may hold a third of them.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    rows = docs.select(F.col(id).cast("bigint").alias("p_id"), tokens.cast("bigint").alias("p_tokens"))
    rows = rows.where("p_tokens > 0").select(
        "*", (F.col("p_tokens") % capacities[-1]).alias("rest"), shard.alias("p_shard"))
    return rows.groupBy("p_shard").applyInPandas(_pack_shard(capacities, overhead), SCHEMA)
