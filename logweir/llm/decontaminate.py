"""Benchmark items inside documents, also with edits: CGK embedding, bit sampling, exact edit distance.

Texts are compared in lower case with every run of other ASCII characters than letters and digits as one space.
An item is found in a document when a stretch of it has an edit distance of at most ``MAX_EDITS`` of the item's
length (both in UTF-8 bytes).

1. Places: an item that may take d edits is cut into d + 1 pieces of some 6 bytes; edits within the bound leave a
   piece whole (only short items have smaller ones). Every byte place of a document is looked up among the
   pieces. A find goes on when its neighbour piece stands beside it with at most one edit, and when the group of
   up to ``GROUP`` pieces around it stands there with fewer edits than it has pieces. If all finds of an item failed
   one of these tests, each group would hold as many edits as pieces, so no stretch within the bound is lost, wherever
   its edits lie and whether or not the text has spaces.
2. CGK: a random walk reads window and item, at each step staying on a character or going on, as a random bit of
   (step, character) says. Strings of small edit distance fall into step again, so their walks agree in most
   coordinates: edit distance became Hamming distance.
3. Bit sampling: from each of ``WALKS`` walks ``SAMPLES`` samples of ``BITS`` coordinates; a window goes on when one
   of its samples equals the item's. That takes some 99 of 100 windows with as many edits as the bound allows, all of
   those with two thirds of them, and turns away more than 95 of 100 unrelated ones (measured in the tests).
   Items of fewer than ``SHORT`` bytes have too few coordinates to tell, so their windows all go on.
4. The edit distance of the item to the best stretch near the window is computed exactly (bit-parallel).

The items are the query set and are broadcast in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents per block; documents are read in place, without a shuffle, and a task holds one Arrow batch.

Defined results: NULL and empty texts contain nothing; an item without letters or digits is in no document; short
items are searched for like all others, those of fewer than 7 bytes as they are; repeated rows and items are reported one by one; an empty table gives an empty result; only the ids and texts
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.shingles import CHUNK

MAX_EDITS = 0.15
SHORT = 12
WALKS = 32
SAMPLES = 96
BITS = 6
PIECE = 6
GROUP = 8
PAD = 64
CLASSES = 64
BLOCK_BYTES = 16 << 20
GATE_BITS = 22
BATCH = 512
FINDS = 1 << 18
# Filters may take two bytes for one: letters and digits have a class each, bytes beyond ASCII share the others.
KIND = np.asarray([b".abcdefghijklmnopqrstuvwxyz0123456789 ".find(c) % CLASSES if c < 128 else 38 + c % 25 for c in range(256)])
FOLD = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(FOLD).split())


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another with zeros around them, and where each begins."""
    lengths = np.asarray([len(text) + PAD for text in texts], np.int64)
    return np.frombuffer(bytes(PAD) + bytes(PAD).join(texts) + bytes(PAD), np.uint8), PAD + np.cumsum(lengths) - lengths


def packed(text: np.ndarray, at: np.ndarray | slice, size) -> np.ndarray:
    """The bytes of the text from each place on, up to 7, as one number."""
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    return words[at] & ((np.uint64(1) << np.asarray(8 * size, np.uint64)) - np.uint64(1))


class Items:
    """A block of benchmark items, indexed by their pieces."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        self.ids, self.texts = np.asarray(ids, np.int64), texts
        self.lengths = np.asarray([len(text) for text in texts], np.int64)
        self.edits = (self.lengths * MAX_EDITS).astype(np.int64)
        self.text, self.base = joined(texts)
        pieces: list[tuple[int, ...]] = []  # key size, item, place, next place, neighbour's place and size, group
        groups: list[tuple[int, int, int, int]] = []  # item, place, size, edits
        for item, (size, edits) in enumerate(zip(self.lengths.tolist(), self.edits.tolist())):
            if not size:
                continue
            n = edits + 1
            cuts = [size * k // n for k in range(n + 1)]
            pairs = -(-n // 2)
            parts = -(-n // GROUP)
            ends = [min(n, 2 * (pairs * (k + 1) // parts)) for k in range(parts)]
            for low, high in zip([0, *ends], ends):
                groups.append((item, cuts[low], cuts[high] - cuts[low], high - low - 1))
                for k in range(low, high):
                    other = k ^ 1 if k ^ 1 < n else k
                    pieces.append((min(PIECE, size // n), item, cuts[k], cuts[k + 1], cuts[other],
                                   cuts[other + 1] - cuts[other], len(groups) - 1))
        table = np.asarray(pieces, np.int64).reshape(-1, 7)
        keys = packed(self.text, self.base[table[:, 1]] + table[:, 2], table[:, 0])
        order = np.lexsort((keys, table[:, 0]))
        self.keys = keys[order]
        self.sizes, self.of, self.at, self.stop, self.other, self.other_size, self.group = table[order].T
        self.bounds = {int(q): np.searchsorted(self.sizes, [q, q + 1]) for q in np.unique(self.sizes)}
        self.gates = {}
        for q, (low, high) in self.bounds.items():
            self.gates[q] = np.zeros(1 << GATE_BITS, bool)
            self.gates[q][self.slot(self.keys[low:high])] = True
        self.group_item, self.group_at, self.group_size, self.group_edits = np.asarray(groups, np.int64).reshape(-1, 4).T
        self.masks = np.zeros((len(groups), CLASSES), np.uint64)
        for k in range(int(self.group_size.max(initial=0))):
            own = np.flatnonzero(k < self.group_size)
            kind = KIND[self.text[self.base[self.group_item[own]] + self.group_at[own] + k]]
            self.masks[own, kind] |= np.uint64(1 << k)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GATE_BITS)).astype(np.int64)

    def beside(self, text: np.ndarray, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the neighbour may stand beside the piece with one edit: the half that has none is where it can be."""
        size, right = self.other_size[piece], self.other[piece] > self.at[piece]
        start = at + self.other[piece] - self.at[piece]
        own = self.base[self.of[piece]] + self.other[piece]
        half = size // 2
        near, far = np.where(right, 0, half), np.where(right, half, 0)
        near_size, far_size = np.where(right, half, size - half), np.where(right, size - half, half)
        good = packed(self.text, own + near, near_size) == packed(text, start + near, near_size)
        wanted = packed(self.text, own + far, far_size)
        for shift in (-1, 0, 1):
            good |= wanted == packed(text, start + far + shift, far_size)
        return good | (self.other[piece] == self.at[piece])

    def around(self, text: np.ndarray, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the piece's group stands around it with fewer edits than it has pieces (Myers, 1999, in one word)."""
        group = self.group[piece]
        size, edits = self.group_size[group].astype(np.uint64), self.group_edits[group]
        start = at + self.group_at[group] - self.at[piece] - edits
        one = np.uint64(1)
        last, score = one << (size - one), self.group_size[group].copy()
        up, down = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        best = score.copy()
        for k in range(int((self.group_size[group] + 2 * edits).max(initial=0))):
            mask = self.masks[group, KIND[text[np.clip(start + k, 0, len(text) - 1)]]]
            cross = mask | down
            flat = (((mask & up) + up) ^ up) | mask
            rise, fall = down | ~(flat | up), up & flat
            score += ((rise & last) != 0).astype(np.int64) - ((fall & last) != 0)
            rise, fall = rise << one, fall << one
            up, down = fall | ~(cross | rise), rise & cross
            np.minimum(best, score, out=best)
        return best <= edits

    def places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first byte of the window), one per stretch that the allowed edits can tell apart."""
        text, base = joined(texts)
        codes = packed(text, slice(PAD, len(text) - PAD), PIECE)
        none = np.zeros(0, np.int64)
        found = [(none, none)]
        for q, (low, high) in self.bounds.items():
            keys = codes & np.uint64((1 << 8 * q) - 1)
            maybe = np.flatnonzero(self.gates[q][self.slot(keys)])
            known, runs = np.unique(self.keys[low:high], return_counts=True)
            slot = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
            same = known[slot] == keys[maybe]
            maybe, slot = maybe[same], slot[same]
            last = np.cumsum(runs)[slot]
            first = last - runs[slot]
            # Some texts hold a common piece very often: the finds are tested a bounded number at a time.
            steps = np.cumsum(last - first)
            cut = 0
            while cut < len(maybe):
                done = steps[cut - 1] if cut else 0
                stop = max(cut + 1, int(np.searchsorted(steps, done + FINDS, "right")))
                times = (last - first)[cut:stop]
                at = PAD + np.repeat(maybe[cut:stop], times)
                piece = low + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[cut:stop], times)
                good = self.beside(text, at, piece)
                at, piece = at[good], piece[good]
                good = self.around(text, at, piece)
                found.append((at[good], piece[good]))
                cut = stop
        at, piece = (np.concatenate(part) for part in zip(*found))
        of = np.searchsorted(base, at, "right") - 1
        item, start = self.of[piece], at - base[of] - self.at[piece]
        # Of an item without edits one place in a text says it all.
        cell = np.where(self.edits[item] > 0, np.floor_divide(start, self.edits[item] + 1), 0)
        _, first = np.unique(np.stack([of, item, cell]), axis=1, return_index=True)
        return of[first], item[first], start[first]


def walks(strings: list[bytes], steps: int) -> np.ndarray:
    """The CGK walks of the strings, [step, string, walk]; the random bits are the same in every task."""
    bits = np.random.default_rng(7).integers(0, 2, (steps, WALKS * 256), np.int32)
    width = max(map(len, strings)) + 1
    table = np.zeros((len(strings), width), np.uint8)
    for k, string in enumerate(strings):
        table[k, :len(string)] = np.frombuffer(string, np.uint8)
    table, base = table.ravel(), (np.arange(len(strings), dtype=np.int32) * width)[:, None]
    last = base + width - 1
    place = np.repeat(base, WALKS, axis=1)
    walk = np.arange(WALKS, dtype=np.int32)[None] * 256
    out = np.empty((steps, len(strings), WALKS), np.uint8)
    for step in range(steps):
        char = table.take(place, out=out[step])
        place += bits[step].take(walk + char)
        np.minimum(place, last, out=place)
    return out


def alike(windows: list[bytes], items: list[bytes]) -> np.ndarray:
    """Whether window and item agree on all coordinates of some sample of some walk."""
    distinct = list(dict.fromkeys(items))
    number = {item: len(windows) + k for k, item in enumerate(distinct)}
    sizes = np.asarray([len(item) for item in items], np.int64)
    embedded = walks(windows + distinct, 2 * int(sizes.max()))
    spots = np.random.default_rng(11).random((WALKS, SAMPLES, BITS))
    step = (spots[None] * 2 * sizes[:, None, None, None]).astype(np.int64)
    walk = np.arange(WALKS)[None, :, None, None]
    own = np.arange(len(windows))[:, None, None, None]
    other = np.asarray([number[item] for item in items])[:, None, None, None]
    return (embedded[step, own, walk] == embedded[step, other, walk]).all(axis=3).any(axis=(1, 2))


def nearest(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the item to a stretch of the text, and where the stretch ends (Myers, 1999)."""
    masks: dict[int, int] = {}
    for k, char in enumerate(item):
        masks[char] = masks.get(char, 0) | 1 << k
    size = len(item)
    last, full = 1 << size - 1, (1 << size) - 1
    up, down, score = full, 0, size
    best, end = size, 0
    for k, char in enumerate(text):
        mask = masks.get(char, 0)
        cross = mask | down
        flat = (((mask & up) + up) ^ up) | mask
        rise = down | ~(flat | up) & full
        fall = up & flat
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up = fall | ~(cross | rise) & full
        down = rise & cross
        if score < best:
            best, end = score, k + 1
    return best, end


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    held: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        held.append(normal(text))
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _searched(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = items.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for first, texts in _grouped(batch.column("text").to_pylist()):
                of, item, start = known.places(texts)
                by_size = np.argsort(known.lengths[item], kind="stable")  # strings of a batch walk equally far
                for low in range(0, len(of), BATCH):
                    part = by_size[low:low + BATCH]
                    windows = [texts[of[k]][max(0, start[k]):max(0, start[k]) + len(known.texts[item[k]])] for k in part]
                    passed = known.lengths[item[part]] < SHORT
                    if (tested := np.flatnonzero(~passed)).size:
                        passed[tested] = alike([windows[k] for k in tested], [known.texts[item[part[k]]] for k in tested])
                    for k, good in zip(part, passed):
                        pattern, slack = known.texts[item[k]], int(known.edits[item[k]])
                        if good:
                            begin = max(0, start[k] - 2 * slack)
                            edits, end = nearest(pattern, texts[of[k]][begin:start[k] + len(pattern) + 2 * slack])
                            key = first + int(of[k]), int(item[k])
                            if edits <= slack and (edits, begin + end) < best.get(key, (slack + 1, 0)):
                                best[key] = edits, int(begin + end)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[row] for row, _ in best], pa.int64()),
                "item_id": pa.array([int(known.ids[k]) for _, k in best], pa.int64()),
                "item_bytes": pa.array([len(known.texts[k]) for _, k in best], pa.int64()),
                "edits": pa.array([edits for edits, _ in best.values()], pa.int64())})

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row and item found in it, with the item's length and the edits of the best stretch."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    found = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Items([row["item_id"] for row in own], [normal(row["text"]) for row in own]))
        found.append(rows.mapInArrow(_searched(index), "doc_id bigint, item_id bigint, item_bytes bigint, edits bigint"))
    union = found[0]
    for part in found[1:]:
        union = union.unionAll(part)
    return union


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found; the ids to drop are few and joined, not collected."""
    leaked = find_items(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id"]), "left_anti")
