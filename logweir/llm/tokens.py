"""Token ids as files: static range asymmetric numeral system (rANS) over shared frequency tables.

1. Documents are range partitioned and sorted by id, tokenized in place and cut into blocks of about
   ``BLOCK_IDS`` ids that hold whole documents. The blocks' ids go to a work table (16-bit numbers, so the
   vocabulary has to have at most 65,536 ids) and all of them are counted.
2. The counts make one frequency table of sum 2^``SCALE_BITS`` (every id has at least one slot). Its size is
   that of the id space, so it is broadcast.
3. Each block is coded on its own by interleaved coders: id i belongs to lane i mod lanes, and all lanes take
   a step at once as one numpy operation. Every ``CHECKPOINT`` steps the block notes the coders' states and the
   place in the word stream, so that a reader can start there.
4. A file is a Parquet table with one row per block: partition, number, ids before it in its partition, the
   documents' ids and lengths, final states, words, checkpoints, CRC-32 of the ids and of the coded bytes.
   Partitions are in document order, so the place of a block in the whole file follows from one sum per
   partition, and blocks are decoded in parallel in any order.

Reading checks both checksums and raises on damage. Tasks hold one block at a time (a document longer than a
block is a block of its own); text crosses the network once and ids never do.

Defined results: NULL text is empty and has the end id only; a NULL document id sorts first and is read back
as NULL; rows that repeat an id stay next to each other; an empty table gives an empty file and no rows; only
the id and the text are read, so extra columns never clash.
"""

from __future__ import annotations

import array
import os
import re
import string
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.session import work_dir

END_ID = 2
SCALE_BITS = 20
LANES = 4096  # at most; short blocks have fewer
STEPS = 256
BLOCK_IDS = 1 << 20
CHECKPOINT = 64
LOW = 1 << 31
CACHE = 1_000_000
TOGETHER = 1 << 22
RUNS = 256
NO_ID = -(2**63)
HEAD = "part int, block int, within bigint, n_ids bigint, doc_ids binary, doc_lengths binary"
WORK_SCHEMA = f"{HEAD}, ids binary"
BLOCK_SCHEMA = (f"{HEAD}, lanes int, states binary, words binary, checkpoints binary, "
                "ids_crc32 bigint, coded_crc32 bigint")


# --- tokenizing ------------------------------------------------------------------------------------------


BLANK, LETTER, MARK = 1, 2, 3


def _kinds() -> np.ndarray:
    """What each code point is, as far as runs need it: letters of Latin, Greek and Cyrillic, ASCII punctuation without the apostrophe."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(0x3001):
        c = chr(code)
        kinds[code] = BLANK if c.isspace() else LETTER if code < 0x530 and c.isalpha() else 0
    kinds[[ord(c) for c in string.punctuation if c != "'"]] = MARK
    return kinds


class Encoder:
    """Byte-level BPE ids of texts, with a bounded cache for what texts repeat.

    Texts are cut into runs at places where the tokenizer always splits, so that a run has the same ids alone: before
    a space that a visible character follows, around a line end between visible characters, and where letters and
    ASCII punctuation meet (but not behind an apostrophe, for contractions). Runs not seen before are encoded together,
    with a special token between them, which parts whatever stands beside it. Texts that hold special tokens
    themselves go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(token.content) for token in added.values()) or "(?!)")
        # The token between runs; without one each run is encoded on its own.
        self.mark, self.mark_text = next(
            ((n, t.content) for n, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), (None, ""))
        self.kinds = _kinds()
        # Two generations: runs that the young one lacks are taken over from the old one, or learned.
        self.runs: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array.array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        if self.mark is None:
            return {run: self._whole(run) for run in runs}
        found = {}
        parts = [runs[low:low + RUNS] for low in range(0, len(runs), RUNS)]
        coded = self.tokenizer.encode_batch_fast([self.mark_text.join(part) for part in parts], add_special_tokens=False)
        for part, encoding in zip(parts, coded):
            ids = np.asarray(encoding.ids, "<u2")
            data = ids.tobytes()
            ends = [*(2 * np.flatnonzero(ids == self.mark)).tolist(), len(data)]
            if len(ends) == len(part):
                found.update(zip(part, [data[start:end] for start, end in zip([0, *[end + 2 for end in ends]], ends)]))
            else:
                found.update((run, self._whole(run)) for run in part)
        return found

    def _known(self, runs: list[str]) -> list[bytes]:
        """Ids of runs, each listed once."""
        if len(self.runs) > CACHE // 2:
            self.old, self.runs = self.runs, {}
        found = list(map(self.runs.get, runs))
        new = [run for run, ids in zip(runs, found) if ids is None]
        kept = {run: self.old[run] for run in new if run in self.old}
        kept |= self._learn([run for run in new if run not in kept])
        self.runs |= kept
        return [kept[run] if ids is None else ids for run, ids in zip(runs, found)]

    def _cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a run starts at each code point."""
        kinds = self.kinds[codes]
        visible, letter, mark = kinds != BLANK, kinds == LETTER, kinds == MARK
        cuts = np.zeros(len(codes), bool)
        cuts[:-1] = (codes[:-1] == ord(" ")) & visible[1:]
        lines = 1 + np.flatnonzero((codes[1:-1] == ord("\n")) & visible[:-2] & visible[2:])
        cuts[lines] = cuts[lines + 1] = True
        cuts[1:] |= letter[:-1] & (mark[1:] | (codes[1:] == ord("'"))) | mark[:-1] & letter[1:]
        return cuts

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens. Behind each stands a line end, as a run that has no ids."""
        joined = "\n".join([*texts, ""])
        data, codes = joined.encode(), np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts))) - 1
        cuts = self._cuts(codes)
        cuts[ends] = cuts[0] = True
        cuts[ends[:-1] + 1] = True
        at = np.flatnonzero(cuts)
        behind = np.searchsorted(at, ends)
        if len(data) > len(codes):
            more = (codes >= 0x80).view(np.uint8) + (codes >= 0x800) + (codes >= 0x10000)
            at = at + np.cumsum(more, dtype=np.int64)[at] - more[at]
        offsets = np.append(at, len(data)).astype(np.int32)
        runs = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known = self._known(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        places = runs.indices.to_numpy().copy()
        places[behind] = len(known)
        ids = pa.array([*known, b""], pa.large_binary()).take(pa.array(places))
        _, starts, data = ids.buffers()
        stops = np.frombuffer(starts, np.int64)[behind].tolist()
        whole = memoryview(data or b"")
        return [whole[start:stop].tobytes() for start, stop in zip([0, *stops], stops)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What no text before them had is learned for all of them at once."""
        special = {k for k, text in enumerate(texts) if self.special.search(text)}
        plain = [text for k, text in enumerate(texts) if k not in special]
        found = iter(self._plain(plain) if plain else ())
        return [self._whole(text) if k in special else next(found) for k, text in enumerate(texts)]

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker: what it learned in one task serves the next ones."""
    return Encoder(path)


def _together(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts, in lists of little more than ``TOGETHER`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > TOGETHER:
            yield held
            held, size = [], 0
    yield held


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path).encode
        end = np.asarray([end_id], dtype="<u2").tobytes()
        part, block, within, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []
        docs: list[int] = []

        def close() -> pd.DataFrame:
            lengths = np.asarray([len(x) // 2 for x in held], "<i8")
            row = pd.DataFrame([{
                "part": part, "block": block, "within": within, "n_ids": size, "doc_lengths": lengths.tobytes(),
                "doc_ids": np.asarray(docs, "<i8").tobytes(), "ids": squeeze(b"".join(held))}])
            held.clear()
            docs.clear()
            return row

        for batch in batches:
            texts = _together(text or "" for text in batch["text"])
            for doc, ids in zip(batch["doc_id"], chain.from_iterable(map(encode, texts))):
                ids += end
                if size and size + len(ids) // 2 > BLOCK_IDS:
                    yield close()
                    block, within, size = block + 1, within + size, 0
                held.append(ids)
                docs.append(doc)
                size += len(ids) // 2
        if size:
            yield close()

    return run


def squeeze(ids: bytes) -> bytes:
    """16-bit ids with low and high bytes apart, which compresses better."""
    return zstandard.compress(np.frombuffer(ids, np.uint8).reshape(-1, 2).T.tobytes(), 3)


def expand(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, -1).T.tobytes(), "<u2")


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of token ids in ascending document order."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInPandas(_blocks(path, end_id), WORK_SCHEMA)


# --- frequencies -----------------------------------------------------------------------------------------


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for data in batch["ids"]:
            total += np.bincount(expand(data), minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"id": seen, "n": total[seen]})


def count_ids(blocks: DataFrame) -> np.ndarray:
    """Occurrences of each of the 65,536 possible ids; at most one row per id reaches the driver."""
    counts = blocks.select("ids").mapInPandas(_counted, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    total = np.zeros(1 << 16, np.int64)
    total[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total


def frequencies(counts: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Slots per id: proportional to its count, at least one, 2^scale_bits in all."""
    size = 1 << scale_bits
    spare = size - len(counts)
    share = counts.astype(np.float64) * (spare / max(1, counts.sum()))
    slots = np.floor(share).astype(np.int64)
    rest = spare - int(slots.sum())
    slots[np.argsort(-(share - slots), kind="stable")[:rest % len(counts)]] += 1
    slots[np.argmax(slots)] += rest - rest % len(counts)
    return (slots + 1).astype(np.uint64)


# --- coding ----------------------------------------------------------------------------------------------


class Coder:
    """Interleaved rANS with 64-bit states and 32-bit words."""

    def __init__(self, slots: np.ndarray, scale_bits: int = SCALE_BITS) -> None:
        self.bits = np.uint64(scale_bits)
        self.mask = np.uint64((1 << scale_bits) - 1)
        self.slots = slots.astype(np.uint64)
        self.starts = (np.cumsum(slots) - slots).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(slots), dtype=np.uint32), slots.astype(np.int64))
        self.limit = self.slots << np.uint64(63 - scale_bits)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States to start from, words in reading order, checkpoints (place in the words, then the states)."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        chunks: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        for step in range(steps - 1, -1, -1):
            now = ids[step * lanes:(step + 1) * lanes]
            x = state[:len(now)]
            over = x >= self.limit[now]
            if over.any():
                out = x[over]
                chunks.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(out)
                x[over] = out >> np.uint64(32)
            slots = self.slots[now]
            high = x // slots
            state[:len(now)] = (high << self.bits) + (x - high * slots) + self.starts[now]
            if step and step % CHECKPOINT == 0:
                marks.append((written, state.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        table = [np.concatenate([[np.uint64(written - at)], saved]) for at, saved in reversed(marks)]
        return state, words, np.concatenate(table) if table else np.zeros(0, np.uint64)

    def decode(self, n: int, lanes: int, states: np.ndarray, words: np.ndarray, checkpoints: np.ndarray,
               first_step: int = 0, last_step: int | None = None) -> np.ndarray:
        """Ids of the steps from ``first_step`` (0 or a checkpoint) up to ``last_step``."""
        steps = -(-n // lanes)
        last_step = steps if last_step is None else min(last_step, steps)
        at, state = 0, states.copy()
        if first_step:
            mark = checkpoints.reshape(-1, lanes + 1)[first_step // CHECKPOINT - 1]
            at, state = int(mark[0]), mark[1:].copy()
        ids = np.empty(max(0, min(n, last_step * lanes) - first_step * lanes), np.uint32)
        for step in range(first_step, last_step):
            size = min(lanes, n - step * lanes)
            x = state[:size]
            slot = x & self.mask
            now = self.of_slot[slot]
            ids[(step - first_step) * lanes:(step - first_step) * lanes + size] = now
            x = self.slots[now] * (x >> self.bits) + slot - self.starts[now]
            under = np.flatnonzero(x < np.uint64(LOW))
            if len(under):
                x[under] = (x[under] << np.uint64(32)) | words[at:at + len(under)]
                at += len(under)
            state[:size] = x
        return ids


def _encoded(slots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(slots.value)
        for batch in batches:
            for row in batch.to_dict("records"):
                ids = expand(row.pop("ids"))
                lanes = min(LANES, max(1, len(ids) // STEPS))
                states, words, marks = (part.tobytes() for part in coder.encode(ids, lanes))
                yield pd.DataFrame([row | {
                    "lanes": lanes, "states": states, "words": words, "checkpoints": marks,
                    "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "coded_crc32": zlib.crc32(states + words + marks)}])

    return run


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Tokenize the documents and code them in ascending document order into the folder."""
    spark = docs.sparkSession
    work = work_dir(spark, "token-blocks")
    tokenize(docs, tokenizer, end_id).write.parquet(work, compression="uncompressed")
    blocks = spark.read.parquet(work)
    slots = frequencies(count_ids(blocks))
    coded = blocks.mapInPandas(_encoded(spark.sparkContext.broadcast(slots)), BLOCK_SCHEMA)
    coded.write.parquet(f"{path}/blocks", compression="uncompressed")
    table = pd.DataFrame({"id": np.arange(len(slots)), "slots": slots.astype(np.int64)})
    spark.createDataFrame(table, "id int, slots bigint").coalesce(1).write.parquet(f"{path}/frequencies")


def _decoded(slots, take):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(slots.value)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if zlib.crc32(row.states + row.words + row.checkpoints) != row.coded_crc32:
                    raise ValueError(f"block {row.part}/{row.block} is damaged")
                ids = coder.decode(row.n_ids, row.lanes, np.frombuffer(row.states, "<u8"),
                                   np.frombuffer(row.words, "<u4"), np.frombuffer(row.checkpoints, "<u8"))
                data = ids.astype("<u4").tobytes()
                if zlib.crc32(data) != row.ids_crc32:
                    raise ValueError(f"block {row.part}/{row.block} does not give its ids back")
                lengths = np.frombuffer(row.doc_lengths, "<i8")
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "doc_id": np.frombuffer(row.doc_ids, "<i8"), "start": row.base + row.within + ends - lengths,
                    "n_tokens": lengths,
                    "taken": [take(data[4 * (end - n):4 * end]) for end, n in zip(ends.tolist(), lengths.tolist())]})

    return run


def read(spark: SparkSession, path: str, take=bytes, kind: str = "binary") -> DataFrame:
    """Documents of the file: ``doc_id``, ``start`` over the whole file, ``n_tokens`` and ``taken``.

    ``take`` makes ``taken`` of type ``kind`` from a document's ids as little-endian 32-bit numbers.
    """
    stored = spark.read.parquet(f"{path}/frequencies").orderBy("id").toPandas()
    slots = spark.sparkContext.broadcast(stored["slots"].to_numpy(np.uint64))
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per partition of the writer: their number, not the corpus, bounds this list.
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    bases = spark.createDataFrame(pd.DataFrame({
        "part": sums["part"].astype("int32"), "base": (sums["n"].cumsum() - sums["n"]).astype("int64")}), "part int, base bigint")
    placed = blocks.join(F.broadcast(bases), "part")
    found = placed.mapInPandas(_decoded(slots, take), f"doc_id bigint, start bigint, n_tokens bigint, taken {kind}")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
