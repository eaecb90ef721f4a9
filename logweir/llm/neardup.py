"""Near-duplicate groups of documents by HyperMinHash, confirmed on whole shingle sets.

Two documents are linked when their sets of five-word shingles have a Jaccard similarity of at least
``PERCENT`` / 100; a group is a connected component of links.

1. One pass over the texts makes, per document, the size of its set, a 128-bit fingerprint of the set, and
   ``REGISTERS`` compressed registers: the shingles fall into buckets by hash, and of the smallest hash of a
   bucket only the number of leading zeros and ``MANTISSA`` further bits are kept (16 bits, 0 for empty).
2. Documents with equal fingerprints and sizes are one class, represented by its smallest id. Groups of exact
   copies, however large, are one row from here on.
3. ``BANDS`` bands of ``ROWS`` registers, empty ones filled from others, hash representatives into buckets. At the threshold a pair is missed
   by all bands with a chance of (1 - 0.85^8)^48 = 2e-7, and less above it.
4. Star: every member of a bucket is compared with the bucket's smallest id. A pair is dropped when the sizes
   alone exclude the threshold, or when the Jaccard estimate from the registers, corrected for registers that
   agree by chance, lies ``SIGMAS`` standard deviations below it; the rest is verified on full sets. Components of
   the verified links label the documents.
5. Rest: documents in buckets that still hold several labels (without the bucket's smallest id, which is done)
   are compared by prefix: with all shingles in one fixed order, linked sets share a shingle among the first
   n - ceil(0.85 n) + 1 of each. The order puts shingles that many of these documents share last, so that a
   passage in thousands of documents, or an unlinked crowd around one text, makes no candidates. Documents that
   share a prefix shingle are split into classes of similar size, as linked sets differ by 1 - 1 / 0.85 at most: a
   class is compared with itself and with the next one. Large classes are cut into blocks of ``BLOCK`` members,
   and each pair of blocks is one small cell that checks all pairs of different labels like step 4 and returns
   only links that join two groups, so nothing is emitted per pair. This step misses no pair.

The shingles that the order puts last are those found to be shared with at least 1 / ``MAX_COMMON`` of all such
finds, so at most MAX_COMMON of them are broadcast, whatever the corpus. Any order gives the same links.

Sets hold 64-bit shingle hashes; two different shingles of a pair of documents collide with a chance of about
n^2 / 2^64. Nothing grows on the driver: it sees one count per round of the component search.

Defined results: NULL, empty and blank texts have no shingles, are linked with nothing and stay; texts with
fewer than five words have one shingle, the sequence itself; rows that repeat an id are one document whose rows
all get its group; a NULL id is kept apart from all other ids and gets a NULL group id; an empty table gives an
empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.components import components, stored
from logweir.llm.shingles import PLACES, grouped, mix, shingle_sets

PERCENT = 85
BANDS = 48
ROWS = 8
REGISTERS = BANDS * ROWS
MANTISSA = 10
SIGMAS = 5.0
BLOCK = 128
BLOCK_BYTES = 4 << 20
MAX_COMMON = 1 << 20
NO_ID = -(2**63)
CLASS = ["f1", "f2", "n"]


# --- registers -------------------------------------------------------------------------------------------


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash of a sorted set: leading zeros and mantissa of each bucket's smallest hash, plus one."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(REGISTERS)))
        least = np.minimum.reduceat(mix(shingles ^ PLACES[0]), first)
        fraction, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
        zeros = np.minimum(64 - exponent, 62)
        out[bucket[first].astype(np.int64)] = (zeros << MANTISSA) + ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64) + 1
    return out


def densified(table: np.ndarray) -> np.ndarray:
    """The registers with each empty one filled from the first full one on a walk of its own.

    A short text fills few buckets. Filled up, all registers of two sets agree with a chance near their
    similarity, so that a band is as selective for short texts as for long ones. The walk of a register, a
    sequence of random buckets, is the same for all texts; rows that are empty as a whole stay so.
    """
    table = table.copy()
    walk = np.random.default_rng(3)
    rows, places = np.nonzero((table == 0) & table.any(axis=1)[:, None])
    full = table.copy()
    while len(rows):
        source = walk.integers(0, REGISTERS, REGISTERS)[places]
        found = full[rows, source]
        table[rows, places] = found
        rows, places = rows[found == 0], places[found == 0]
    return table


def band_keys(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) for each band, of registers with one row per document."""
    halves = np.ascontiguousarray(densified(table)).view(np.uint64).reshape(len(table), BANDS, 2)
    keys = mix(halves[:, :, 0] * PLACES[1] + mix(halves[:, :, 1] * PLACES[2] + np.arange(BANDS, dtype=np.uint64)))
    doc, band = np.nonzero(halves.any(axis=2))
    return doc, keys[doc, band]


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, and the number of buckets each rests on.

    Registers of two unrelated sets agree by chance when their minima fall into the same cell. With x and y
    shingles per bucket that has the probability 0.72 * 2^-MANTISSA * x * y / (x + y)^2: the minima meet at
    density x * y * exp(-(x + y) t), and a cell at t is on average 0.72 * 2^-MANTISSA * t wide.
    """
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    agree = ((a == b) & (a != 0)).sum(axis=-1) / np.maximum(used, 1)
    chance = 0.72 * 2.0**-MANTISSA * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2
    return (agree - chance) / (1 - chance), used


def plausible(a: np.ndarray, b: np.ndarray, n_a, n_b, percent: int) -> np.ndarray:
    """Whether the sizes and the estimate leave room for the threshold."""
    least = percent / 100
    close = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    guess, used = estimate(a, b, n_a, n_b)
    return close & (guess + SIGMAS * np.sqrt(least * (1 - least) / np.maximum(used, 1)) >= least)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The contract's test on two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return 100 * shared >= percent * (len(a) + len(b) - shared) and shared > 0


def _column(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    values = batch.column(name).to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes, f1, f2, rows = batch.column("text").to_pylist(), [], [], [], []
        for _, group in grouped(texts):
            for shingles in shingle_sets(group):
                sizes.append(len(shingles))
                f1.append(mix(shingles * PLACES[3]).sum(dtype=np.uint64))
                f2.append(mix(shingles + PLACES[4]).sum(dtype=np.uint64))
                rows.append(registers(shingles).tobytes())
        yield pa.RecordBatch.from_pydict({
            "id": batch.column("id"), "n": pa.array(sizes, pa.int64()),
            "f1": pa.array(np.asarray(f1, np.uint64).view(np.int64)), "f2": pa.array(np.asarray(f2, np.uint64).view(np.int64)),
            "registers": pa.array(rows, pa.binary())})


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            doc, keys = band_keys(_column(part, "registers", np.uint16))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys.view(np.int64)), "id": part.column("id").take(pa.array(doc)),
                "n": part.column("n").take(pa.array(doc))})


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles.tobytes() for _, group in grouped(batch.column("text").to_pylist()) for shingles in shingle_sets(group)]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "shingles": pa.array(sets, pa.binary())})


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("n_a", "n_b"))
            keep = plausible(_column(batch, "r_a", np.uint16), _column(batch, "r_b", np.uint16), n_a, n_b, percent) \
                if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_pydict({name: batch.column(name).filter(pa.array(keep)) for name in ("a", "b")})

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                    for a, b in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist())]
            yield pa.RecordBatch.from_pydict({name: batch.column(name).filter(pa.array(keep, pa.bool_())) for name in ("a", "b")})

    return run


def _shared_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several sets of a batch have; the order may be any, so those of few sets need no count."""
    for batch in batches:
        data = batch.column("shingles").to_pylist()
        found, counts = np.unique(np.frombuffer(b"".join(data), np.uint64), return_counts=True)
        found, counts = found[counts > 1], counts[counts > 1]
        yield pa.RecordBatch.from_pydict({"key": pa.array(found.view(np.int64)), "n": pa.array(counts.astype(np.int64))})


def prefix(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the fixed order: all others by hash, then the common ones by rank.

    ``common`` is sorted; ``ranks`` are above 0.
    """
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, ranks[at], 0)
    return shingles[np.argsort(rank, kind="stable")[:size]]


def _prefixes(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, ranks = shared.value
        for batch in batches:
            sets = [np.frombuffer(data, np.uint64) for data in batch.column("shingles").to_pylist()]
            first = [prefix(shingles, common, ranks, percent) for shingles in sets]
            row = np.repeat(np.arange(len(sets)), [len(part) for part in first])
            keys = np.concatenate(first) if first else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys.view(np.int64)), "id": batch.column("id").take(pa.array(row)),
                "n": pa.array(np.asarray([len(shingles) for shingles in sets], np.int64)[row])})

    return run


CELL = ["key", "cell", "i", "j"]


def _joining(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links of one cell that join groups not joined before.

    The rows are the own class first, then the next larger one (``upper``), whose members are not compared among
    themselves. Cells of two different blocks leave pairs inside a block to the cell of that block alone.
    """
    i, j = rows[0]["i"], rows[0]["j"]
    sets = [np.frombuffer(row["shingles"], np.uint64) for row in rows]
    table = np.stack([registers(shingles) for shingles in sets])
    sizes = np.asarray([len(shingles) for shingles in sets], np.float64)
    group = np.asarray([row["label"] for row in rows])
    block, upper = np.asarray([row["block"] for row in rows]), np.asarray([row["upper"] for row in rows])
    found = []
    for k, row in enumerate(rows):
        if upper[k]:
            continue
        later = np.arange(len(rows)) > k
        # Of two different blocks each member of the own class meets all of the other block, once.
        others = (block != block[k]) & (upper | later) if i != j else later
        others = np.flatnonzero(others & (group != group[k]))
        if len(others):
            others = others[plausible(table[k], table[others], sizes[k], sizes[others], percent)]
        for other in others:
            if group[other] != group[k] and linked(sets[k], sets[other], percent):
                found.append((row["id"], rows[other]["id"]))
                group[group == group[other]] = group[k]
    return found


def _cells(percent: int):
    """Cells come by sorted: one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(rows: list[dict]) -> pa.RecordBatch:
            links = _joining(rows, percent)
            return pa.RecordBatch.from_pydict({name: pa.array([link[k] for link in links], pa.int64())
                                               for k, name in enumerate(("a", "b"))})

        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[name] != held[0][name] for name in CELL):
                    yield links_of(held)
                    held = []
                held.append(row)
        if held:
            yield links_of(held)

    return run


# --- the plan --------------------------------------------------------------------------------------------


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly, so that the next join has exchanges of its own and Spark can split hot keys there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle sets of the named documents, written once."""
    needed = texts.join(ids, "id", "left_semi").mapInArrow(_as_sets, "id bigint, shingles binary")
    return stored(needed, "shingles")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b"))
    return both.select("a", "b", "s_a", "s_b").mapInArrow(_verified(percent), "a bigint, b bigint")


def _star(members: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Verified links of bucket members with the smallest id of their bucket."""
    close = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = members.where((F.col("id") != F.col("hub")) & close).select(
        F.col("hub").alias("a"), F.col("id").alias("b")).distinct()

    def side(name: str) -> DataFrame:
        return reps.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    likely = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
                    .mapInArrow(_plausible(percent), "a bigint, b bigint"), "pairs")
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    return stored(_verify(likely, _sets(texts, ids), percent), "links")


def _rest(members: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between groups whose members share a bucket, found by prefixes, block by block."""

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))

    waiting = labelled(members.where("id != hub"))
    mixed = waiting.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    sets = _sets(texts, waiting.join(_spread(mixed.select("key")), "key").select("id").distinct())
    counts = stored(sets.mapInArrow(_shared_shingles, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") * MAX_COMMON >= total).toPandas().sort_values("n", kind="stable")
    keys = common["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = texts.sparkSession.sparkContext.broadcast((keys[order], np.arange(1, len(keys) + 1)[order]))
    open_rows = labelled(sets.mapInArrow(_prefixes(shared, percent), "key bigint, id bigint, n bigint"))
    own = F.floor(F.log(F.col("n")) / float(np.log(100 / percent))).cast("int")
    open_rows = open_rows.select("*", F.explode(F.array(F.struct(own.alias("cell"), F.lit(False).alias("upper")),
                                                        F.struct((own - 1).alias("cell"), F.lit(True).alias("upper")))).alias("c"))
    open_rows = open_rows.select("key", "c.cell", "c.upper", "id", "n", "label")
    h = F.xxhash64("id", "upper")
    keys = (open_rows.groupBy("key", "cell").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("n").alias("shingles"),
        F.count_if("upper").alias("uppers"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s"))
        .where("low != high AND uppers < size"))
    # Shingles often gather the same members again: one cell of each kind is enough.
    keys = keys.groupBy("size", "x", "s", "cell").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("shingles") / BLOCK_BYTES))
    keys = _spread(keys.select("key", "cell", blocks.cast("int").alias("blocks")))
    rest = stored(open_rows.join(keys, ["key", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")).drop("n"), "rest")
    rows = rest.join(sets, "id").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("key", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                        "block", "upper", "id", "label", "shingles")
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL, "upper", "block", "id")
    return stored(cells.mapInArrow(_cells(percent), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per input row: ``id``, ``n`` shingles, ``component`` (smallest id of the group), ``kept``."""
    texts = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    signed = stored(texts.mapInArrow(_signed, "id bigint, n bigint, f1 bigint, f2 bigint, registers binary"), "signed")

    classes = signed.where("n > 0").groupBy(*CLASS).agg(
        F.min("id").alias("rep"), F.min_by("registers", "id").alias("registers"))
    reps = stored(classes.select(F.col("rep").alias("id"), *CLASS, "registers"), "representatives")
    # Below this size one differing shingle already breaks the threshold, so only equal sets are linked.
    smallest = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    banded = reps.where(F.col("n") >= smallest).mapInArrow(_banded, "key bigint, id bigint, n bigint")
    hubs = (banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size"))
            .where("size > 1").select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")))
    members = stored(banded.join(_spread(hubs), "key"), "buckets")

    links = _star(members, reps, texts, percent)
    labels = components(links)
    more = _rest(members, labels, texts, percent)
    if not more.isEmpty():
        labels = components(links.union(more))

    # An id can stand on rows with different texts: its classes are one document.
    same = stored(signed.where("n > 0").join(reps.select(*CLASS, F.col("id").alias("rep")), CLASS).where("id != rep")
                  .select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "copies")
    again = same.groupBy("a").agg(F.count("*").alias("times")).where("times > 1")
    own = same.join(reps.select(F.col("id").alias("a")), "a", "left_semi")
    if not (again.isEmpty() and own.isEmpty()):
        labels = components(links.union(more).union(same))
    grouped_reps = reps.join(labels, "id", "left").select(*CLASS, F.coalesce("label", "id").alias("component"))
    rows = signed.select("id", *CLASS).join(grouped_reps, CLASS, "left")
    component = F.coalesce("component", "id")
    return rows.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "n",
        F.when(component != NO_ID, component).alias("component"), (component == F.col("id")).alias("kept"))
