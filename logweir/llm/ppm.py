"""Language-model scores by prediction by partial matching (PPM, method C) over bytes, beside unigram scores.

The model is a trie of byte contexts up to ``ORDER`` bytes, trained on the chosen documents. A symbol (a byte
or the end of the text) is coded in its longest known context; an unseen symbol costs an escape, and the
next shorter context then excludes all symbols of the longer one. The log10 probability of a text is the sum
over its symbols, its end included.

- Training counts all windows of ORDER + 1 symbols of all training documents: per task in numpy, then summed
  by Spark. Shorter contexts are sums over these windows. Nothing is pruned: what is learned grows with the corpus.
- Windows of up to ``LOW`` symbols have at most 257^2 values, whatever the corpus; they are broadcast in full. Longer
  ones stay on Spark: all windows of training and held-out documents are dealt and sorted by the LOW symbols before the
  last, so that a window stands beside everything that its cost depends on. A task holds some ``COSTED`` windows at a
  time, and at most the distinct windows of one key.
- The cost of a symbol only depends on its window. The costs of the most frequent windows, at most ``MAX_NODES``, are
  broadcast as a cache; the other windows of a document leave the task as (row, window, times) and meet their costs in a
  join. Any size of the cache gives the same scores, but for the order of the sums.

Unigram part: words are runs of characters outside ``[\\x20\\x09-\\x0D]`` after A-Z became a-z; each text also has
one end token. Words that make up at least 1 / ``MAX_WORDS`` of all training tokens are broadcast (at most
MAX_WORDS of them); all other words of a document leave the task as (row, word, times) and meet their counts
in a join, whose hot keys, words of unseen documents only, Spark splits.

Defined results: NULL text is empty and consists of its end; a NULL id counts as the text '' in the split;
without training documents every symbol has probability 1/257 and every word 1; repeated rows are scored one by
one; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.session import work_dir

ORDER = 4
LOW = 2
BITS = 9  # symbols: 0 end of text and the space before it, 1 to 256 bytes
SYMBOLS = 257
MAX_NODES = 1 << 21
MAX_WORDS = 1 << 20
LONG_WORD = 64
CHUNK = 1 << 20
FLUSH = 1 << 20
COSTED = 1 << 17
FOLDS = 7
HELD_OUT = 2


def held_out(id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def split_words(text: str | None) -> list[bytes]:
    """Bytes know only ASCII case and white space, which is what the contract asks for."""
    return (text or "").encode().lower().split()


# --- windows of symbols ----------------------------------------------------------------------------------


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the windows that end in each symbol, and the number of the text each belongs to, in chunks."""
    lengths = np.asarray([len(text) for text in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), lengths)
    symbols = np.zeros(int(lengths.sum()) + (ORDER + 1) * len(texts), np.uint16)
    symbols[np.arange(len(of)) + ORDER + (ORDER + 1) * of] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(lengths + ORDER + 1)
    for low in range(ORDER, len(symbols), CHUNK):
        high = min(low + CHUNK, len(symbols))
        codes = np.zeros(high - low, np.uint64)
        for back in range(ORDER, -1, -1):
            codes = (codes << np.uint64(BITS)) | symbols[low - back:high - back]
        at = np.arange(low, high)
        text = np.searchsorted(ends, at, "right")
        coded = at - (ends[text] - lengths[text] - ORDER - 1) >= ORDER  # not the space before a text
        yield codes[coded], text[coded]


def _grouped(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([part[0] for part in parts])
        unique, inverse = np.unique(every, return_inverse=True)
        return unique, np.bincount(inverse, np.concatenate([part[1] for part in parts]), len(unique)).astype(np.int64)

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"code": pa.array(codes.astype(np.int64)), "n": pa.array(counts)})

    for batch in batches:
        found = []
        for texts in _grouped((text or "").encode() for text in batch.column("text").to_pylist()):
            found += [np.unique(chunk, return_counts=True) for chunk, _ in windows(texts)]
        codes, counts = merged([(codes, counts), *found])
        if len(codes) > FLUSH:
            yield batch_of()
            codes, counts = codes[:0], counts[:0]
    yield batch_of()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(split_words(text))
        if len(counts) > FLUSH:
            yield batch_of()
            counts.clear()
    yield batch_of()


# --- the trie --------------------------------------------------------------------------------------------


class Trie:
    """Sorted windows of each order with the log10 costs that follow from their counts."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``grams[k]``: windows of k + 1 symbols and their counts, sorted by window."""
        self.grams, self.contexts, self.totals, self.kinds, self.excluded = [], [], [], [], []
        for codes, counts in grams:
            self._add(codes, counts)

    def _add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        contexts, of = np.unique(codes >> np.uint64(BITS), return_inverse=True)
        shorter = np.zeros(len(codes))
        if k := len(self.grams):
            at, known = self._find(self.grams[k - 1][0], codes & self.mask(k - 1))
            shorter = np.where(known, self.grams[k - 1][1][at] if len(self.grams[k - 1][1]) else 0, 0)
        self.grams.append((codes, counts))
        self.contexts.append(contexts)
        self.totals.append(np.bincount(of, counts, len(contexts)))
        self.kinds.append(np.bincount(of, minlength=len(contexts)))
        self.excluded.append(np.bincount(of, shorter, len(contexts)))

    def longer(self, codes: np.ndarray, counts: np.ndarray) -> Trie:
        """This trie with the orders up to ORDER, from whole windows and their counts."""
        trie = Trie([])
        for name, values in vars(self).items():
            setattr(trie, name, list(values))
        for k in range(len(self.grams), ORDER + 1):
            grams, of = np.unique(codes & self.mask(k), return_inverse=True)
            trie._add(grams, np.bincount(of, counts, len(grams)).astype(np.int64))
        return trie

    @staticmethod
    def mask(k: int) -> np.uint64:
        return np.uint64((1 << (BITS * (k + 1))) - 1)

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return at, table[at] == values

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last symbol after the others."""
        cost = np.zeros(len(codes))
        todo = np.arange(len(codes))
        less_total = np.zeros(len(codes))  # counts and kinds that the longer context excludes, as of todo
        less_kinds = np.zeros(len(codes))
        for k in range(len(self.grams) - 1, -1, -1):
            code = codes[todo] & self.mask(k)
            context, known = self._find(self.contexts[k], code >> np.uint64(BITS))
            here = np.flatnonzero(known)
            if not len(here):
                less_total, less_kinds = np.zeros(len(todo)), np.zeros(len(todo))
                continue
            context = context[here]
            total = self.totals[k][context] - less_total[here]
            kinds = self.kinds[k][context] - less_kinds[here]
            at, seen = self._find(self.grams[k][0], code[here])
            count = self.grams[k][1][at]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(seen, count, kinds) / (total + kinds)
            cost[todo[here]] += np.where(seen | (kinds > 0), np.log10(np.where(step > 0, step, 1)), 0)
            less_total, less_kinds = np.zeros(len(todo)), np.zeros(len(todo))
            less_total[here] = self.excluded[k][context]
            less_kinds[here] = self.kinds[k][context]
            left = np.ones(len(todo), bool)
            left[here[seen]] = False
            todo, less_total, less_kinds = todo[left], less_total[left], less_kinds[left]
        cost[todo] -= np.log10(np.maximum(1, SYMBOLS - less_kinds))
        return cost


def _collected(table: DataFrame, value: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """``code`` and ``value``, sorted by code; as Arrow buffers, without an object per row."""
    found = table.select("code", value).toArrow()
    codes = found.column("code").to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    return codes[order], found.column(value).to_numpy()[order].astype(kind)


def _costed(low):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def costed(code: np.ndarray, n: np.ndarray, uses: np.ndarray) -> pa.RecordBatch:
            trie = low.value.longer(code[n > 0], n[n > 0])
            return pa.RecordBatch.from_pydict({
                "code": pa.array(code.astype(np.int64)), "uses": pa.array(uses), "cost": pa.array(trie.log10(code))})

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(name).to_numpy() for name in ("code", "n", "uses")])
            size += batch.num_rows
            if size > COSTED:
                code, n, uses = (np.concatenate(part) for part in zip(*held))
                keys = (code.astype(np.uint64) >> np.uint64(BITS)) & Trie.mask(LOW - 1)
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield costed(code[:cut].astype(np.uint64), n[:cut], uses[:cut])
                held, size = [[code[cut:], n[cut:], uses[cut:]]], len(code) - cut
        if size:
            code, n, uses = (np.concatenate(part) for part in zip(*held))
            yield costed(code.astype(np.uint64), n, uses)

    return run


def window_costs(training: DataFrame, others: DataFrame) -> DataFrame:
    """``code``, ``uses`` and ``cost`` of every window of both, by the model of the training documents."""
    spark = training.sparkSession
    folder = work_dir(spark, "ppm-windows")

    def counted(docs: DataFrame, trained: str) -> DataFrame:
        return docs.select("text").mapInArrow(_count_windows, "code bigint, n bigint").selectExpr(
            "code", f"{trained} AS n", "n AS uses")

    (counted(training, "n").unionAll(counted(others, "0L")).groupBy("code")
     .agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")).write.parquet(folder))
    table = spark.read.parquet(folder)
    grams = []
    for k in range(LOW):
        # At most 257^2 rows, whatever the corpus.
        grams.append(_collected(
            table.where("n > 0").groupBy(F.col("code").bitwiseAND(F.lit(int(Trie.mask(k)))).alias("code"))
            .agg(F.sum("n").alias("n")), "n", np.int64))
    low = spark.sparkContext.broadcast(Trie(grams))
    key = F.shiftright("code", BITS).bitwiseAND(F.lit(int(Trie.mask(LOW - 1))))
    costs_at = work_dir(spark, "ppm-costs")
    (table.withColumn("key", key).repartition("key").sortWithinPartitions("key")
     .select("code", "n", "uses").mapInArrow(_costed(low), "code bigint, uses bigint, cost double").write.parquet(costs_at))
    return spark.read.parquet(costs_at)


def cache(costs: DataFrame, max_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent windows, at most ``max_nodes``, sorted, and their costs."""
    sizes = costs.groupBy(F.length(F.bin("uses")).alias("bits")).count().orderBy(F.desc("bits")).collect()
    least, n = 1 << 62, 0
    for row in sizes:  # at most 63
        n += row["count"]
        if n > max_nodes:
            break
        least = 1 << (row["bits"] - 1)
    return _collected(costs.where(F.col("uses") >= least), "cost", np.float64)


class Frequent:
    """Words with log10 of their counts plus one: two buffers on the driver and on the way, a dict in a worker."""

    def __init__(self, counts: DataFrame) -> None:
        found = counts.select("word", "n").toArrow().combine_chunks()
        self.words = found.column("word")
        self.logs = np.log10(found.column("n").to_numpy().astype(np.float64) + 1)
        self.table: dict[bytes, float] | None = None

    def get(self) -> dict[bytes, float]:
        if self.table is None:
            self.table = dict(zip(self.words.to_pylist(), self.logs.tolist()))
        return self.table


# --- scoring ---------------------------------------------------------------------------------------------

SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, " \
         "words array<binary>, times array<int>, codes array<bigint>, uses array<bigint>"


def _scored(model, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cached, costs), logs = model.value, frequent.value.get()
        for batch in batches:
            texts = [(text or "").encode() for text in batch.column("text").to_pylist()]
            score = np.zeros(len(texts))
            missed = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            first = 0
            for group in _grouped(iter(texts)):
                for codes, text in windows(group):
                    unique, inverse = np.unique(codes, return_inverse=True)
                    place, known = Trie._find(cached, unique)
                    cost = np.where(known, costs[place] if len(costs) else 0.0, 0.0)
                    score[first:first + len(group)] += np.bincount(text, cost[inverse], len(group))
                    rare = ~known[inverse]
                    pairs, n = np.unique(text[rare] * len(unique) + inverse[rare], return_counts=True)
                    missed.append((first + pairs // len(unique), unique[pairs % len(unique)], n))
                first += len(group)
            of, codes, uses = (np.concatenate(part) for part in zip(*missed))
            order = np.argsort(of, kind="stable")
            at_code = pa.array(np.searchsorted(of[order], np.arange(len(texts) + 1)).astype(np.int32))
            n_tokens, n_known, base = [], [], []
            words: list[bytes] = []
            times: list[int] = []
            offsets = [0]
            for text in texts:
                tokens = text.lower().split()
                known, total = 0, 0.0
                for word, n in Counter(tokens).items():
                    log = logs.get(word)
                    if log is None:
                        words.append(word)
                        times.append(n)
                    else:
                        known += n
                        total += n * log
                offsets.append(len(words))
                n_tokens.append(len(tokens))
                n_known.append(known)
                base.append(total)
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "base": pa.array(base, pa.float64()), "score": pa.array(score),
                "words": pa.ListArray.from_arrays(at, pa.array(words, pa.binary())),
                "times": pa.ListArray.from_arrays(at, pa.array(times, pa.int32())),
                "codes": pa.ListArray.from_arrays(at_code, pa.array(codes[order].astype(np.int64))),
                "uses": pa.ListArray.from_arrays(at_code, pa.array(uses[order].astype(np.int64)))})

    return run


def score(docs: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Train on the documents outside the held-out fold and score all of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where("NOT held_out")
    costs = window_costs(training, rows.where("held_out"))

    folder = work_dir(spark, "ppm-words")
    (training.select("text").mapInArrow(_count_words, "word binary, n bigint")
     .groupBy("word").agg(F.sum("n").alias("n")).write.parquet(folder))
    counts = spark.read.parquet(folder)
    ends = training.count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    common = counts.where((F.col("n") * MAX_WORDS >= total) & (F.length("word") <= LONG_WORD))

    context = spark.sparkContext
    scored_at = work_dir(spark, "ppm-scored")
    scored = rows.mapInArrow(_scored(context.broadcast(cache(costs, max_nodes)), context.broadcast(Frequent(common))), SCORED)
    scored.withColumn("row", F.monotonically_increasing_id()).write.parquet(scored_at)
    scored = spark.read.parquet(scored_at)

    rest = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x"))
    rest = rest.select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1)
    sums = (rest.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * log).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")))
    rare = scored.select("row", F.explode(F.arrays_zip("codes", "uses")).alias("x")).select(
        "row", F.col("x.codes").alias("code"), F.col("x.uses").alias("times"))
    left = rare.join(costs.select("code", "cost"), "code").groupBy("row").agg(
        F.sum(F.col("times") * F.col("cost")).alias("rare_score"))
    n_tokens = F.col("n_tokens") + 1
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 1)))
    return scored.drop("words", "times", "codes", "uses").join(sums, "row", "left").join(left, "row", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (base - n_tokens * float(np.log10(total + kinds + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
