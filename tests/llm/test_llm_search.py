"""Resampling, hard negatives and nearest neighbours against brute force over small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from logweir.llm import ann, cells, hardnegatives, ngrams, partitions, resample
from logweir.llm.hardnegatives import strassen

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def features(text):
    found = words(text)
    return [zlib.crc32(" ".join(found[i:i + n]).encode()) % 10_000
            for n in (1, 2, 3) for i in range(len(found) - n + 1)]


# --- importance resampling --------------------------------------------------------------------------------


def resampled(docs, target):
    """Rows (doc_id, n_features, weight, score, rank); ties of id and score are left open, as sorted rows."""
    s = Counter(x for _, text in docs for x in features(text))
    t = Counter(x for text in target for x in features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for id, text in docs:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * (all_s + 10_000) / ((s[x] + 1) * (all_t + 10_000))))
                     for x in found)
        h = int(hashlib.sha256(f"42:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        rows.append([id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    long_enough = [row for row, (_, text) in zip(rows, docs) if len(words(text)) >= 20]
    order = sorted(long_enough, key=lambda row: (-row[3], row[0] is None, row[0] or 0))
    for place, row in enumerate(order[:5 * len(long_enough) // 100]):
        row[4] = place + 1
    return sorted(map(tuple, rows), key=str)


def test_importance_resampling_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = entry.queries()["op11_importance_resampling"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {kind for _, kind in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, target)


ODD_TEXTS = [
    None, "", "   \n", "One", "one, two", "ÉCOLE école ÉÉ 日本語 x٣", "a" * 300 + " b " + "c" * 49, "x-y_z 1.2\x00\x7f3",
    "İstanbul ß ſ K " * 9, "same words again " * 30, "\U0001f600 face " * 25,
]


def test_resampling_of_odd_rows(spark):
    random.seed(5)
    vocabulary = "log ratio of shares 42 target Text déjà vu".split()
    docs = list(enumerate(ODD_TEXTS))
    docs += [(100 + i, " ".join(random.choices(vocabulary, k=random.randint(1, 60)))) for i in range(300)]
    docs += [(None, "the target text of no one " * 6), (7, "a second row with the id seven " * 9)]
    docs += [(500 + i, "one of many copies of a text " * 5) for i in range(200)]
    target = ["Target text target shares", None, "", "log ratio"]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "'x' AS score", "0 AS id")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(rows, wanted)
    assert sorted(map(tuple, got.select("id", "n_features", "weight", "score", "rank").collect()), key=str) == resampled(docs, target)
    ranks = sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    chosen = {r["id"] for r in got.where("rank IS NOT NULL").collect()}
    kept = resample.drawn(rows, got)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == chosen


def test_repeated_rows_are_drawn_exactly(spark):
    """All rows tie in everything: the draw still has its exact size and ranks without gaps."""
    rows = spark.createDataFrame([(3, "twenty words and more " * 6)] * 250, "doc_id long, text string")
    got = resample.resample(rows, rows.select("text").limit(0))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 13)) and got.count() == 250


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    assert [r["rank"] for r in resample.resample(some, none).collect()] == [None, None]


def test_long_texts_are_counted_whole(monkeypatch):
    """Pieces of a long text give the runs of the whole, also across their borders and inside a long word."""
    random.seed(2)
    texts = [" ".join(random.choices(["ab", "c9", "é" * 7, "d" * 80, "--", "Zz"], k=400)) for _ in range(4)] + [None, "x" * 900]
    whole = [Counter(features(text)) for text in texts]
    for size in (16, 100, 1000):
        monkeypatch.setattr(ngrams, "CHUNK", size)
        got = [Counter() for _ in texts]
        n_words = [0] * len(texts)
        for found in ngrams.runs([None if t is None else t.encode() for t in texts]):
            for of, total in zip(found.of.tolist(), (found.sums % np.uint32(10_000)).tolist()):
                got[found.first + of][total] += 1
            for k, n in enumerate(found.words.tolist()):
                n_words[found.first + k] += n
        assert got == whole and n_words == [len(words(t)) for t in texts]


@pytest.mark.parametrize("k", [1, 2, 7, 50, 99, 100])
def test_cutoff_takes_exactly_k(spark, k):
    random.seed(k)
    values = [(random.randint(-3, 3) * 10**12, random.randint(0, 4), row) for row in range(100)]
    rows = spark.createDataFrame(values, "a long, b long, row long")
    keys = ["a", "b", "row"]
    got = rows.where(resample.within(keys, resample.cutoff(rows, keys, k)))
    assert sorted(map(tuple, got.collect())) == sorted(values)[:k]
    assert [r["row"] for r in resample.ranked(got, keys).orderBy("rank").collect()] == [v[2] for v in sorted(values)[:k]]


# --- hard negatives ---------------------------------------------------------------------------------------


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def mined(rows):
    """``rows``: (id, label, vector); every row is a row of its own."""
    rows = [(id, (label + 1) % 10 if id % 7 == 0 else label, [math.floor(256 * x) for x in vector])
            for id, label, vector in rows if id is not None and label is not None and usable(vector)]
    found = []
    for i, (anchor, label, mine) in enumerate(rows):
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(mine, theirs)), id, j, other)
                  for j, (id, other, theirs) in enumerate(rows) if j != i]
        for minus, positive, _, _ in sorted(x for x in scored if x[3] == label)[:5]:
            p = -minus
            inside = sorted(x for x in scored if x[3] != label and 30 * p <= -100 * x[0] <= 90 * p)[:10]
            found += [(anchor, positive, k + 1, x[1], p, -x[0]) for k, x in enumerate(inside)]
    return sorted(found)


def mine(spark, rows, schema="id long, label int, vector array<float>"):
    made = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS row", "1 AS anchor", "2 AS block", "3 AS kind")
    label = hardnegatives.shifted_label(made["id"], made["label"])
    got = hardnegatives.mine(made.withColumn("label", label))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    random.seed(3)
    vector = lambda n=6: [random.randint(-256, 256) / 256 for _ in range(n)]
    rows = [(i, random.choice([0, 1, 1, 2]), vector()) for i in range(0, 900, 3)]
    copy = vector()
    rows += [(1000 + i, i % 3, copy) for i in range(150)]  # a crowd of copies, with ties
    rows += [(200, 1, vector()), (200, 1, vector()), (210, 1, copy), (210, 1, copy)]  # repeated ids
    rows += [(2000, None, vector()), (2100, 1, None), (2200, 1, [0.5, None]), (2300, 1, [float("nan")]),
             (2400, 1, [float("inf"), 1.0]), (None, 1, vector()), (2500, 1, []), (2600, 1, [1.0, -1.0]),
             (2700, 1, vector(9)), (-300, 2, vector()), (2800, 9, [0.0] * 6)]
    want = mined(rows)
    assert len(want) > 300 and mine(spark, rows) == want
    monkeypatch.setattr(cells, "BLOCK_NUMBERS", 16)  # many blocks, slots and merges
    monkeypatch.setattr(cells, "SLOT_ROWS", 100)
    assert mine(spark, rows) == want


def test_hard_negatives_without_rows(spark):
    assert mine(spark, []) == [] and mine(spark, [(100, 1, [1.0])]) == []
    assert mine(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])]) == [(100, 1, 1, 2, 65536, 32768)]


def test_strassen_is_exact():
    random_ = np.random.default_rng(4)
    for rows, inner, columns in ((1, 1, 1), (17, 33, 18), (64, 64, 64), (70, 41, 129), (20, 300, 19), (0, 5, 3)):
        a = random_.integers(-2**24, 2**24, (rows, inner))
        b = random_.integers(-2**24, 2**24, (inner, columns))
        assert (strassen(a, b) == a @ b).all()


def test_scores_too_large_to_be_exact_are_refused():
    with pytest.raises(ValueError):
        hardnegatives.scores(np.full((1, 4), 1 << 30), np.full((1, 4), 1 << 30))


# --- nearest neighbours -----------------------------------------------------------------------------------


def nearest(rows):
    """(query, [(cosine, id, row)]) of all candidates of each query row, nearest first."""
    rows = [(id, vector) for id, vector in rows if id is not None and usable(vector) and any(vector)]
    width = max([len(v) for _, v in rows], default=0)
    table = np.asarray([list(v) + [0.0] * (width - len(v)) for _, v in rows]).reshape(len(rows), width)
    table = np.ldexp(table, -np.frexp(np.abs(table).max(axis=1, initial=0))[1][:, None])
    norms = np.sqrt((table * table).sum(axis=1))
    for i, (id, _) in enumerate(rows):
        if id % 50 == 0:
            cosine = (table * table[i]).sum(axis=1) / norms / norms[i]
            yield id, sorted((-cosine[j], rows[j][0], j) for j in range(len(rows)) if j != i)


def search(spark, rows, **more):
    made = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("*", "'x' AS row", "0 AS part", "0 AS asked")
    got = ann.search(made, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return got.collect()


def odd_vectors():
    random_ = np.random.default_rng(9)
    rows = [(i, (random_.normal(0, 1, 8) + 3 * np.eye(8)[i % 8]).tolist()) for i in range(1200)]
    rows += [(3000 + i, rows[50][1]) for i in range(500)]  # a crowd of copies, queries among them
    rows += [(5000 + i, (np.asarray(rows[7][1]) * 2.0**i).tolist()) for i in range(30)]  # equal cosines
    rows += [(6000, None), (6050, [0.0] * 8), (6100, [1.0, None]), (6150, [float("nan")] * 8), (None, [1.0] * 8),
             (6200, []), (6250, [1.0, 2.0]), (6300, [1e300, 1e300, 1e-300]), (150, rows[150][1]), (200, rows[3][1])]
    return rows


def test_neighbours_of_odd_rows_without_losses(spark, monkeypatch):
    """With the whole mass every query meets every vector, so the rows are those of brute force, ties included."""
    monkeypatch.setattr(cells, "BLOCK_NUMBERS", 64)
    monkeypatch.setattr(cells, "SLOT_ROWS", 300)
    rows = odd_vectors()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(spark, rows, target=1.0))
    want = sorted((id, k + 1, x[1], -x[0]) for id, found in nearest(rows) for k, x in enumerate(found[:5]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 1e-12


def test_recall(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.1"):
        got = entry.queries()["op13_learned_partitions"](spark, folder).collect()
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        want = {(id, x[1]) for id, found in nearest(rows) for x in found[:5]}
        assert len(got) == len(want)
        assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (100, [1.0, 0.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(spark, rows))
    assert got == [(50, 1, 100, 1.0), (50, 2, 1, 0.0), (50, 3, 2, -1.0), (100, 1, 50, 1.0), (100, 2, 1, 0.0), (100, 3, 2, -1.0)]
    assert search(spark, []) == [] and search(spark, [(50, [1.0])]) == [] and search(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_partitions_are_balanced_and_follow_the_graph():
    random_ = np.random.default_rng(1)
    centres = random_.normal(0, 1, (12, 16))
    vectors = ann.units(centres[random_.integers(0, 12, 1200)] + random_.normal(0, 0.15, (1200, 16)))
    near = partitions.neighbours(vectors, 10)
    part = partitions.balanced(vectors, near, 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(1.05 * 1200 / 8)
    assert (part[near] == part[:, None]).mean() > 0.6
    index = ann.Index(vectors, 8)
    before = partitions.mass_before(index.router.probabilities(vectors), np.tile(np.arange(8), (1200, 1)))
    assert (before <= index.mass).sum(axis=1).mean() < 5  # clustered vectors are searched narrowly
