"""The pipeline against a brute-force version of all its stages, and its defined results."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import decontaminate, packing, quality
from logweir.session import configure, work_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def line_is_bad(line):
    w = WORDS.findall(line)
    if not w:
        return False
    end = line.rstrip(SPACE + quality.CLOSERS)
    open_end = end[-1:] not in quality.CLOSED and not re.search("[.!?…。！？]", end[-quality.TAIL:])
    short = len(line) <= quality.SHORT_LINE
    symbols = sum(c in "#*$%&|<>" for c in line)
    return (open_end or line.count("|") >= 2 or 2 * symbols > len(w) and symbols > 0
            or short and len(w) <= 8 and not re.search("[.!?…。！？]", line)
            or short and bool(re.search(quality.BOILERPLATE.replace("(?i)", ""), line, re.I | re.A)))


def brute_quality(docs):
    out = {}
    for d, text in docs.items():
        w = WORDS.findall(text)
        seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = text.split("\n")
        lost = sum(len(x) for line in lines if line_is_bad(line) for x in WORDS.findall(line))
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 100 * lost <= 30 * sum(map(len, w)):
            out[d] = "\n".join(line for line in lines if not line_is_bad(line))
    return out


def brute_lines(docs):
    holders = defaultdict(set)
    for d, text in docs.items():
        for line in text.split("\n"):
            holders[lower(line.strip(SPACE))].add(d)
    frequent = {key: max(ids) for key, ids in holders.items() if len(key) >= 40 and len(ids) >= 5}
    return {d: "\n".join(line for line in text.split("\n") if frequent.get(lower(line.strip(SPACE)), d) == d)
            for d, text in docs.items()}


def brute_near(docs):
    def shingles(text):
        w = WORDS.findall(lower(text))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: t for d, t in docs.items() if root(d) == d}


def brute_clean(docs, items):
    def leaked(text):
        return any(item
                   and decontaminate.nearest(item, text)[0] <= int(len(item) * decontaminate.MAX_EDITS) for item in items)

    return {d: t for d, t in docs.items() if not leaked(decontaminate.normal(t))}


def test_every_stage_against_brute_force(spark, sf_dir):
    configure(spark)
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.text for r in raw.collect()}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    brute = [brute_quality, brute_lines, brute_near, lambda docs: brute_clean(docs, items)]
    docs, columns = raw, raw.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES, [*brute, None]):
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if expected is None:
            continue
        before, want = len(want), expected(want)
        rows = docs.collect()
        assert docs.columns == columns and {r.doc_id: r.text for r in rows} == want and len(rows) == len(want), name
        assert all(r.n_chars == len(r.text) for r in rows)
        assert name == "line_dedup" or len(want) < before, f"{name} has nothing to do here"
    sizes = Counter()
    for r in docs.collect():
        sizes[r.doc_id] += r.n_tokens
    assert sizes == Counter({d: len(WORDS.findall(t)) + 1 for d, t in want.items()})
    final = {tuple(r)[:4] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert final == {tuple(r)[:4] for r in docs.collect()}


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]


@pytest.fixture(scope="module")
def odd(spark):
    prose = " ".join(f"alpha{i} beta{i} gamma{i} delta{i}." for i in range(30))
    rows = [(1, None), (2, ""), (3, prose), (3, prose), (4, prose), (None, prose + " And more."), (5, "| a | b |\n" + prose)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit(name).alias(name) for name in ("doc", "quality", "lines", "kept_id", "leaked_id", "n", "id")])


def test_stages_in_odd_cases(spark, sf_dir, odd):
    configure(spark)
    kept = corpus_pipeline.quality_rules(spark, odd, sf_dir)
    assert kept.columns == odd.columns and kept.count() == 5
    assert not kept.where("text LIKE '%|%'").count() and kept.first().kept_id == "kept_id"
    lines = corpus_pipeline.line_dedup(spark, kept, sf_dir)
    assert lines.columns == odd.columns and lines.count() == 5
    near = corpus_pipeline.near_dedup(spark, kept, sf_dir)
    assert near.columns == odd.columns and {r.doc_id for r in near.collect()} == {None}
    clean = corpus_pipeline.decontamination(spark, kept, sf_dir)
    assert clean.columns == odd.columns and clean.count() == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, odd.where("doc_id > 99"), sf_dir)
        assert none.columns == odd.columns and none.count() == 0
    assert corpus_pipeline.best_fit_packing(spark, odd.where("doc_id > 99"), sf_dir).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, odd, sf_dir).where(F.col("capacity") > max(packing.CAPACITIES)).count() == 0
