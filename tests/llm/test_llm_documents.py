"""Corpus operators over documents against brute force, and their defined results in odd cases."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from logweir.llm import decontaminate, licenses, linededup, neardup, packing, ppm, quality, queries, tokens
from logweir.llm.text import table
from logweir.session import work_dir

SPACE = r"[\x20\x09-\x0D]"
LONG = " ".join(f"word{i % 997}" for i in range(60_000)) + "."
PROSE = "The committee read the whole report and asked for two more months of work. " * 2


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents", "doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """NULL, empty, blank, very long and repeated texts, a NULL id, and columns named like the operators' own."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, PROSE), (5, PROSE), (6, PROSE), (None, PROSE), (None, None)]
    names = "doc quality lines id n label body low matches found key row leaked_id kept_id l_doc l_pos p_id part".split()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit(name).alias(name) for name in names])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id < 0")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_its_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) == ""


# --- quality ----------------------------------------------------------------------------------------------


def quality_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_measures(spark, sf_dir, documents):
    rows = queries.QUERIES["op6_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == quality_measures(documents[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)


def test_line_rules(spark):
    lines = {
        "A sentence that ends as it should.": False, 'He said: "Well done."': False, "": False, "  ": False,
        "Home | About | Contact.": True, "no closing mark at the end of this line of text": True, "Menu": True,
        "This sentence is whole. A word": False, "A whole sentence. But then comes much more text that never ends anywhere": True,
        "We use cookies: read our Cookie Policy today, it is short and clear.": True,
        "a# b* c$ d% e& f|.": True, "This costs 5% more than it did in the last year of the plan.": False,
    }
    df = spark.createDataFrame([(k, v) for k, v in lines.items()], "line string, bad boolean")
    assert [r.line for r in df.where(quality.line_fails(F.col("line")) != F.col("bad")).collect()] == []


def test_document_that_loses_too_much(spark):
    rng = random.Random(1)
    good = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(10)) + "." for _ in range(30))
    bad = good + "\n" + "\n".join(f"left {i} | middle {i} | right {i} | more {i}" for i in range(40))
    df = spark.createDataFrame([(1, good), (2, bad)], "doc_id bigint, text string")
    got = {r.doc.doc_id: r.quality for r in quality.clean_lines(df).collect()}
    assert got[1].kept and got[1].text == good
    assert not got[2].base_failed and not got[2].kept and got[2].text == good


SENTENCES = {
    "en": ("the old harbour lies beyond the northern gate where boats were once repaired every spring".split(), " ", "."),
    "de": ("Verwaltungsgebäude Straßenbahnhaltestelle Bibliothek Eisenbahnbrücke wurde damals Handwerksbetrieb".split(), " ", "."),
    "hi": ("पुराना बंदरगाह उत्तरी द्वार के पार है जहाँ नावें हर वसंत में ठीक होती थीं".split(), " ", "।"),
    "ur": ("پرانی بندرگاہ شمالی دروازے کے پار ہے جہاں ہر بہار میں کشتیاں مرمت ہوتی تھیں".split(), " ", "۔"),
    "hy": ("հին նավահանգիստը գտնվում է հյուսիսային դարպասից այն կողմ որտեղ նավակները".split(), " ", "։"),
    "am": ("ጥንታዊው ወደብ ከሰሜናዊው በር ባሻገር ይገኛል ጀልባዎች በየዓመቱ ይጠገኑ ነበር".split(), " ", "።"),
    "th": ("ท่าเรือเก่า ตั้งอยู่นอกประตู ทางทิศเหนือ ซึ่งเคยซ่อมเรือ ทุกฤดูใบไม้ผลิ ก่อนสงครามโลก".split(), " ", ""),
}


@pytest.mark.parametrize("lang", sorted(SENTENCES))
@pytest.mark.parametrize("width", [None, 60, 76])
def test_prose_is_kept_in_all_scripts_and_widths(spark, lang, width):
    """Whole paragraphs, and the same text wrapped at a width: nothing of it fails."""
    vocabulary, gap, stop = SENTENCES[lang]
    rng = random.Random(7)
    spoken = [gap.join(f"{rng.choice(vocabulary)}{rng.choice(range(1, 400))}" for _ in range(rng.randrange(9, 25))) + stop for _ in range(40)]
    paragraphs = [" ".join(spoken[i:i + 5]) for i in range(0, 40, 5)]
    text = "\n\n".join("\n".join(textwrap.wrap(p, width)) if width else p for p in paragraphs)
    row = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().quality
    assert row.kept and not row.base_failed
    lost = set(text.split("\n")) - set(row.text.split("\n"))
    assert sum(map(len, lost)) <= (0.02 if width else 0) * len(text), lost


def test_lists_are_not_taken_for_wrapped_prose(spark):
    """Titles of all lengths stay open lines; so does a line that would have had room for the next word."""
    rng = random.Random(3)
    titles = [" ".join(rng.choice(SENTENCES["en"][0]) for _ in range(rng.choice([3, 5, 9, 14, 30]))) for _ in range(200)]
    df = spark.createDataFrame([(1, "\n".join(titles))], "doc_id bigint, text string")
    kept = quality.clean_lines(df).first().quality.text.split("\n")
    assert len(kept) < 0.2 * len(titles)


def test_quality_odd_cases(odd, empty):
    got = {(r.doc.doc_id, r.doc.text): r for r in quality.clean_lines(odd).collect()}
    assert quality.clean_lines(odd).count() == 9
    assert all(got[key].quality.n_words == 0 and not got[key].quality.kept for key in got if not (key[1] or "").strip())
    assert got[4, LONG].quality.n_words == 60_000 and got[4, LONG].quality.base_failed
    assert got[5, PROSE].doc.quality == "quality"
    assert quality.clean_lines(empty).count() == 0


# --- line dedup -------------------------------------------------------------------------------------------


def test_lines_beyond_one_word_of_the_bitmap(spark):
    shared = "This line is long enough to be a key of the corpus"
    texts = [(i, "\n".join([f"own {i} {j}" for j in range(150)] + ["  " + shared.upper() + "\t"] * 2 + ["end"])) for i in range(6)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc.doc_id: r.lines for r in linededup.dedup_lines(df).collect()}
    assert got[5].text == texts[5][1] and got[5].dropped == 0
    assert all(got[i].dropped == 2 and got[i].n == 153 and got[i].text.endswith("149\nend") for i in range(5))
    bitmap = {r.l_doc: r.l_bitmap for r in linededup.keep_bitmaps(df).collect()}
    assert set(bitmap) == set(range(5)) and [w.word for w in bitmap[0]] == [2]
    assert bitmap[0][0].kept == -1 ^ (0b11 << 22)


def test_line_dedup_odd_cases(spark, odd, empty):
    got = linededup.dedup_lines(odd, min_docs=2).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc.doc_id].append(r.lines)
    assert len(got) == 9 and by[1][0].n == 1 and by[1][0].text == "" and by[2][0].n == 1
    assert [x.dropped for x in by[5]] == [1, 1] and by[6][0].dropped == 0
    assert sorted(x.dropped for x in by[None]) == [0, 1]
    assert linededup.dedup_lines(empty).count() == 0
    sums = table(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text").limit(1)
    assert linededup.dedup_lines(sums).first().lines.dropped == 0


# --- licenses ---------------------------------------------------------------------------------------------


def test_license_base(spark, sf_dir, documents):
    rows = queries.QUERIES["op3_license_scan"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(documents[r.doc_id]))
        places = [(i, name) for phrase, name in licenses.BASE.items() for i in range(len(w))
                  if w[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({name for _, name in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_rules(spark):
    assert len(licenses.rules()) >= 200
    cases = {
        'Licensed under the Apache License, Version 2.0 (the "License")': (["apache"], 1),
        "SPDX-License-Identifier: GPL-3.0-or-later": (["gpl"], 1),
        "GNU Lesser General Public License v2.1": (["lgpl"], 1),
        "the MIT License and the BSD 3-Clause License": (["bsd", "mit"], 2),
        "the limit license of my permit": (None, None),
        "Distributed under the terms of the Mozilla Public License 2.0, see LICENSE": (["mpl"], 1),
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r.doc.text: r for r in licenses.scan(df).collect()}
    for text, (labels, n) in cases.items():
        found = got[text].found
        assert (sorted(found.labels) if found else None, found.n if found else None) == (labels, n), text
        for m in got[text].matches:
            assert 0 <= m.start < -m.minus_stop <= len(text)


def test_no_gate_stops_a_rule_that_matches(spark, documents):
    wrapped = ["distributed\nunder the gpl", "code released\nunder the terms of the apache", "released publicly under the mpl",
               "available freely under bsd", "the gnu general public\nversion 2", "published by\tisc", "released by the zlib",
               "sil open\nfont v1.1", "under the q\npublic\nlicense", "the expat license", "apache\nv2", "gpl-v 3", "mpl (version\n2.0)"]
    texts = wrapped + [text for text in documents.values() if text][:150]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    compiled = [(rule[0], re.compile(rule[5])) for rule in licenses.rules()]
    for row in licenses.scan(df).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), row.doc.text)
        want = {rule for rule, regex in compiled if regex.search(low)}
        assert {m.rule for m in row.matches} == want and (want or row.doc.doc_id >= len(wrapped)), row.doc.text


def test_license_odd_cases(odd, empty):
    got = licenses.scan(odd).collect()
    assert len(got) == 9 and all(r.found is None for r in got)
    assert {r.n_words for r in got if r.doc.doc_id in (1, 2, 3)} == {0}
    assert licenses.scan(empty).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------


def test_registers_estimate_similarity():
    rng = np.random.default_rng(5)
    for n, share in ((200, 0.85), (3000, 0.85), (3000, 0.5), (50, 0.9)):
        both = rng.integers(1, 2**64, int(n * share), np.uint64)
        rest = (n - len(both)) // 2
        a, b = (np.unique(np.concatenate([both, rng.integers(1, 2**64, rest, np.uint64)])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got, used = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], len(a), len(b))
        assert abs(got[0] - true) < 5 * math.sqrt(true * (1 - true) / used[0]) + 1e-9


def test_bands_catch_pairs_at_the_threshold_and_few_below():
    """Of pairs right at 0.85 none may be missed, of any size; half as similar pairs seldom meet."""
    rng = np.random.default_rng(12)
    for n in (7, 20, 60, 160, 1000):
        met = {}
        for share in (0.85, 0.4):
            met[share] = 0
            for _ in range(200):
                same = max(1, math.ceil(share * n))
                both = rng.integers(1, 2**64, same, np.uint64)
                extra = (n - same) // 2
                a, b = (np.unique(np.concatenate([both, rng.integers(1, 2**64, k, np.uint64)])) for k in (extra, n - same - extra))
                table = np.stack([neardup.registers(a), neardup.registers(b)])
                doc, keys = neardup.band_keys(table)
                met[share] += bool(set(keys[doc == 0].tolist()) & set(keys[doc == 1].tolist()))
        assert met[0.85] == 200 and met[0.4] < 60, (n, met)
    empty = np.zeros((2, neardup.REGISTERS), np.uint16)
    assert len(neardup.band_keys(empty)[0]) == 0


def test_no_link_is_lost_at_the_threshold(spark):
    """Pairs right at the limit, chains of them, and a crowd that shares a passage without being linked."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(60):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(4):
            edited = list(base)
            for _ in range(max(1, len(base) // 70)):
                edited[rng.randrange(len(base))] = word()
            rows.append((len(rows), " ".join(edited)))
    passage = " ".join(word() for _ in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(word() for _ in range(50))) for i in range(300)]
    rows += [(10_000 + i, rows[7][1].upper()) for i in range(50)]
    texts = dict(rows)

    def shingles(text):
        w = lower(text).split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter((i, j) for ids in where.values() for i in ids for j in ids if i < j)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in shared.items():
        if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r for r in neardup.near_duplicates(df).collect()}
    assert {i: r.component for i, r in got.items()} == {i: root(i) for i in sets}
    assert {i: r.n for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component == i) for i, r in got.items())


def test_blocks_find_links_that_stars_miss(spark, monkeypatch):
    """With tiny blocks and only the rest step the groups are the same."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        edited = list(base)
        for _ in range(4):
            edited[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r.id: r.component for r in neardup.near_duplicates(df).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "_star", lambda members, reps, texts, percent: spark.createDataFrame([], "a bigint, b bigint"))
    monkeypatch.setattr(neardup, "_rest", lambda members, labels, *rest, old=neardup._rest: old(
        members.withColumn("hub", F.lit(-1)), labels, *rest))
    assert {r.id: r.component for r in neardup.near_duplicates(df).collect()} == want


def test_near_duplicates_odd_cases(spark, odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 9
    by = defaultdict(set)
    for r in got:
        by[r.id].add((r.n, r.component, r.kept))
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)}
    assert {(c, k) for _, c, k in by[6]} == {(None, False)} and len(by[5]) == 1
    assert all(k for _, _, k in by[None])
    assert neardup.near_duplicates(empty).count() == 0
    # One id on rows with different texts joins their groups; short texts only link when equal.
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z"), (4, "a b"), (5, "A  b"), (6, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.id, r.component) for r in neardup.near_duplicates(df).collect()} == {
        (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}


# --- decontamination --------------------------------------------------------------------------------------


def damaged(rng, text, edits):
    data = bytearray(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(data)), rng.randrange(3)
        if kind == 0:
            data[k] = rng.choice(b"abcdefgh ")
        elif kind == 1:
            del data[k]
        else:
            data.insert(k, rng.choice(b"abcdefgh "))
    return bytes(data).decode("utf-8", "ignore")


def test_edit_distance_is_exact():
    rng = random.Random(2)
    for _ in range(300):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert decontaminate.nearest(a, b)[0] == min(row)


@pytest.mark.parametrize("share, recall", [(0.0, 1.0), (0.02, 1.0), (0.05, 0.98), (0.1, 0.9)])
def test_recall_of_edited_items(spark, sf_dir, documents, share, recall):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark", "item_id", "text").collect()]
    hosts = [t for t in documents.values() if len(t) > 1500]
    rows = []
    for k, (_, text) in enumerate(items * 3):
        host, normal = hosts[k % len(hosts)], decontaminate.normal(text)
        rows.append((k, f"{host[:700]} {damaged(rng, normal, int(share * len(normal)))} {host[700:]}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, bench).collect()}
    wanted = {(k, items[k % len(items)][0]) for k in range(len(rows))}
    assert len(found & wanted) >= recall * len(wanted)


def spread_evenly(item, edits):
    out = bytearray(item)
    for k in range(edits):
        at = int((k + 0.5) * len(item) / edits)
        out[at] = ord("q") if out[at] != ord("q") else ord("z")
    return bytes(out)


@pytest.mark.parametrize("spaces", [True, False])
@pytest.mark.parametrize("spread", ["even", "random"])
def test_no_leak_within_the_bound_is_lost(spark, sf_dir, documents, spread, spaces):
    """Items with all the edits that are allowed, also spread evenly and without spaces, next to brute force."""
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark", "item_id", "text").collect()]
    hosts = sorted(text for text in documents.values() if text and len(text) > 300)
    if not spaces:
        items = [(i, "".join(text.split())) for i, text in items]
    rows, want = [], set()
    for k, (i, text) in enumerate(items):
        normal, host = decontaminate.normal(text), hosts[k % len(hosts)]
        edits = int(decontaminate.MAX_EDITS * len(normal))
        if spread == "even":
            changed = spread_evenly(normal, edits).decode(errors="replace")
        else:
            changed = normal.decode()
            rng = random.Random(k)
            for _ in range(edits):
                at = rng.randrange(len(changed))
                changed = changed[:at] + rng.choice(["", "q", changed[at] + "q"]) + changed[at + 1:]
        body = host[:100] + " " + changed + " " + host[100:300]
        rows.append((k, body))
        if decontaminate.nearest(normal, decontaminate.normal(body))[0] <= edits:
            want.add((k, i))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, bench).collect()}
    assert want and want <= found


def test_exact_leaks(spark, sf_dir, documents):
    items = {r.item_id: decontaminate.normal(r.text) for r in table(spark, sf_dir, "benchmark", "item_id", "text").collect()}
    rows = queries.QUERIES["op2_cgk_decontamination"](spark, sf_dir).collect()
    exact = {(d, i) for d, t in documents.items() for i, item in items.items() if item in decontaminate.normal(t)}
    assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == exact
    assert all(r.edits <= decontaminate.MAX_EDITS * r.item_bytes for r in rows)


def test_decontamination_odd_cases(spark, odd, empty):
    bench = spark.createDataFrame([(1, PROSE.upper() + "!!"), (2, None), (3, "short"), (4, PROSE)], "item_id bigint, text string")
    found = decontaminate.find_items(odd, bench)
    assert sorted((r.doc_id or -1, r.item_id) for r in found.collect()) == sorted(
        (d, i) for d in (5, 5, 6, -1) for i in (1, 4))
    assert decontaminate.find_items(odd, bench, block_bytes=100).count() == 8
    assert {(r.doc_id, r.text) for r in decontaminate.clean(odd, bench).collect()} == {(1, None), (2, ""), (3, " \n\t"), (4, LONG)}
    assert decontaminate.find_items(empty, bench).count() == 0
    assert decontaminate.find_items(odd, bench.where("item_id < 0")).count() == 0


# --- packing ----------------------------------------------------------------------------------------------


def test_packing_places_every_token_once(spark, sf_dir, documents):
    rows = queries.QUERIES["op9_best_fit_packing"](spark, sf_dir).toPandas()
    tokens_of = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for d, t in documents.items()}
    for doc, pieces in rows.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert (pieces["start"] == pieces["n_tokens"].cumsum() - pieces["n_tokens"]).all()
        assert pieces["n_tokens"].sum() == tokens_of.pop(doc)
    assert not tokens_of
    for _, pieces in rows.groupby("bin_id"):
        pieces = pieces.sort_values("bin_offset")
        assert (pieces["bin_offset"] == pieces["n_tokens"].cumsum() - pieces["n_tokens"]).all()
        capacity, used = pieces["capacity"].iloc[0], pieces["n_tokens"].sum()
        assert capacity == min(c for c in packing.CAPACITIES if c >= used)


def test_best_fit_is_better_than_one_size():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 600) for _ in range(3000)), reverse=True)
    cost = lambda final: int(final.sum()) + packing.OVERHEAD * len(final)
    several = cost(packing.best_fit(lengths)[2])
    assert all(several <= cost(packing.best_fit(lengths, [c])[2]) for c in packing.CAPACITIES if c >= 600)
    assert several <= 1.01 * sum(lengths) + packing.OVERHEAD * math.ceil(sum(lengths) / 8192) + 512
    assert [len(x) for x in packing.best_fit([])] == [0, 0, 0]


def test_best_fit_against_brute_force():
    """Straightforward best fit with one capacity, item by item."""
    rng = random.Random(8)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 60) for _ in range(40)), reverse=True)
        room, want = [], []
        for length in lengths:
            fits = [left for left in room if left >= length]
            if not fits:
                room.append(64)
                fits = [64]
            room.remove(min(fits))
            room.append(min(fits) - length)
            want.append(min(fits))
        bins, offsets, _ = packing.best_fit(lengths, [64])
        assert [64 - o for o in offsets] == want


def test_packing_odd_cases(odd, empty, spark):
    rows = packing.pack(odd, packing.count_tokens(F.col("text"))).toPandas()
    assert len(rows) == 8 + 8 and rows["doc_id"].isna().sum() == 2
    sizes = spark.createDataFrame([(1, 0), (2, None), (3, 8192), (3, 8193)], "doc_id bigint, n bigint")
    got = packing.pack(sizes, F.col("n")).collect()
    assert sorted((r.piece, r.start, r.n_tokens, r.capacity) for r in got) == [
        (0, 0, 8192, 8192), (0, 0, 8192, 8192), (1, 8192, 1, 512)]
    assert packing.pack(empty, packing.count_tokens(F.col("text"))).count() == 0


# --- language model ---------------------------------------------------------------------------------------


class Brute:
    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for text in texts:
            s = self.symbols(text)
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.seen[k][tuple(s[i - k:i])][s[i]] += 1

    @staticmethod
    def symbols(text):
        return [0] * ppm.ORDER + [b + 1 for b in text.encode()] + [0]

    def log10(self, text):
        s, total = self.symbols(text), 0.0
        for i in range(ppm.ORDER, len(s)):
            out = set()
            for k in range(ppm.ORDER, -1, -1):
                found = self.seen[k].get(tuple(s[i - k:i]))
                if not found:
                    continue
                left = {x: n for x, n in found.items() if x not in out}
                size = sum(left.values()) + len(left)
                if s[i] in left:
                    total += math.log10(left[s[i]] / size)
                    break
                if left:
                    total += math.log10(len(left) / size)
                out |= set(found)
            else:
                total -= math.log10(257 - len(out))
        return total


def test_scores_against_brute_force(spark, sf_dir, documents):
    train = {d: t for d, t in documents.items() if zlib.crc32(str(d).encode()) % 7 != 2}
    counts = Counter(w for t in train.values() for w in [*ppm.split_words(t), None])
    n, kinds, model = sum(counts.values()), len(counts), Brute(train.values())
    rows = queries.QUERIES["op5_ppm_score"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        w = [*ppm.split_words(documents[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            r.doc_id not in train, len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + kinds + 1)) for x in w), rel=1e-9)
    for r in rows[:25]:
        assert r.score == pytest.approx(model.log10(documents[r.doc_id]), rel=1e-9)


def model(texts):
    """The whole model in one piece, from the parts that the query deals out: low orders, then longer ones."""
    codes = np.concatenate([codes for codes, _ in ppm.windows([text.encode() for text in texts])])
    low = [np.unique(codes & ppm.Trie.mask(k), return_counts=True) for k in range(ppm.LOW)]
    return ppm.Trie(low).longer(*np.unique(codes, return_counts=True))


def test_model_is_a_distribution():
    trie = model(["abracadabra " * 20, "the quick brown fox", "zzz"])
    for context in (b"abra", b"quic", b"\xff\xfe\xfd\xfc", b"zzz"):
        past = [0] * (ppm.ORDER - len(context)) + [b + 1 for b in context]
        code = 0
        for s in past:
            code = code << ppm.BITS | s
        codes = np.asarray([code << ppm.BITS | s for s in range(ppm.SYMBOLS)], np.uint64)
        assert (10 ** trie.log10(codes)).sum() == pytest.approx(1)


def test_rare_windows_are_never_pruned(spark):
    """Beyond MAX_NODES symbols a name seen once is still known, and the size of the cache changes nothing."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    common = [(i, "so many words of this kind " * 4_000) for i in ids[:45]]
    rows = [*common, (ids[45], "the Quetzalcoatlus xyzzy"), (next(i for i in range(60) if i not in ids), "a Quetzalcoatlus")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sum(len(text) for _, text in common) > ppm.MAX_NODES
    whole = model([text for i, text in rows if i in ids])
    for found in (ppm.score(df), ppm.score(df, max_nodes=20), ppm.score(df, max_nodes=0)):
        got = {r.doc_id: r.score for r in found.collect()}
        for i, text in rows[-3:]:
            assert got[i] == pytest.approx(sum(whole.log10(codes).sum() for codes, _ in ppm.windows([text.encode()])), rel=1e-9)


def test_held_out_prose_is_likelier_than_noise(documents):
    trie = model([t for d, t in documents.items() if zlib.crc32(str(d).encode()) % 7 != 2])
    rng = random.Random(0)

    def bits(text):
        total = sum(trie.log10(codes).sum() for codes, _ in ppm.windows([text.encode()]))
        return -total / math.log10(2) / len(text.encode())

    for d, t in [(d, t) for d, t in documents.items() if zlib.crc32(str(d).encode()) % 7 == 2][:10]:
        mixed = list(t)
        rng.shuffle(mixed)
        assert bits(t) < 4 < bits("".join(chr(rng.randrange(33, 126)) for _ in t)) and bits(t) < bits("".join(mixed))


def test_score_odd_cases(odd, empty):
    got = ppm.score(odd).collect()
    assert len(got) == 9 and all(r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert ppm.score(empty).count() == 0


def test_long_texts_are_cut_into_chunks_without_loss(monkeypatch):
    texts = [b"one two", b"", b"three" * 50, b"\x00\xff"]
    whole = [np.concatenate(parts) for parts in zip(*ppm.windows(texts))]
    monkeypatch.setattr(ppm, "CHUNK", 7)
    cut = [np.concatenate(parts) for parts in zip(*ppm.windows(texts))]
    assert all((a == b).all() for a, b in zip(whole, cut)) and len(whole[0]) == sum(len(t) + 1 for t in texts)


# --- token files ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference(vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_token_query(spark, sf_dir, documents, reference):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_rans_tokens"](spark, sf_dir).collect()}
    start = 0
    for d in sorted(documents):
        ids = [*reference(documents[d]), tokens.END_ID]
        want = (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == want
        start += len(ids)
    assert len(rows) == len(documents)


def test_encoder_splits_like_the_tokenizer(vocabulary, reference):
    encode = tokens.Encoder(vocabulary)
    rng = random.Random(3)
    odd = ["", " ", "  a", "a  b", "a\n b", "a \nb", "a\n\nb c", "it's <|endoftext|> we've", "x<|endoftext|>", "naïve 中文 日本 １２ ٣",
           "a b c", "tab\there x", "emoji 😀 here", "a b", "x  y", "'ll 'S", "1234 5.6", "a\0b c\0", "\0", "x \0. y", "́a b"]
    odd += ["".join(rng.choice("ab'.\n \t1é ") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for text in odd:
        assert encode(text) == np.asarray(reference(text), "<u2").tobytes(), repr(text)


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    for n in (1, 2, 300, 5000, 200_000):
        ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint16)
        coder = tokens.Coder(tokens.frequencies(np.bincount(ids, minlength=1 << 16)))
        lanes = min(tokens.LANES, max(1, n // tokens.STEPS))
        coded = coder.encode(ids, lanes)
        assert (coder.decode(n, lanes, *coded) == ids).all()
        low = tokens.CHECKPOINT
        if n // lanes > 2 * low:
            assert (coder.decode(n, lanes, *coded, low, low + 9) == ids[low * lanes:(low + 9) * lanes]).all()
    assert len(coded[1]) * 32 / n < 9
    slots = tokens.frequencies(np.zeros(1 << 16, np.int64))
    assert slots.sum() == 1 << tokens.SCALE_BITS and slots.min() >= 1


def test_token_file_odd_cases(spark, odd, empty, vocabulary, reference, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    path = work_dir(spark, "tokens")
    tokens.write(odd, vocabulary, path)
    got = sorted(tokens.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 6]
    texts = {1: "", 2: "", 3: " \n\t", 4: LONG, 5: PROSE, 6: PROSE}
    for r in got[2:]:
        assert np.frombuffer(r.taken, "<u4").tolist() == [*reference(texts[r.doc_id]), tokens.END_ID]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    tokens.write(empty, vocabulary, path + "-empty")
    assert tokens.read(spark, path + "-empty").count() == 0


def test_damaged_blocks_are_refused(spark, odd, vocabulary):
    path = work_dir(spark, "tokens")
    tokens.write(odd.where("doc_id = 5"), vocabulary, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    (blocks.withColumn("words", F.concat(F.lit(b"\x01"), F.expr("substring(words, 2)"))).write.parquet(f"{path}-bad/blocks"))
    spark.read.parquet(f"{path}/frequencies").write.parquet(f"{path}-bad/frequencies")
    with pytest.raises(Exception, match="damaged"):
        tokens.read(spark, f"{path}-bad").collect()


def test_hashes_of_kept_lines(spark, sf_dir, documents):
    rows = queries.QUERIES["op8_line_dedup"](spark, sf_dir).where("n_dropped = 0").collect()
    assert all(r.kept_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest() for r in rows)


def test_bit_sampling_keeps_edited_windows_and_turns_others_away(documents):
    """Windows with all edits that the bound allows, at random and evenly spread places, and unrelated windows."""
    rng = random.Random(3)
    texts = [decontaminate.normal(t) for t in documents.values()]
    items = [t[k:k + rng.randint(80, 380)] for t in texts if len(t) > 1000 for k in (0, 500)][:150]
    everything = b"".join(texts)

    def edited(item, even):
        out, n = list(item), int(len(item) * decontaminate.MAX_EDITS)
        places = [int((k + 0.5) * len(item) / n) for k in range(n)] if even else sorted(rng.sample(range(len(item)), n))
        for place in reversed(places):
            letter = rng.choice(b"abcdefghijklmnopqrstuvwxyz ")
            out[place:place + 1] = rng.choice([[letter], [letter, out[place]], []])
        return bytes(out)

    for even in (False, True):
        assert decontaminate.alike([edited(item, even) for item in items], items).mean() >= 0.98
    places = [rng.randrange(len(everything) - 400) for _ in items]
    others = [everything[at:at + len(item)] for at, item in zip(places, items)]
    assert decontaminate.alike(others, items).mean() <= 0.07


def test_short_items_are_searched_too(spark):
    rows = [(1, "Seven of nine, abc def."), (2, "sevn ofnine"), (3, "xab cdex"), (4, "q"), (5, "\u00e9t\u00e9 chaud"), (6, None)]
    items = [(1, "seven"), (2, "Abc-def"), (3, "q"), (4, "..."), (5, ""), (6, "\u00c9T\u00c9"), (7, "seven ofnine"), (8, "of nine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, bench).collect()}
    want = set()
    for d, text in rows:
        for i, item in items:
            item, body = decontaminate.normal(item), decontaminate.normal(text)
            if item and decontaminate.nearest(item, body)[0] <= int(len(item) * decontaminate.MAX_EDITS):
                want.add((d, i))
    assert found == want and {(1, 1), (1, 2), (4, 3), (5, 6)} <= found


BODIES = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal""": {"mit"},
    """ * Redistributions of source code must retain the above copyright
 * notice, this list of conditions and the following disclaimer.""": {"bsd"},
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that": {"bsd"},
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public": {"gpl"},
    "you may not use this file except in compliance with the License.": {"apache"},
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted": {"isc"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "Permission to speak was granted, free of charge, to any person in the room.": None,
    "The redistribution of income and its use in source documents is discussed.": None,
    "Subject to availability, accompanying persons have waived their rights.": None,
}


def test_sentences_of_licenses_are_found_and_others_are_not(spark):
    df = spark.createDataFrame([(k,) for k in BODIES], "text string")
    for r in licenses.scan(df).collect():
        assert (set(r.found.labels) if r.found else None) == BODIES[r.doc.text], r.doc.text


def test_overlaps_are_resolved_by_priority(spark):
    """Random matches against a plain version; a match is not lost to one that is suppressed itself."""
    shape = "array<struct<start:int,minus_stop:int,minus_priority:int,rule:string,label:string,score:double>>"
    rng = random.Random(8)
    sets = [[(0, -10, -30, "a", "A", 0.8), (2, -5, -20, "b", "B", 0.7), (8, -20, -50, "c", "C", 0.9)], []]
    for _ in range(150):
        starts = [(rng.randrange(60), rng.randint(1, 12)) for _ in range(rng.randint(1, 25))]
        sets.append([(a, -a - n, -10 * rng.randint(1, 5), f"r{k}", rng.choice("ABCDE"), rng.random()) for k, (a, n) in enumerate(starts)])
    df = spark.createDataFrame([(k, rows) for k, rows in enumerate(sets)], f"k int, m {shape}")
    got = {r.k: r.found for r in df.select("k", licenses.resolve(F.col("m")).alias("found")).collect()}
    for k, rows in enumerate(sets):
        taken = []
        for m in sorted(rows, key=lambda m: (m[2], m[0], m[1], m[3])):
            if all(m[0] >= -t[1] or t[0] >= -m[1] for t in taken):
                taken.append(m)
        assert (set(got[k].labels), got[k].n) == ({m[4] for m in taken}, len(taken))
        assert got[k].score == max((m[5] for m in taken), default=0.0)
    assert set(got[0].labels) == {"B", "C"}


def test_encoder_learns_runs_together(vocabulary, reference, monkeypatch):
    """Unseen runs of many texts take few calls of the library, a cache serves all tasks of a worker, odd runs stay right."""
    encode = tokens.encoder(vocabulary)
    assert tokens.encoder(vocabulary) is encode
    rng = random.Random(4)
    odd = ["x\vy", "\v", "a\v", "a<|endoftext|>", "'s", "é", "中文", "́a", "᠎a", "​a", "\x1ca", "a b", "a\nb", "\0", "\x85"]
    word = lambda: "".join(rng.choice("abcdefgh'.,1é") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.1 else word() for _ in range(40)) for _ in range(200)]
    assert encode.encode(texts) == [np.asarray(reference(text), "<u2").tobytes() for text in texts]
    whole = []
    monkeypatch.setattr(tokens.Encoder, "_whole", lambda self, text: whole.append(text) or b"")
    plain = [" ".join(word() for _ in range(40)) for _ in range(50)]
    encode.encode(plain)
    assert not whole
    assert [text for texts in tokens._together(plain) for text in texts] == plain


def test_runs_are_cut_where_the_tokenizer_splits(vocabulary, reference):
    """Every letter that runs are cut behind, every blank, and blanks beside each other, between two texts and at their ends."""
    encode = tokens.Encoder(vocabulary)
    letters = [chr(code) for code in np.flatnonzero(encode.kinds == tokens.LETTER)]
    blanks = [chr(code) for code in np.flatnonzero(encode.kinds == tokens.BLANK)]
    texts = [f"{c}.{c}'{c}'s,{c}_{c}" for c in letters] + [f"a{c}b {c}c{c} d\n{c}e {c}" for c in blanks]
    texts += ["", " ", "a ", "a  ", " a", "\na", "a\n", "", "a\n\nb\nc", "x'.s 's'.t '#s", "#'s", "日本.a b。c", "é\né\n×.", "  <|endoftext|> a", "😀.a\n😀"]
    assert encode.encode(texts) == [np.asarray(reference(text), "<u2").tobytes() for text in texts]


def test_encoder_keeps_what_it_uses(vocabulary, reference, monkeypatch):
    """Words are learned once, whatever punctuation and lines they stand in, and those in use outlast a full cache."""
    encode = tokens.Encoder(vocabulary)
    learned = []
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda runs: learned.extend(runs) or learn(runs))
    words = ["Alpha", "béta", "gamma"]
    texts = [f"x {word}{end}" for word in words for end in ("", ".", ",", ")", ".\nx", " z")]
    assert [encode(text) for text in texts] == [np.asarray(reference(text), "<u2").tobytes() for text in texts]
    assert all(sum(word in run for run in learned) == 1 for word in words)
    monkeypatch.setattr(tokens, "CACHE", 100)
    learned.clear()
    for n in range(40):
        text = " ".join(["x", *words, *(f"w{n}v{k}" for k in range(20))])
        assert encode(text) == np.asarray(reference(text), "<u2").tobytes()
        assert len(encode.runs) + len(encode.old) <= 200
    assert not set(learned) & {" " + word for word in words}
