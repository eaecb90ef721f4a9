"""Main-text extraction by wrapper induction over the pages of a host.

1. Pages of a host that use the same structural tags share a layout. Each layout has a reference page (of its pages
   with html the one with the smallest id, by a partial aggregate), written to the shared folder.
2. Every page's tree is aligned with its reference by simple tree matching: equal roots match, and the children are
   matched in order so that most nodes match. This gives each text block the number of the reference node it stands
   in, or none.
3. Over *all* pages of the layout, a reference node whose text is the same on nearly all of them is a constant:
   template. A node whose text varies is a slot. Blocks of navigation, footers and the like take part as all others.
   Pages with the same content blocks at the same nodes, such as copies and recrawls, count as one page, and a text
   counts once a page, however often it stands there. Four different pages can show a template; inside an explicit
   article, where two edited copies share whole paragraphs, it takes ``ARTICLE_PAGES``.
4. A page's text is its slots, without those in zones that never hold the article but vary: navigation, headers,
   footers, sidebars, notices, adverts, forms, comments (by tag, role, and the words of class and id), and
   without blocks that are nearly all links. Where a page has an ``article`` or ``main``, only that counts.

Aligned blocks are written once to the shared folder, as both step 3 and step 4 read them; blocks that can only be
template are kept as a hash. While all reference pages together are at most ``BROADCAST_BYTES`` they are broadcast and
pages never cross the network; beyond it they are joined by host and layout, and Spark splits the join partition of a
host that has a third of all pages. The table of constants is broadcast up to the same size. Constants are counted with
map-side sums. A task holds one page and reference trees of at most ``CACHED_NODES`` nodes and one more.

Very long pages: reading is linear in the length whatever the markup. Equal subtrees are matched as a whole, and the
children of two nodes in memory linear in their number; only different subtrees of the same label are compared pair by pair.

Defined results: NULL and empty html give an empty text; a NULL or unreadable url belongs to the host '';
a layout with fewer than ``MIN_PAGES`` different pages has no constants, as nothing could tell them from content; rows
with the same page id stay apart; an empty table gives an empty result; only the three named columns are read, so
extra ones never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial
from math import isqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.components import stored
from logweir.llm.html import INLINE, RAW, VOID, Block, Node, blocks, parse

MIN_PAGES = 4
CONSTANT_SHARE = 0.6
# Inside an explicit article a block must be nearly everywhere, on more pages, to count as template.
ARTICLE_PAGES = 8
ARTICLE_SHARE = 0.95
LINK_SHARE = 0.7
BROADCAST_BYTES = 32 << 20
CACHED_NODES = 200_000
STRUCTURE = r"(?i)<(article|main|section|aside|nav|header|footer|form)[\s/>]"
ZONE, INSIDE = 1, 2
ZONE_TAGS = frozenset("nav header footer aside form button select input dialog menu head noscript".split())
ZONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu alert".split())
ZONE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert "
    "adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus reply replies respond form search pagination pager toolbar tags byline copyright legal".split())
# A class such as "content with-sidebar" names a layout, not a sidebar.
CONTENT_WORDS = frozenset("article content main post entry body story wrapper container layout page with has".split())
BLOCKS = "array<struct<node:int,inside:boolean,hash:bigint,text:string>>"


def zone(node: Node) -> bool:
    """Whether the element opens a part that never holds the article."""
    if node.tag in ZONE_TAGS:
        return True
    if not node.attributes or node.tag in ("html", "body", "article", "main"):
        return False
    if node.has("hidden") or node.get("aria-hidden") == "true" or "display:none" in node.get("style").replace(" ", ""):
        return True
    if set(node.get("role").split()) & ZONE_ROLES:
        return True
    named = set(re.split(r"[^a-z]+", node.get("class", "id")))
    return bool(named & ZONE_WORDS) and not named & CONTENT_WORDS


def label(node: Node) -> str:
    return f"{node.tag}.{node.get('class')}" if node.attributes else node.tag


class Shape:
    """The block-level skeleton of a page, as arrays: labels and child numbers in document order."""

    def __init__(self, root: Node) -> None:
        self.labels: list[str] = []
        self.children: list[list[int]] = []
        self.number: dict[int, int] = {}
        work: list[tuple[Node, int]] = [(root, -1)]
        while work:
            node, parent = work.pop()
            k = len(self.labels)
            self.number[id(node)] = k
            self.labels.append(label(node))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(k)
            work.extend((item, k) for item in reversed(node.items)
                        if not isinstance(item, str) and item.tag not in INLINE and item.tag not in VOID
                        and item.tag not in RAW)


class Kinds:
    """Numbers for equal subtrees, and the size of the largest matching between any two of them."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, shape: Shape) -> list[int]:
        """The kind of each node's subtree."""
        kinds = [0] * len(shape.labels)
        for k in range(len(kinds) - 1, -1, -1):  # children come after their parents
            below = tuple(kinds[c] for c in shape.children[k])
            kind = self.known.setdefault((shape.labels[k], below), len(self.labels))
            if kind == len(self.labels):
                self.labels.append(shape.labels[k])
                self.children.append(below)
                self.sizes.append(1 + sum(self.sizes[c] for c in below))
            kinds[k] = kind
        return kinds

    def score(self, p: int, q: int) -> int:
        if p == q:
            return self.sizes[p]
        if self.labels[p] != self.labels[q]:
            return 0
        return self.scores[p, q] if self.children[p] and self.children[q] else 1

    def solve(self, p: int, q: int) -> None:
        """Score the pair and all pairs that it needs, deepest first, without recursion."""
        work = [(p, q, False)]
        while work:
            p, q, ready = work.pop()
            if (p, q) in self.scores or p == q or not self.children[p] or not self.children[q]:
                continue
            xs, ys, same = trimmed(self.children[p], self.children[q])
            if ready:
                rest = Rows(self, xs, ys).last()[-1] if xs and ys else 0
                self.scores[p, q] = 1 + sum(self.sizes[x] for x in same) + int(rest)
            else:
                work.append((p, q, True))
                alike = by_label(self, ys)
                work.extend((x, y, False) for x in dict.fromkeys(xs) for y in alike.get(self.labels[x], ()))


def trimmed(xs: Sequence[int], ys: Sequence[int]) -> tuple[Sequence[int], Sequence[int], Sequence[int]]:
    """Both lists without what they have in common at their ends, and that. To match equal ends is never worse."""
    n = min(len(xs), len(ys))
    front = next((k for k in range(n) if xs[k] != ys[k]), n)
    back = next((k for k in range(n - front) if xs[-1 - k] != ys[-1 - k]), n - front)
    return xs[front:len(xs) - back], ys[front:len(ys) - back], (*xs[:front], *xs[len(xs) - back:])


def by_label(kinds: Kinds, ys: Sequence[int]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for y in dict.fromkeys(ys):
        found.setdefault(kinds.labels[y], []).append(y)
    return found


class Rows:
    """The rows of the alignment of two lists of subtrees, one after the other, each a vector."""

    def __init__(self, kinds: Kinds, xs: Sequence[int], ys: Sequence[int]) -> None:
        self.kinds, self.xs, self.ys = kinds, xs, ys
        self.place = {y: k for k, y in enumerate(dict.fromkeys(ys))}
        self.which = np.array([self.place[y] for y in ys], dtype=np.int64)
        self.alike = by_label(kinds, ys)
        self.first = np.zeros(len(ys) + 1, dtype=np.int64)

    def after(self, row: np.ndarray, x: int) -> np.ndarray:
        gain = np.zeros(len(self.place), dtype=np.int64)
        for y in self.alike.get(self.kinds.labels[x], ()):
            gain[self.place[y]] = self.kinds.score(x, y)
        below = self.first.copy()
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain[self.which]), out=below[1:])
        return below

    def last(self) -> np.ndarray:
        row = self.first
        for x in self.xs:
            row = self.after(row, x)
        return row

    def pairs(self) -> list[tuple[int, int]]:
        """Places of a best alignment. Every so many rows one is kept, and those between are computed again."""
        step = isqrt(len(self.xs)) + 1
        row, kept = self.first, []
        for i, x in enumerate(self.xs):
            if i % step == 0:
                kept.append(row)
            row = self.after(row, x)
        out = []
        i, j = len(self.xs), len(self.ys)
        while kept and j:
            low, rows = (len(kept) - 1) * step, [kept.pop()]
            for x in self.xs[low:i]:
                rows.append(self.after(rows[-1], x))
            while i > low and j:
                here = rows[i - low][j]
                if here == rows[i - low - 1][j]:
                    i -= 1
                elif here == rows[i - low][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return out


def align(page: Shape, reference: Shape) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping map of nodes onto equal nodes with matched parents."""
    if page.labels[0] != reference.labels[0]:
        return {}
    kinds = Kinds()
    left, right = kinds.of(page), kinds.of(reference)
    kinds.solve(left[0], right[0])
    matched = {}
    work = [(0, 0)]
    while work:
        a, b = work.pop()
        matched[a] = b
        xs, ys = page.children[a], reference.children[b]
        if left[a] == right[b]:
            work.extend(zip(xs, ys))
            continue
        mine, theirs = [left[x] for x in xs], [right[y] for y in ys]
        inner, outer, _ = trimmed(mine, theirs)
        front = next((k for k in range(min(len(xs), len(ys))) if mine[k] != theirs[k]), min(len(xs), len(ys)))
        back = len(xs) - front - len(inner)
        work.extend(zip(xs[:front], ys[:front]))
        work.extend(zip(xs[len(xs) - back:], ys[len(ys) - back:]))
        if inner and outer:
            work.extend((xs[front + i], ys[front + j]) for i, j in Rows(kinds, inner, outer).pairs())
    return matched


def marks(node: Node) -> int:
    explicit = node.tag in ("article", "main") or "main" in node.get("role").split()
    return (ZONE if zone(node) else 0) | (INSIDE if explicit else 0)


def marked_blocks(root: Node, zones: bool = True) -> tuple[list[Block], list[bool]]:
    """All blocks of the page, and which of them can be content; without ``zones`` all that are not mostly links."""
    found = blocks(root, zone, marks) if zones else blocks(root)
    fits = [not block.marks & ZONE and (block.linked <= LINK_SHARE * len(block.text) or block.holder.tag[0] == "h"
                                        or bool(block.marks & INSIDE)) for block in found]
    explicit = any(fit and block.marks & INSIDE for block, fit in zip(found, fits))
    return found, [fit and (not explicit or bool(block.marks & INSIDE)) for block, fit in zip(found, fits)]


def candidate_blocks(root: Node) -> list[tuple[Block, bool]]:
    """Blocks that can be content, each with whether it stands in an article or main."""
    return [(block, bool(block.marks & INSIDE)) for block, fit in zip(*marked_blocks(root)) if fit]


def _aligned(batches: Iterator[pd.DataFrame], zones: bool) -> Iterator[pd.DataFrame]:
    shapes: dict[str, Shape] = {}
    for batch in batches:
        rows = []
        for html, reference in zip(batch["html"], batch["reference"]):
            root = parse(html or "")
            found, fits = marked_blocks(root, zones)
            if not found:
                rows.append([])
                continue
            if (reference or "") not in shapes:
                if sum(len(shape.labels) for shape in shapes.values()) > CACHED_NODES:
                    shapes.clear()
                shapes[reference or ""] = Shape(parse(reference or ""))
            shape = Shape(root)
            at = align(shape, shapes[reference or ""])
            row = []
            for block, fit in zip(found, fits):
                node = at.get(shape.number.get(id(block.holder), -1), -1)
                if fit or node >= 0:
                    row.append({"node": node, "inside": bool(fit and block.marks & INSIDE),
                                "hash": xxhash.xxh64_intdigest(block.text.encode("utf-8", "replace")) - (1 << 63),
                                "text": block.text if fit else None})
            rows.append(row)
        yield pd.DataFrame({**{name: batch[name] for name in ("page_id", "url", "host", "layout")}, "found": rows})


def layout(html: Column) -> Column:
    """Which structural tags a page uses: pages with the same ones are taken to come from one layout."""
    tags = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(STRUCTURE), F.lit(1)), F.lower)
    return F.array_join(F.array_sort(F.array_distinct(tags)), " ")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = CONSTANT_SHARE, zones: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page, and the number of template blocks taken out.

    Without ``zones`` no tag or class says what is content: induction alone does.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"), layout(F.col("html")).alias("layout"))
    first = F.struct(F.col("page_id").isNull(), "page_id", F.length("html"), "html")
    references = stored(rows.where(F.length("html") > 0).groupBy("host", "layout").agg(
        F.min(first)["html"].alias("reference")), "references")
    size = references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    sent = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    aligned = stored(rows.join(sent(references), ["host", "layout"], "left").select(
        "page_id", "url", "host", "layout", "html", "reference").mapInPandas(
        partial(_aligned, zones=zones), f"page_id bigint, url string, host string, layout string, found {BLOCKS}"), "wrapper")

    content = F.transform(F.filter("found", lambda b: b["text"].isNotNull()), lambda b: F.struct(b["node"], b["hash"]))
    known = aligned.select("host", "layout", "found", F.xxhash64(content).alias("page"))
    sizes = (known.select("host", "layout", "page").distinct().groupBy("host", "layout").agg(F.count("*").alias("pages"))
             .where(F.col("pages") >= min_pages))
    texts = (known.select("host", "layout", "page", F.explode("found").alias("b")).where("b.node >= 0")
             .select("host", "layout", "page", "b.node", "b.inside", "b.hash").distinct()
             .groupBy("host", "layout", "node", "inside", "hash").agg(F.count("*").alias("n"))
             .where(F.col("n") >= min_pages))
    need = F.when(F.col("inside"), F.greatest(F.lit(ARTICLE_SHARE) * F.col("pages"), F.lit(ARTICLE_PAGES))).otherwise(
        F.lit(share) * F.col("pages"))
    template = stored(texts.join(sizes, ["host", "layout"]).where(F.col("n") >= need).groupBy("host", "layout")
                      .agg(F.collect_set(F.struct("node", "hash")).alias("template")), "template")
    constants = template.agg(F.sum(F.size("template") * 16 + F.octet_length("host"))).first()[0] or 0
    sent = F.broadcast if constants <= BROADCAST_BYTES else (lambda df: df)

    def constant(block: Column) -> Column:
        return F.coalesce(F.array_contains("template", F.struct(block["node"].alias("node"), block["hash"].alias("hash"))),
                          F.lit(False))

    kept = aligned.join(sent(template), ["host", "layout"], "left").select(
        "page_id", "url", F.size(F.filter("found", constant)).cast("int").alias("n_template"),
        F.filter("found", lambda block: block["text"].isNotNull() & ~constant(block)).alias("kept"))
    text = F.array_join(F.transform("kept", lambda block: block["text"]), "\n\n")
    return kept.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), "n_template")
