"""Wrapper induction and WARC derivatives against brute force, round trips and odd cases."""

import html as std
import random
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from logweir.llm import queries, warc, wrapper
from logweir.llm.html import blocks, parse
from logweir.llm.text import table


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url", "html").collect()


def article(page):
    """The blocks of the only article of the test pages."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|ul|li|div|table|tr|td|h2|h3|blockquote|pre)\b[^>]*>", inner)
    texts = (" ".join(std.unescape(re.sub(r"<br[^>]*>", " ", part).replace("<b>", "").replace("</b>", "")).split()) for part in parts)
    return "\n\n".join(text for text in texts if text)


def test_articles_of_all_pages(spark, sf_dir, pages):
    rows = {r.page_id: r for r in queries.QUERIES["op1_html_wrapper"](spark, sf_dir).collect()}
    assert len(rows) == len(pages)
    for page in pages:
        got = rows[page.page_id]
        assert (got.url, got.text, got.n_chars) == (page.url, article(page.html), len(got.text))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
<main><h1>Title %(n)s</h1><p class=lead>First &amp; <b>bold</b>
 text %(n)s<br>after break<p>Second%(n)s <a href="/x?a>b">link</a>, unclosed<ul><li>One %(n)s<li>Two</ul>
<div class="share-buttons">Tweet</div><form><p>Name<input></form><!-- <p>hidden</p> --><table><tr><td>c%(n)s<td>d</table>
<section id="comments"><p>I like it %(n)s</p></section></main>
<aside>Other</aside><footer>&copy; Site</footer></body></html>"""


def test_zones_blocks_and_references():
    found = [block.text for block, _ in wrapper.candidate_blocks(parse(PAGE % {"n": 1}))]
    assert found == ["Title 1", "First & bold text 1 after break", "Second1 link, unclosed", "One 1", "Two", "c1", "d"]


def test_layout_classes_are_not_zones():
    page = '<body class="with-sidebar"><div class="content-with-sidebar"><p>Text one.</p></div><div class=sidebar>x</div>'
    assert [b.text for b, _ in wrapper.candidate_blocks(parse(page))] == ["Text one."]


def test_constant_nodes_are_template(spark):
    """Without any telling tag, what is the same on all pages of a host goes, what varies stays."""
    shape = "<body><div><span>Daily news</span></div><div><p>Story %d by the staff.</p><p>More of story %d.</p></div><div>Back to top</div>"
    rows = [(i, f"http://a.example/{i}", shape % (i, i)) for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", shape % (i, i)) for i in range(3)]
    got = {r.page_id: r for r in wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[7].text == "Story 7 by the staff.\n\nMore of story 7." and got[7].n_template == 2
    assert got[101].text.startswith("Daily news") and got[101].n_template == 0


@pytest.mark.parametrize("tag, copies", [("div", 40), ("article", 400)])
def test_copies_of_a_page_are_no_template(spark, tag, copies):
    """A host that is mostly copies of one article keeps it; what all its different pages share still goes."""
    shape = f"<body><div><{tag}><span>Daily news</span><p>Story %d by the staff.</p><p>More of story %d.</p></{tag}></div>"
    rows = [(i, f"http://a.example/{i}", shape % (i, i)) for i in range(12)]
    rows += [(100 + i, f"http://a.example/copy{i}", shape % (99, 99)) for i in range(copies)]
    rows += [(1000 + i, "http://b.example/", shape % (5, 5)) for i in range(20)]
    rows += [(2000 + i, f"http://c.example/{i}", "<body><div><p>Story %d.</p></div>%s" % (i, "<div><p>Well said.</p></div>" * (9 * (i < 3))))
             for i in range(12)]
    got = {r.page_id: r for r in wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[7].text == "Story 7 by the staff.\n\nMore of story 7." and got[7].n_template == 1
    assert all(got[100 + i].text == "Story 99 by the staff.\n\nMore of story 99." for i in range(copies))
    assert all("Story 5 by the staff." in got[1000 + i].text for i in range(20))
    assert "Well said." in got[2001].text and got[2005].text == "Story 5."


def test_each_layout_has_its_own_reference(spark):
    """NULL and empty pages are no reference, and a layout on a tenth of a host's pages has its template found."""
    article_page = "<body><header><p>Top</p></header><div><p>Box</p><p>Story %d here.</p></div>"
    plain_page = "<body><div><span>Forum</span></div><div><p>Post %d here.</p></div><div><i>Rules</i></div>"
    rows = [(1, "http://a.example/1", None), (2, "http://a.example/2", "")]
    rows += [(i, f"http://a.example/{i}", article_page % i) for i in range(10, 100)]
    rows += [(i, f"http://a.example/{i}", plain_page % i) for i in range(100, 110)]
    got = {r.page_id: r for r in wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == got[2].text == ""
    assert all(got[i].text == f"Story {i} here." and got[i].n_template == 2 for i in range(10, 100))
    assert all(got[i].text == f"Post {i} here." and got[i].n_template == 2 for i in range(100, 110))


def test_template_is_found_without_zones(spark):
    """With no list of tags and words to help, the frame of a host goes by induction alone."""
    frame = ('<body><nav><ul><li>Home</li><li>News</li></ul></nav><div class="cookie-notice">We use cookies.</div>'
             "<div><h1>Title %d</h1>%s</div><div class=related><p>Read next</p></div><footer>About us</footer>")
    body = [[f"Paragraph {k} of page {i}." for k in range(1 + i % 5)] for i in range(12)]
    rows = [(i, f"http://a.example/{i}", frame % (i, "".join(f"<p>{p}</p>" for p in body[i]))) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for zones in (True, False):
        got = {r.page_id: r for r in wrapper.extract(df, zones=zones).collect()}
        assert all(r.n_template == 5 for r in got.values())
        assert {i: r.text for i, r in got.items()} == {i: "\n\n".join([f"Title {i}", *body[i]]) for i in range(12)}


@pytest.mark.parametrize("page, other", [
    ("<p>a b c" * 60000, "<p>a b c" * 50000),
    ("<div>" * 100_000 + "<p>a", "<div>" * 100_000 + "<h1>b"),
    ("<a " * 20000, "<a " * 20000 + ">"),
    ('<a ">" ' * 20000 + '"', "<b>" * 50000 + "</i>" * 50000),
    ("<p><b>" * 30000, "<li><table>" * 20000 + "</q>" * 20000),
])
def test_long_and_hostile_pages_take_little(page, other):
    """Pages of up to 500 KB, in seconds and without a table of all pairs of nodes."""
    tracemalloc.start()
    begun = time.process_time()
    root = parse(page)
    wrapper.marked_blocks(root)
    wrapper.align(wrapper.Shape(root), wrapper.Shape(parse(other)))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert time.process_time() - begun < 60 and peak < 500 << 20


def test_alignment_of_many_different_children():
    """The rows kept in memory are enough to find a largest matching of long lists."""
    rng = random.Random(5)
    parts = ["<p>x</p>", "<h2>y</h2>", "<ul><li>z</ul>", "<div><p>q</div>", "<ul><li>z<li>w</ul>", "<div><h2>a</h2><p>b</div>"]
    for size in (1, 2, 7, 30, 120):
        a, b = (wrapper.Shape(parse("".join(rng.choice(parts) for _ in range(size)))) for _ in range(2))
        matched = wrapper.align(a, b)
        assert len(matched) == brute_match(0, 0, a, b) and len(set(matched.values())) == len(matched)
        assert all(a.labels[x] == b.labels[y] for x, y in matched.items())


def test_join_beyond_the_broadcast_bound_gives_the_same(spark, sf_dir, monkeypatch):
    want = {tuple(r) for r in queries.QUERIES["op1_html_wrapper"](spark, sf_dir).collect()}
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in queries.QUERIES["op1_html_wrapper"](spark, sf_dir).collect()} == want


def brute_match(a, b, page, reference):
    """Simple tree matching as it is usually written down."""
    if page.labels[a] != reference.labels[b]:
        return 0
    xs, ys = page.children[a], reference.children[b]
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + brute_match(x, y, page, reference))
    return table[-1][-1] + 1


def test_alignment_is_a_largest_matching(pages):
    shapes = [wrapper.Shape(parse(p.html)) for p in pages[:6]] + [wrapper.Shape(parse(PAGE % {"n": 2}))]
    for a in shapes:
        for b in shapes:
            matched = wrapper.align(a, b)
            assert len(matched) == brute_match(0, 0, a, b)
            assert len(set(matched.values())) == len(matched)
            assert all(a.labels[x] == b.labels[y] for x, y in matched.items())


@pytest.mark.parametrize("bad", [
    "", "plain text", "<", "<p", "<p>a</q></p>b", "<b><i>x</b>y</i>", "<!-- open", "<script>never closed", "</p></div>",
    "<p a='>'>q</p>", '<p title="unclosed>x</p>', "<ul><li>a<li>b<ul><li>c</ul><li>d", "<table><tr><td>1<tr><td>2", "&#0;&bogus;&#x110000;",
    "<div>" * 5000 + "deep",
])
def test_bad_markup(bad):
    root = parse(bad)
    assert isinstance([b.text for b in blocks(root)], list)
    wrapper.align(wrapper.Shape(root), wrapper.Shape(parse(bad + "<p>x")))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None), (2, "http://h.example/a", ""), (2, "http://h.example/a", ""), (None, "no url", "<p>x</p>"),
            (4, "HTTP://H.example:80/b", "<article>" + "<p>para graph</p>" * 3000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return df.select("*", *[F.lit(n).alias(n) for n in ("host", "reference", "found", "text", "template", "key", "record_id", "payload")])


def test_extract_odd_cases(odd):
    got = {(r.page_id, r.url): r for r in wrapper.extract(odd).collect()}
    assert wrapper.extract(odd).count() == 5 and got[1, None].text == "" and got[1, None].n_chars == 0
    assert got[2, "http://h.example/a"].text == "" and got[None, "no url"].text == "x"
    assert got[4, "HTTP://H.example:80/b"].text == "\n\n".join(["para graph"] * 3000)
    assert wrapper.extract(odd.where("page_id > 9")).count() == 0


# --- WARC -------------------------------------------------------------------------------------------------


def test_records_link_to_their_response_and_survive_a_file(spark, sf_dir, pages):
    responses = {r.page_id: r for r in warc.responses_of_pages(table(spark, sf_dir, "pages", "page_id", "url", "html")).collect()}
    rows = queries.QUERIES["op10_warc_derivatives"](spark, sf_dir).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    data = b"".join(warc.to_bytes(r.headers, r.block) for r in rows)
    assert data == b"".join(warc.to_bytes(r.headers, r.block) for r in rows)
    for row, (fields, block) in zip(rows, warc.read_records(data), strict=True):
        source = responses[row.page_id]
        assert block.decode() == row.block and int(fields["Content-Length"]) == len(block) == row.n_bytes
        assert fields["WARC-Refers-To"] == source.record_id == row.refers_to
        assert fields["WARC-Target-URI"] == fields["WARC-Refers-To-Target-URI"] == source.target_uri
        assert fields["WARC-Block-Digest"] == warc.digest(block)
        assert fields["WARC-Source-Payload-Digest"] == warc.digest(source.payload.encode()) == row.source_digest
        assert fields["WARC-Type"] == row.record_type and fields["WARC-Record-ID"] == row.record_id
        if row.record_type == "metadata":
            assert "http-status: 200\r\n" in row.block
            assert f"source-header: Content-Length: {len(source.payload.encode())}\r\n" in row.block
        else:
            assert all(part in row.block.split("\n") for part in article(source.payload).split("\n\n"))


def test_plain_files_and_cut_off_files():
    record = warc.derive_record("<urn:x>", "http://a/\r\nInjected: yes", "2024-01-01T00:00:00Z", "HTTP/1.1 404 No\r\nX: 1\r\n", "<p>a")
    plain = b"".join(f"{r['headers']}\r\n{r['block']}\r\n\r\n".encode() for r in record)
    fields = [f for f, _ in warc.read_records(plain)]
    assert len(fields) == 2 and "Injected" not in fields[0]
    assert "http-status: 404" in record[0]["block"] and record[1]["block"] == "a\n"
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records(plain[:-10]))


def test_derivatives_odd_cases(odd):
    rows = warc.derive(warc.responses_of_pages(odd), "page_id").collect()
    assert len(rows) == 10
    by = {(r.key, r.record_type): r for r in rows}
    assert by[1, "conversion"].block == "" and by[1, "conversion"].target_uri is None
    assert "WARC-Target-URI" not in by[1, "metadata"].headers
    assert len({r.record_id for r in rows if r.key == 2}) == 2
    assert warc.derive(warc.responses_of_pages(odd.where("page_id > 9")), "page_id").count() == 0
