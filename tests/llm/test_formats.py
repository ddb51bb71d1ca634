"""HTML, JPEG and WARC, and the pipeline."""

import hashlib
import time
import tracemalloc
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import same
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from brainstate.llm import media, warc, warc_query
from brainstate.llm.common import new_folder
from brainstate.llm.html_extract import extract, main_text
from brainstate.llm.queries import QUERIES, SQL

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header><a href=/>Site</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies, and more cookies.</div><article><h1>A &amp; B</h1>
<p><b>First   part<br>goes on, with <a href=x>a link</a>.<p>Second &eacute; part; it is longer, and has marks.</p>
<!-- <p>hidden</p> --><div class="ad">Buy now, buy here.</div></article>
<div id="comments"><p>I agree, this is a long reader comment, with marks.</p></div>
<form><label>Name</label><input></form><aside>Related: one, two.</aside><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "A & B\nFirst part goes on, with a link.\nSecond é part; it is longer, and has marks."


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post"'])
def test_short_blocks_of_an_article(tag):
    """Lists, tables, code and quotes beside long paragraphs."""
    long = ["many words of one part, " * 16 + f"part {i}." for i in range(3)]
    short = [f"item {i} without any marks" for i in range(5)]
    parts = [
        "<h1>Title</h1>", f"<p>{long[0]}</p>", f"<p>{long[1]}</p>", "<ul>", *(f"<li>{x}</li>" for x in short), "</ul>",
        "<table><tr><td>cell</td><td>2</td></tr></table>", "<pre><code>x = 1</code></pre>",
        "<blockquote>quoted</blockquote>", f"<p>{long[2]}</p>",
    ]
    page = f"<html><body><nav><a href=/>Home</a></nav><{tag}>{''.join(parts)}</{tag.split()[0]}><p>Out</p></body></html>"
    assert main_text(page) == "\n".join(["Title", *long[:2], *short, "cell", "2", "x = 1", "quoted", long[2]])


def test_links_and_captions_of_an_article():
    inside = "<p>Long text, with marks, and more.</p><figure><figcaption>Caption</figcaption></figure><p><a href=x>Source</a></p><address>Me</address>"
    assert main_text(f"<article>{inside}</article><address>Site</address>") == "Long text, with marks, and more.\nCaption\nSource\nMe"


class Articles(HTMLParser):
    """Blocks of the article elements of pages of the given shape, by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.blocks, self.text, self.depth, self.out = [], "", 0, 0
        self.feed(html)
        self.close()
        self.end_block()

    def end_block(self):
        if text := " ".join(self.text.split()):
            self.blocks.append(text)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag == "br":
            self.text += " "
        elif tag != "b":
            self.end_block()
        self.out += tag == "div" and ("class", "ad") in attrs

    def handle_endtag(self, tag):
        if tag != "b":
            self.end_block()
        self.depth -= tag == "article"
        self.out -= tag == "div" and self.out > 0

    def handle_data(self, data):
        if self.depth and not self.out:
            self.text += data


def test_given_pages_equal_a_parser():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    for html in pages:
        assert main_text(html) == "\n".join(Articles(html or "").blocks)
    assert len(pages) > 100


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p title=it's>First, part.</p><p>It doesn't stop.</p><p>Don't.</p></article>", "First, part.\nIt doesn't stop.\nDon't."),
        ("<article><p title='a>b' data-x=\"c>d\">One, two.</p></article>", "One, two."),
        ("<article><p title = \"x>y\" 'odd>One, two.</p></article>", "One, two."),
        ("<article><p title=\"never closed>One, two.</p></article>", "One, two."),
        ("<article><div class=\"article-header\"><h1>Title</h1></div><p>One, two, three.</p></article>", "Title\nOne, two, three."),
        ("<div class='post'><div class='entry-header'><h2>Title</h2></div><p>One, two, three.</p></div>", "Title\nOne, two, three."),
        ("<div class='site-header'>Menu, site.</div><article><p>One, two.</p></article>", "One, two."),
        ("<article><p data-note='class=ad'>One, two.</p></article>", "One, two."),
        ("<article><p>1 < 2, and a<b.</p></article>", "1 < 2, and a"),
        ("<article><p>One, two. a <b", "One, two. a <b"),
    ],
)
def test_attributes_and_headers(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("part", ["<a ", "<a b='", '<a b="', "<!", "<!--", "<script", "<script>", "</script ", "<a b=", "<p x='>", "&", "<div>", "</p>", '<a =""'])
def test_bad_markup_takes_linear_time(part):
    began = time.process_time()
    main_text("<article><p>One.</p>" + part * (300_000 // len(part)))
    main_text("<script>" + part * (300_000 // len(part)) + "<p>x")
    assert time.process_time() - began < 8


DEEP = ["<div>" * 60_000, "<b>" * 50_000 + "</i>" * 37_500, "<div>" * 30_000 + "</section>" * 15_000, "<div>" + "<b>" * 50_000 + "<div></div>" * 13_000,
        "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<div class=ad>" * 20_000 + "<article>x"]


@pytest.mark.parametrize("page", DEEP, ids=range(len(DEEP)))
def test_deep_pages_take_linear_time_and_memory(page):
    tracemalloc.start()
    began = time.process_time()
    main_text(page[: len(page) // 2])
    half, half_s = tracemalloc.get_traced_memory()[1], time.process_time() - began
    tracemalloc.reset_peak()
    began = time.process_time()
    main_text(page)
    whole, whole_s = tracemalloc.get_traced_memory()[1], time.process_time() - began
    tracemalloc.stop()
    assert whole < 100e6 and whole < 2.6 * half + 1e6
    assert whole_s < 3.5 * half_s + 1


LONG = "Long text, with marks, and more of it. " * 5


@pytest.mark.parametrize(
    ("html", "n"),
    [
        ('<div class="page no-sidebar"><article>{}</article></div>', 1),
        ('<article class="post alert-news">{}</article>', 1),
        ('<body class="nav-open"><div class="site widget"><main>{}</main><div class="related"><article>{}</article></div></div></body>', 1),
        ('<div class="layout right-sidebar"><div class="content">{}</div><div class="sidebar">{}</div></div>', 1),
        ('<form id="aspnetForm"><div class="main">{}</div><div class="site-footer">{}</div></form>', 1),
        ('<article>{}<div id="disqus_thread">{}</div></article>', 1),
        ('<article>{}</article><div id="comments" class="comments-area"><article class="comment-body">{}</article></div>', 1),
        ('<article>{}<article class="comment even">{}</article></article>', 1),
        ('<div class="post comments-open">{}</div>', 1),
        ('<article>{}</article><form>{}</form><div class="social-share">{}</div>', 1),
        ('<nav>{}</nav><div class="ad">{}</div>', 0),
        ('<div class="ad-wrapper">{}</div><div class="promo">{}</div>', 0),
    ],
)
def test_wrappers_of_themes(html, n):
    """The first text is the article."""
    texts = [f"{name} {LONG}".strip() for name in ("one", "two", "three")]
    got = main_text(html.format(*(f"<p>{x}</p>" for x in texts)))
    assert got == "\n".join(texts[:n])


@pytest.mark.parametrize("html", [None, "", "<", "<p", "plain", "<script>", "<!-- x", "</p></b>", "<p>a<p>b", "<b><i>x</b></i>" * 50, "<div>" * 3000 + "deep"])
def test_broken_pages(html):
    assert isinstance(main_text(html), str)


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, "", "y")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(main_text(PAGE))), (2, 0), (2, 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    odd = spark.createDataFrame([(1, PAGE, "old", 2)], "`page.id` long, html string, text string, `a b` int")
    assert extract(odd).select("`page.id`", "`a b`", "n_chars").collect() == [(1, 2, len(main_text(PAGE)))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700) | st.sampled_from([b"\x80" * 300, b"\xff" * 130, bytes(64)]), min_size=1, max_size=5))
def test_media_round_trip(values):
    payloads = [v + bytes(max(64, -(-len(v) // 64) * 64) - len(v)) for v in values]
    files = media.encode(payloads)
    for p, data, (back, image, thumbnail) in zip(payloads, files, media.decode(files), strict=True):
        assert back == p
        assert data[:4] == b"\xff\xd8\xff\xe0" and data[-2:] == b"\xff\xd9"
        assert thumbnail.shape == (image.height // 8, image.width // 8)


def dc_of(data):
    """DC coefficients and step of a baseline image with one component, bit by bit as the standard's flow charts read it."""
    at, tables, restart = 2, {}, 0
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif marker == 0xDB:
            step = body[1]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC4:
            while body:
                counts, symbols, code, table = body[1:17], iter(body[17:]), 0, {}
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = next(symbols)
                        code += 1
                    code <<= 1
                tables[body[0]] = table
                body = body[17 + sum(counts) :]
        elif marker == 0xDA:
            break
    bits, out = iter(()), []

    def refill():
        nonlocal at
        while data[at] != 0xFF or data[at + 1] == 0:
            byte, at = data[at], at + 1 + (data[at] == 0xFF)
            yield from (byte >> k & 1 for k in range(7, -1, -1))

    def symbol(table):
        code = length = 0
        while (length, code) not in table:
            code, length = code << 1 | next(bits), length + 1
        return table[length, code]

    def number(size):
        v = sum(next(bits) << k for k in range(size - 1, -1, -1))
        return v if not size or v >> size - 1 else v - (1 << size) + 1

    for block in range(-(-width // 8) * -(-height // 8)):
        if block == 0 or restart and block % restart == 0:
            at += 2 * (block > 0)  # the restart marker
            bits, last = refill(), 0
        last += number(symbol(tables[0x00]))
        out.append(last)
        k = 1
        while k < 64:
            x = symbol(tables[0x10])
            if x == 0:
                break
            k += (x >> 4) + 1
            number(x & 15)
    return np.array(out), step


@pytest.mark.parametrize("text", ["", "plain words, many of them. " * 400, "длинный текст " * 300, "\x80\xff" * 700])
def test_thumbnails_equal_an_independent_decoder(text):
    raw = text.encode()
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    (data,) = media.encode([payload])
    ((_, image, thumbnail),) = media.decode([data])
    dc, step = dc_of(data)
    expected = np.clip(dc * step / 8 + 128, 0, 255).reshape(image.rows, image.columns)
    assert (dc[: len(payload) // 64] == np.frombuffer(payload, np.uint8)[::64].astype(int) - 128).all()
    assert np.array_equal(thumbnail, expected)
    rows, columns = expected.shape
    cut = lambda n, i: slice(i * n // 8, max((i + 1) * n // 8, i * n // 8 + 1))
    means = np.array([[expected[cut(rows, i), cut(columns, j)].mean() for j in range(8)] for i in range(8)])
    lighter = [int(means[i, j] > means[i, (j + 1) % 8] + 1e-9) for i in range(8) for j in range(8)]
    assert media.thumbnail_hash(thumbnail) == f"{int(''.join(map(str, lighter)), 2):016x}"


def test_long_media_in_parts():
    payload = np.random.default_rng(0).integers(0, 256, 2 * media.PART + 64 * 77, dtype=np.uint8).tobytes()
    ((back, image, _),) = media.decode(media.encode([payload]))
    assert back == payload and len(image.parts()) == 3


def test_media_features(spark):
    rows = [(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "é" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in media.features(media.with_media(docs)).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(padded))
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(padded[-64:])
    assert got[1][1:] == got[2][1:] and got[3][1:] == got[4][1:]
    assert media.features(media.with_media(docs.limit(0))).count() == 0


def test_warc_equals_sql(spark, small):
    same(warc_query.query(spark, small), warc_query.SQL, small)


def test_warc_any_split(spark):
    html = ["x" * 200, "x" * 200, "y", "y", None, "", "z" * 9000, "é" * 400, "\x1f" * 500, "x" * 200]
    rows = [(i, f"http://a/{i}" if i % 2 else None, h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, new_folder(spark, "test"))
    whole = sorted(tuple(r) for r in warc.read_archives(manifest).drop("payload").collect())
    for split in (64, 300, 1000):
        assert sorted(tuple(r) for r in warc.read_archives(manifest, split).drop("payload").collect()) == whole
    by_id = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert {i: r.refers_to for i, r in by_id.items() if r.record_type == "revisit"} == {1: 0, 9: 0}
    assert by_id[6].payload == html[6].encode() and by_id[7].payload == html[7].encode()
    assert by_id[3].url == "http://a/3" and by_id[2].url is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_null_ids_repeats_and_other_columns(spark):
    """A page without an id is a response, as in the SQL; a hot payload's repeated rows are one page each."""
    rows = [(None, "u", "x" * 200), (5, "u", "x" * 200), (5, "u", "x" * 200), (7, None, "x" * 200), (None, None, "y" * 150)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")
    got = warc.round_trip(pages).collect()
    found = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert found == {(None, "response", None): 2, (5, "response", None): 2, (7, "revisit", 5): 1}


def test_media_other_columns(spark):
    docs = spark.createDataFrame([(1, "abc", "m", 2)], "doc_id long, text string, media string, n_bytes int")
    assert media.features(media.with_media(docs)).first().n_bytes == 3


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(set(ids)) == len(ids)
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)


def test_pipeline_of_nothing_and_of_nulls(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet")
    odd = given.limit(0).union(given.selectExpr("doc_id", "cast(null as string)", "lang", "source", "n_chars").limit(3))
    repeated = given.limit(20).union(given.limit(20)).union(given.limit(2).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    for docs in (given.limit(0), odd, repeated.union(odd)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, small), name)
            assert docs.columns == given.columns and docs.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= docs.count()


def test_names():
    assert [sum(q.startswith(f"op{i}_") for q in QUERIES) for i in range(1, 11)] == [1] * 10
    assert set(SQL) <= set(QUERIES)
