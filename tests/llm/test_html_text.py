import re
import time
import tracemalloc
from html import unescape

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import html_text
from spanloom.llm.html_text import extract, main_text


def article(page):
    """Brute force for the given pages, which mark their article."""
    inner = re.sub(r"<(?!/?b>)[^>]*>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    return " ".join(unescape(inner.replace("<b>", "").replace("</b>", "")).split())


def test_given_pages_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


LONG = "This is a long sentence of the story, with commas, and an end. " * 5
STORY = f"<h2>Short title</h2><p>{LONG}</p><p>{LONG}<br>More&nbsp;text &amp; such&#33;</p><p>Tiny.</p>"
WANT = " ".join(f"Short title {LONG} {LONG} More text & such! Tiny.".split())


def page(body):
    return f"<!DOCTYPE html><html><head><title>T, t.</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_furniture_goes():
    around = (
        '<header><h1>The Site, since 1999.</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<div class="cookie-notice">We use cookies, as all do. Accept them, please.</div>{}'
        f'<aside><p>{LONG}</p></aside><div id="sidebar"><p>Side, side.</p></div>'
        f'<section class="comments"><h3>Comments</h3><p>{LONG}</p></section>'
        '<form><label>Mail</label><input><button>Go</button></form><script>var a = "<p>x</p>";</script>'
        '<div class="ad">Buy this, now!</div><footer>&copy; Site</footer>'
    )
    assert main_text(page(around.format(f"<article>{STORY}</article>"))) == WANT
    assert main_text(page(around.format(f'<main><div class="body">{STORY}</div></main>'))) == WANT
    assert main_text(page(around.format(f'<div id="content">{STORY}</div>'))) == WANT
    assert main_text(page(around.format(f'<article>{STORY}<div class="comment">Nice, one!</div></article>'))) == WANT
    links = "<div>" + "".join(f'<p><a href="/{i}">A link to page, number {i}.</a></p>' for i in range(9)) + "</div>"
    assert main_text(page(links + f"<div>{STORY}</div>")) == WANT


def test_inline_tags_do_not_split_words():
    assert main_text("<article><p>a<b>b</b>c <i>d</i>\n\t e<br/>f<p>g &lt;tag&gt;</article>") == "abc d e f g <tag>"


def test_broken_and_empty_pages():
    assert [main_text(x) for x in (None, "", "   ", "<p>", "<script>x", "<nav>a, b.</nav>")] == [""] * 6
    assert main_text("just text, no tag") == "just text, no tag"
    assert main_text("<body><article><p>one<p>two</article") == "one two"
    assert main_text("a < b and <3") == "a < b and <3"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<b", ">", "<!--", "-->", "text, ", "<script>", "</script>", "<li>", "&amp;", "'", '"', "</", "<article>"]), max_size=30))
def test_any_markup_is_read(parts):
    text = main_text("".join(parts))
    assert text == " ".join(text.split())


def test_null_pages_extra_columns_and_empty_table(spark):
    rows = [(1, None, "x", 1), (None, "<article>a</article>", "y", 2), (None, "<article>a</article>", "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, got int")
    assert sorted(map(str, extract(df).collect())) == [
        "Row(page_id=1, got=1, text='', n_chars=0)", *["Row(page_id=None, got=2, text='a', n_chars=1)"] * 2]
    assert extract(df.limit(0)).collect() == []


def test_very_long_page():
    assert len(main_text("<article>" + "<p>some words, here. " * 50_000)) == 50_000 * 18 - 1


BOXES = (
    '<div class="a1"><div class="r"><a href="/">Home</a></div><div class="r"><a href="/x">Topics</a></div></div>'
    f'<div class="b7">{STORY}</div><div class="c3"><p class="x">Read on.</p><p class="x">Our shop</p></div><div class="d9">2024 Site</div>'
)


def test_ratios_find_the_text_on_pages_without_telling_names():
    assert main_text(page(BOXES)) == WANT
    assert main_text(page(BOXES.replace("<div", "<section").replace("</div", "</section"))) == WANT
    assert "shop" in main_text(page(BOXES), share=0)


def test_ratios_decide(monkeypatch):
    """With the ratios dealt the other way round, or without the threshold, other text comes out."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    want = [main_text(p) for p in pages]
    assert want == [article(p) for p in pages]
    assert sum(main_text(p, share=0) != w for p, w in zip(pages, want, strict=True)) > 0.9 * len(pages)
    for names in ("_FURNITURE", "_ROLES", "_WORDS", "_PAGE_WORDS"):
        monkeypatch.setattr(html_text, names, set())
    plain = [main_text(p) for p in pages]  # no name helps
    assert sum(a == w for a, w in zip(plain, want, strict=True)) > 0.8 * len(pages)
    monkeypatch.undo()
    scores = html_text.path_scores
    monkeypatch.setattr(html_text, "path_scores", lambda found: {k: 1 / x for k, x in scores(found).items()})
    assert sum(main_text(p) != w for p, w in zip(pages, want, strict=True)) > 0.9 * len(pages)
    assert main_text(page(BOXES)) != WANT


def test_reading_is_linear_whatever_the_markup():
    parts = ["<a \"", "<div>", "<noscript>", "<a b='", "<ul><li>", "<p>x</div>", "<!-- ", "<svg>", "<x = \"", "&amp;<", "</p>", "<a b=\"x> "]
    for part in parts:
        took = []
        for n in (4_000, 40_000):
            began = time.perf_counter()
            main_text(part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * max(took[0], 0.01), (part, took)


def test_deep_pages_take_little_memory():
    tracemalloc.start()
    assert main_text("<div>" * 80_000 + "deep, deep text.") == "deep, deep text."
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
