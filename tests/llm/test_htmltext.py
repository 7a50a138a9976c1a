import html
import re
import time

import pytest
from pyspark.sql import functions as F

from crossloom.llm.htmltext import extract, query, text_of

LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore. " * 3
CLEAN = LOREM.strip()


@pytest.mark.parametrize("page, want", [
    ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b &lt;i&gt; <b>c</b>d", "a b <i> cd"), ("<!-- never closed <p>y", ""), ("<script>1 < 2", ""),
    (f"<body><div id=menu><a href=x>Home</a></div><div class=content><h1>T</h1><p>{LOREM}</p><p>Short.</p><div class='comments'><p>{LOREM}</p></div></div>"
     f"<div class=sidebar>{LOREM}</div></body>", f"T {CLEAN} Short."),
    (f"<body><header><h1>Site</h1></header><main><header><h1>Title</h1></header><section><p>{LOREM}</p></section><section><p>{LOREM}</p><form>f<input></form>"
     "</section></main><div role=complementary>x</div><div class='cookie-notice'>We use cookies</div></body>", f"Title {CLEAN} {CLEAN}"),
    (f"<article><p>{LOREM}</p><section id='comments'><p>c</p></section><aside>a</aside></article><div class=advertisement><p>{LOREM * 3}</p></div>", CLEAN),
    (f"<div><div><p>{LOREM}</p><p>{LOREM}</p></div><div><a>one</a><a>two</a></div></div>", f"{CLEAN} {CLEAN}"),
    ("<p title=\"a>b<c\">x</p><p class='y'>z <a href=\"q", "x z"),
    (f"<ul><li><a href=1>{LOREM[:40]}</a><li><a href=2>more links</a></ul><div><h2>H</h2><p>{LOREM}<br>end\n of  it&nbsp;.</p></div>", f"H {CLEAN} end of it ."),
])
def test_pages(page, want):
    assert text_of(page) == want


def test_articles_of_the_table(spark):
    """The generated pages mark their article; its text is what is left of the markup there."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in query(spark, sf).collect():
        own = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", own))).split())
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize("page", ["<div>" * 5000 + "x" + "</div>" * 5000, "<a " * 20000, "<a \"x" * 20000, "<b>x" * 5000, "</x>" * 20000, "<!--" * 20000, "<p>x" * 20000])
def test_hostile_pages_end_soon(page):
    start = time.time()
    text_of(page)
    assert time.time() - start < 5


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "u", f"<p>{'long ' * 50000}</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = sorted(((r.id, r.url, len(r.text), r.n_chars) for r in extract(table).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (None, "u", 0, 0), (2, "u", 1, 1), (2, "u", 1, 1), (3, "u", 249999, 249999)], key=str)
    assert extract(table.filter("false")).collect() == []


@pytest.mark.parametrize("page, want", [
    (f"<ul><li class=share>x<li>y</ul><p>{LOREM}</p>", CLEAN),
    (f"<div><p class=notice>Sale</div><article><p>{LOREM}</p></article>", CLEAN),
    (f"<body><div><p class=notice>Sale<div><p>{LOREM}</p></div></div></body>", CLEAN),
    (f"<table><tr class=share><td>x<tr><td>{LOREM}</table>", CLEAN),
    (f"<div><nav><ul><li>a<li>b</div><article><p>{LOREM}</p></article>", CLEAN),
])
def test_removed_parts_end_without_their_end_tags(page, want):
    assert text_of(page).removeprefix("y ") == want


@pytest.mark.parametrize("page, want", [
    (f"<body><div class='has-sidebar'><p>{LOREM}</p></div></body>", CLEAN),
    (f"<body><div class='post no-comments'><h1>T</h1><p>{LOREM}</p></div><div class=comments><p>c</p></div></body>", f"T {CLEAN}"),
    (f"<body><div id='content-with-sidebar'><p>{LOREM}</p></div></body>", CLEAN),
    (f"<body><div class='banner-layout'><article><p>{LOREM}</p></article></div><div class=sidebar><p>s</p></div></body>", CLEAN),
    (f"<body><div class='widget'><p>{LOREM}</p><p>{LOREM}</p></div><div class=menu><a href=x>Home</a></div></body>", f"{CLEAN} {CLEAN}"),
    (f"<article><h2 id=discussion>Discussion</h2><p>{LOREM}</p><h2 id='related-work'>Related</h2><section id=search><p>{LOREM}</p></section></article>", f"Discussion {CLEAN} Related {CLEAN}"),
    (f"<article><p>{LOREM}</p><section id=related><a href=x>more</a> <a href=y>links</a></section></article>", CLEAN),
    (f"<body><div style='border:none; overflow:hidden'><p>{LOREM}</p></div></body>", CLEAN),
    (f"<body><div><p>{LOREM}</p></div><div hidden>x</div><div style='color:red; display: none'>y</div><div aria-hidden=true>z</div></body>", CLEAN),
])
def test_names_do_not_outweigh_the_text(page, want):
    assert text_of(page) == want
