"""Main text of pages: pages worked out by hand, and the test tables against their articles."""

import html
import re

import numpy as np
import pytest

from pageloom.llm import blocks, queries

LONG = "It was the best of times and it was the worst of times for all of those who were in the city, and so they had to go on with what they had."
MORE = "The people of the town did not know what was to come of it, but they were sure that some of them would be there to see it in the end."
PAGES = {
    "nothing": ("", ""),
    "white space": (" \n\t", ""),
    "only markup": ("<div><p></p><img src=a.png></div>", ""),
    "article among everything": (
        f"""<!DOCTYPE html><html><head><title>{LONG}</title><style>p{{}}</style></head><body>
        <header><h1>Site of the day</h1><p>{LONG}</p></header><nav><a href=/>Home</a></nav><div class="cookie-notice"><p>{LONG}</p></div>
        <main><article><header><h1>A title</h1></header><p>{LONG}</p><aside><p>{MORE}</p></aside><p>Short one.</p><div class="ad">{MORE}</div>
        <form><p>{MORE}</p><input value=x><button>Go</button></form><script>var t = "</p>" + '{MORE}';</script><p>{MORE}</p>
        <ul><li>First of all<li>Second</ul><footer>{LONG}</footer></article>
        <section id="comments"><article class="comment"><p>{LONG}</p></article></section></main>
        <div class="sidebar"><p>{MORE}</p></div><footer>{LONG}</footer></body></html>""",
        f"A title\n{LONG}\nShort one.\n{MORE}\nFirst of all\nSecond",
    ),
    "no declared article": (
        f"<body><ul><li><a href=1>One link</a><li><a href=2>Another link here</a></ul><p>Menu</p><h2>Title</h2><p>{LONG}</p><p>Yes.</p><p>{MORE}</p><p><a href=3>{LONG}</a></p><p>© all</p>",
        f"Title\n{LONG}\nYes.\n{MORE}",
    ),
    "main part without article": (f"<p>{LONG}</p><div id='main-content' class=x><h1>T</h1><p>{MORE}</p><p>End</p></div><p>{LONG}</p>", f"T\n{MORE}\nEnd"),
    "words of another script": ("<p>a</p><article><h1>題</h1><p>これは本文です。</p></article><p>b</p>", "題\nこれは本文です。"),
    "white space and references": (f"<article><p>&lt;b&gt; A&amp;B &#x41;&nbsp;\n\n <b>x</b>y<br>z &copy &am {LONG}</p></article>", f"<b> A&B A xy z © &am {LONG}"),
    "open tags": (f"<article><p><b>{LONG}<br><p>{MORE}</article><p>{LONG}", f"{LONG}\n{MORE}"),
    "crossed tags": (f"<article><b><div>{LONG}</b></div><div>{MORE}</div></article></div></article>{LONG}", f"{LONG}\n{MORE}"),
    "signs that are no tags": (f"<article><p>1 < 2 > 0 <3 {LONG}</p></article>", f"1 < 2 > 0 <3 {LONG}"),
    "comments": (f"<article><!-- <p>{MORE}</p> --><p>{LONG}</p><!-- > {MORE}</article>", LONG),
    "cut off in a tag": (f"<article><p>{LONG}</p><p class=\"{MORE}", LONG),
    "hidden": (f"<article><p hidden>{MORE}</p><p style='display: none'>{MORE}</p><p>{LONG}<span class=ad> Buy</span><button>Share</button></p></article>", LONG),
    "wrapper with a telling name": (f"<div class='content-with-sidebar'><article><p>{LONG}</p></article></div>", LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert "\n".join(b.text for b, main in blocks.classified(page) if main) == text


def test_second_pass():
    """Ambiguous blocks follow the nearer decided neighbour, the one before on a tie, their own section first."""
    g, b, a = blocks.GOOD, blocks.BAD, blocks.AMBIGUOUS
    settle = lambda labels, section=None, place=None: blocks.second_pass(np.array(labels), np.array(section or [0] * len(labels)), np.array(place or [0] * len(labels))).tolist()
    assert settle([a, a]) == [b, b]
    assert settle([a, g, a, a, a, b, a]) == [g, g, g, g, b, b, b]
    assert settle([g, a, b]) == [g, g, b] and settle([b, a, g]) == [b, b, g]
    assert settle([b, a, g, b], [0, 1, 1, 0]) == [b, g, g, b]
    assert settle([g, a, g], [0, 1, 0]) == [g, g, g]
    assert settle([b, a, b], [0, 1, 0], [0, blocks.ARTICLE, 0]) == [b, g, b]


def test_linear_time():
    for page in ("<" * 200_000, "<a href='" * 30_000, "<p" * 100_000, "<b>" * 100_000 + "</p>" * 100_000, "<!--" * 100_000, '<a x="' * 50_000, "<script>" * 50_000, "&" * 200_000, "<p><div>" * 50_000 + "</span>" * 50_000):
        blocks.classified(page)


def test_rows(spark):
    rows = [(1, "u", p, "clash", "clash") for p, _ in PAGES.values()] + [(None, None, None, None, None), (1, "u", PAGES["open tags"][0], "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, main string").repartition(3)
    got = blocks.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == sorted([(1, "u", t) for _, t in PAGES.values()] + [(0, "", ""), (1, "u", PAGES["open tags"][1])])
    parts = blocks.page_blocks(pages.filter("page_id = 1")).filter("main").count()
    assert parts == sum(len(t.split("\n")) for _, t in [*PAGES.values(), PAGES["open tags"]] if t)
    assert blocks.extract(pages.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    """Every row of sf0.01 against its article taken by plain patterns."""
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op11_html(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        lines = (" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
