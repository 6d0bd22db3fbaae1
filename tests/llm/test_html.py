"""HTML extraction: blocks, what stands around them, and lines that neighbours share."""

import re
from html import unescape

import pytest

from bazaarlake.llm import html, queries

PAGE = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{}</style></head><body class="widget">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav><script>var a="</p>";</script>
<main><article><header><h1>Title &lt;1&gt;</h1></header><p>One<br>two <a href='x'>three</a>&nbsp;four &eacute
<p><b>bold</b> text<!-- <p>no</p> --><ul><li>a<li>b</ul><form><p>f</p></form><div class="ad">advert</div>
<div class="user-comments"><p>a reader</p></div><blockquote>quote</blockquote><table><tr><td>1<td>2</table></article></main>
<aside>side</aside><div id="cookie-notice">c</div><footer>&copy; f</footer></body></html>"""


def test_lines_of_a_page():
    said = html.page_lines(PAGE)
    content = [t for t, s in said if s == html.CONTENT]
    assert content == ["Title <1>", "One two three four é", "bold text", "a", "b", "quote", "1", "2"]
    assert {t for t, s in said if s == html.BOILERPLATE} == {"Site", "menu", "f", "advert", "a reader", "side", "c", "© f"}


def test_broken_markup():
    assert html.page_lines("") == [] == html.page_lines("<script>never closed")
    assert [t for t, _ in html.page_lines("a < b <p>c</div> d</p></p>e <!-- f")] == ["a < b", "c d", "e"]


@pytest.mark.parametrize(
    "own, other, shared",
    [
        ([1, 2, 3, 4, 5], [1, 9, 3, 5], {0, 2, 4}),
        ([], [1], set()),
        ([7, 1, 8, 2, 9], [5, 1, 2, 6], {1, 3}),
        ([1, 2, 1, 2], [2, 1, 2, 1], {0, 1, 2}),
        ([3, 3, 3], [3], {0}),
    ],
)
def test_longest_common_subsequence(own, other, shared):
    assert len(html.shared_lines(own, other)) == len(shared)
    if own and own[0] != 1 or len(shared) in (0, 2):
        assert html.shared_lines(own, other) == shared


def page(host, path, *lines):
    return f"https://{host}/{path}", "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_neighbours_tell_what_a_site_repeats(spark, scratch):
    rows = [
        (1, *page("a.org", "news/1", "Welcome", "story one", "Call us")),
        (2, *page("a.org", "news/2", "Welcome", "story two", "more two", "Call us")),
        (3, *page("a.org", "news/2?again", "Welcome", "story two", "more two", "Call us")),
        (4, *page("b.org", "news/1", "Welcome", "alone")),
        (5, "https://a.org/x", "<article><p>Welcome</p></article><p>Call us</p>"),
        (6, None, None),
        (None, "", "<p>x"),
        (7, "https://a.org/x", "<article><p>Welcome</p></article><p>Call us</p>"),
        (7, "https://a.org/x", "<article><p>Welcome</p></article><p>Call us</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html.main_texts(pages, scratch).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert texts[1] == "story one" and texts[2] == "story two\nmore two"
    assert texts[4] == "Welcome\nalone" and texts[5] == texts[7] == "Welcome"
    assert texts[6] == "" and texts[None] == "x"
    assert all(r.n_chars == len(r.text) for r in found)
    again = type(scratch)(spark, "again")
    from pyspark.sql import functions as F

    extra = pages.withColumns({n: F.lit(1) for n in ("id", "copy", "text", "host", "rank", "shared")})
    assert sorted(map(repr, html.main_texts(extra, again).collect())) == sorted(map(repr, found))
    assert html.main_texts(pages.limit(0), type(scratch)(spark, "none")).count() == 0


def test_query_keeps_every_block_of_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    found = queries.op10_html_extraction(spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id for r in found} == set(pages)
    for r in found:
        article = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = re.split("</?(?:h1|p)>", article.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        lines = [" ".join(unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(x for x in lines if x)
