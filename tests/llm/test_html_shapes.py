"""HTML extraction: wrappers named like boilerplate, teasers, readers' articles, pages without article markup."""

import pytest

from bazaarlake.llm import html

TEXT = "The text of the article, which is longer than what stands around it."


def content(page):
    return [t for t, s in html.page_lines(page) if s == html.CONTENT]


def kept(page):
    return [t for t, s in html.page_lines(page) if s != html.BOILERPLATE]


@pytest.mark.parametrize(
    "name", ["has-sidebar", "no-comments", "share-page", "widget", "reply", "notice-board", "menu", "related layout", "sidebar"]
)
def test_article_in_a_wrapper(name):
    page = f'<div class="{name}"><div class="menu">Home</div><article><p>{TEXT}<div class="share">Tweet</div></article></div>'
    assert content(page) == [TEXT]
    assert "Home" not in kept(page) and "Tweet" not in kept(page)
    assert content(f'<main><div id="{name}"><article><p>{TEXT}</article></div></main>') == [TEXT]


def test_form_around_the_page():
    assert content(f"<form><nav>Home</nav><article><p>{TEXT}</article></form>") == [TEXT]
    assert kept(f"<form><nav>Home</nav><div>{TEXT}</div></form>") == [TEXT]
    assert kept(f"<div>{TEXT}</div><form><div>Your name</div></form>") == [TEXT]


def test_readers_articles():
    comments = '<article class="comment"><p>A reader</p></article><article class="user-comment" id="c2">Another</article>'
    assert kept(f"<article><p>{TEXT}</article>{comments}") == [TEXT]
    assert kept(f"<article class='post no-comments'><p>{TEXT}{comments}</article>") == [TEXT]
    assert kept(f"<div>{TEXT}</div>{comments}") == [TEXT]
    assert kept(f"<div>{TEXT}</div><section class='replies'><article>A reader</article></section>") == [TEXT]
    assert kept(f"<div>{TEXT}</div><section id='comments'><article>{TEXT} No!</article></section>") == [TEXT]
    assert kept(f"<article>{TEXT}</article><article class='ad'>Buy</article>") == [TEXT]


def test_teasers_leave_other_text(spark, scratch):
    def page(n):
        return (
            f"https://a.org/{n}",
            f"<div>Welcome</div><div>{TEXT} {n}</div><article>Teaser {n}</article><div>Call us</div>",
        )

    rows = [(n, *page(n)) for n in range(4)] + [(9, "https://b.org/1", f"<article>Teaser</article><div>{TEXT}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.main_texts(pages, scratch).collect()}
    assert found == {n: f"{TEXT} {n}\nTeaser {n}" for n in range(4)} | {9: f"Teaser\n{TEXT}"}
