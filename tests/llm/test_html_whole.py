"""Pages whose whole text was once left out."""

import time
from collections import Counter

import pytest

from strandline.llm import html_text

PAGE = '<html><body><nav><a>home</a></nav><div class="ad">Buy now</div><article><h1>Head</h1><p>one two three</p></article><div class="comments"><p>nice</p></div></body></html>'
WEIGHTS = html_text.weights_of(sum((html_text.counts(PAGE) for _ in range(3)), Counter()))
TEXT = "Head\n\none two three"


@pytest.mark.parametrize(
    "page",
    [
        PAGE,
        PAGE.replace("<body>", '<body class="has-sidebar">'),
        PAGE.replace("<body>", '<body class="single sidebar">'),
        PAGE.replace("<article>", '<article class="post share">'),
        PAGE.replace("<article>", '<div id="menu-page" class="sidebar"><div class="share"><article>').replace("</article>", "</article></div></div>"),
        PAGE.replace("<article>", '<div class="no-sidebar">').replace("</article>", "</div>"),
        PAGE.replace("<a>home</a>", "<a>" + "<b>" * 70 + "home"),
        PAGE.replace("Buy now", "<i>" * 200 + "Buy now"),
        '<html><body><div class="sidebar"><h1>Head</h1><p>one two three</p></div></body></html>',
    ],
)
def test_cues_and_depth_keep_the_article(page):
    assert html_text.extract(page, WEIGHTS) == TEXT


def test_cue_elements_beside_the_article_go():
    page = PAGE.replace("one two three", 'one two three<span class="share">tell all</span>').replace("<p>nice</p>", "<article>nice words of a reader</article>")
    assert html_text.extract(page, WEIGHTS) == TEXT


@pytest.mark.parametrize("name", ["share-price", "related-work", "ads-law", "shareholders", "menu-engineering", "comment-free"])
def test_names_that_say_more_keep_their_text(name):
    page = PAGE.replace("</article>", f'<p class="{name}">kept words</p><section id="{name}"><p>more kept</p></section></article>')
    assert html_text.extract(page, WEIGHTS) == TEXT + "\n\nkept words\n\nmore kept"


@pytest.mark.parametrize("name", ["ad-slot", "share-buttons", "comments-area", "siteHeader", "main-nav", "related-posts", "x y newsletter_box", "comment-12"])
def test_names_of_layout_go(name):
    page = PAGE.replace("</article>", f'<div class="{name}"><p>not kept</p></div></article>')
    assert html_text.extract(page, WEIGHTS) == TEXT


def test_many_open_elements_take_linear_time():
    assert html_text.extract("<b>" * 50_000 + "</i>" * 50_000 + "<p>one two" + "</b>" * 50_000, WEIGHTS) == "one two"


@pytest.mark.parametrize("bad", ["<a ", "<a b='", "<a 'b\"", "<!", "<a class=", "<a class=x id=\"", "<!--", "<p title='>"])
def test_hostile_tags_take_linear_time(bad):
    began = time.time()
    html_text.extract("<article><p>one two three</p></article>" + bad * (3_000_000 // len(bad)), WEIGHTS)
    html_text.extract("<a " + bad * 100_000 + ">", WEIGHTS)
    assert time.time() - began < 30


def test_a_tag_that_never_ends_takes_the_rest():
    assert html_text.extract("<article><p>one two three</p><p>four</p><a href='x <b", WEIGHTS) == "one two three\n\nfour"
    assert html_text.extract('<article><p>one two three <a title="it>four</a></p></article>', WEIGHTS) == "one two three four"
    assert html_text.extract("<article><p>it's 3 < 4 and 5 > 4</p></article>", WEIGHTS) == "it's 3 < 4 and 5 > 4"
