import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.llm import html_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for you.</div><div class=ad><p>Buy this wonderful thing now.</p></div>
%s
<aside><p>Related: another long story that you may like to read.</p></aside><form><label>Name</label><input name=q><button>Send</button></form>
<section id="comments"><p>I liked this article very much, thank you for it.</p></section><!-- <p>hidden</p> --><footer>&copy; 2024 Site name &middot; all rights</footer></body></html>"""


def test_article_without_the_rest():
    body = "<article><h1>A &amp; B</h1><p>First   <b>bold</b>\n text &eacute;&#233;.<p>Second<br>line, it goes on.<ul><li>one point<li>two points</ul><p>&nbsp;</p><p>Short.</p></article>"
    assert html_cut.main_text(PAGE % body) == "A & B\nFirst bold text éé.\nSecond line, it goes on.\none point\ntwo points\nShort."


def test_page_without_an_article_element():
    body = "<div><p>" + "A long paragraph of running text, with many words in it. " * 3 + "</p><p>And a shorter one after it.</p></div>"
    got = html_cut.main_text(PAGE % body).split("\n")
    assert got[0].startswith("A long paragraph") and got[-1] == "And a shorter one after it."
    assert not any("cookies" in g or "Related" in g or "liked" in g or "Home" in g for g in got)


@pytest.mark.parametrize("html", ["", "   ", "<p>", "<", "<!--", "<script>x", "</p></div>", "<a href='x", "<div " * 50, "&&&;&#x;<p"])
def test_broken_pages(html):
    assert isinstance(html_cut.main_text(html), str)


def changed(html):
    """(text, score, content) of the blocks whose label the cut turns."""
    return [(t, content) for t, s, content in html_cut.labelled(html) if (s > 0) != content]


SOUP = """<html><body><div class="menu"><a href=/a>Home</a></div>
<div>See what is new here</div><div class="promo">Buy three of these now, pay for two of them.</div>
<div><p>A long paragraph of running text, with many words in it, and some more of them at the end.</p>
<ul><li>one point</li><li>two points</li><li>three</li></ul><p>Another long paragraph that goes on after the list, with its own words.</p><p><a href="/more">See this</a></p><p>And here it ends, as all paragraphs do at some time.</p></div>
<div class="related">Other things to read next time you come here.</div><div>Tell your friends about us</div><div class="footer">All rights reserved.</div></body></html>"""


def test_edges_keep_short_items_and_drop_unlabelled_notices():
    """The score alone would lose four items of the text and keep two notices."""
    assert changed(SOUP) == [("See what is new here", False), ("one point", True), ("two points", True), ("three", True), ("See this", True), ("Tell your friends about us", False)]
    assert html_cut.main_text(SOUP).split("\n")[1:4] == ["one point", "two points", "three"] and html_cut.main_text(SOUP).count("\n") == 6


def test_score_alone_decides_without_edges(monkeypatch):
    monkeypatch.setattr(html_cut, "edges_of", lambda blocks: [])
    assert changed(SOUP) == []


def test_a_cue_is_not_all():
    """A cue is one finite weight: it turns a paragraph away, but no block's label is fixed beforehand."""
    strongest = html_cut.SHORT + 2.5 + max(html_cut.KIND.values()) + html_cut.ENDED + html_cut.HOME
    edges = 2 * (html_cut.ADJACENT + html_cut.SIBLING + html_cut.TOGETHER)
    assert html_cut.CUE < 0 < strongest + html_cut.CUE + edges and abs(html_cut.CUE) < 2 * edges


def test_what_counts_as_text():
    page = "<article><p title='hidden treasures' data-x=\"class=ad\">A paragraph, with <a href=/hidden-ad>a link</a> and <math><mi>x</mi></math>.</p><p><span aria-hidden=true>Seen by all.</span> Not <b hidden>this</b> here.</p><canvas>no canvas</canvas></article>"
    assert html_cut.main_text(page) == "A paragraph, with a link and x.\nSeen by all. Not here."


HOSTILE = {
    "unclosed tags": "<a " * 300_000,
    "alternating blocks": "<p>A long paragraph of running text, with many words in it.</p><ul><li><a href=x>a</a></ul>" * 10_000,
    "unpaired quotes": "<a \">'<b '>\" " * 80_000,
    "script without an end": "<script>" + "</script " * 100_000,
    "deep inline": "<i><div>" + "<b>" * 150_000 + "</i>" * 100_000 + "x</p>" * 50_000,
    "deep blocks": "<blockquote>" * 60_000 + "<p>x" * 60_000 + "</section>" * 20_000,
    "nested cues": "<div class=ad>x" * 60_000,
    "weak items": "<p>A long paragraph of running text, with many words in it.</p>" + "<li>ab cd ef</li>" * 60_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_of_a_megabyte(name):
    began = time.time()
    assert isinstance(html_cut.main_text(HOSTILE[name]), str)
    assert time.time() - began < 15


def test_long_page():
    body = "<article>" + "".join(f"<p>Paragraph number {i} of the long article.</p>" for i in range(3000)) + "</article>"
    assert html_cut.main_text(PAGE % body).count("\n") == 2999


def test_cut_is_minimal():
    rnd = random.Random(7)
    for _ in range(120):
        n = rnd.randrange(1, 9)
        scores = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5]
        cost = lambda s: sum(abs(x) for x, c in zip(scores, s, strict=True) if (x > 0) != c and x != 0) + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: E731, B023
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert abs(cost(html_cut.min_cut(scores, edges)) - best) < 1e-6


def test_rows(spark):
    rows = [(1, "u", PAGE % "<article><p>Some text here.</p></article>", 5), (2, None, None, 6), (None, "v", "", 7), (1, "u", PAGE % "<article><p>Some text here.</p></article>", 5)]
    got = html_cut.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(str((r.page_id, r.text, r.n_chars)) for r in got) == sorted(str(x) for x in [(1, "Some text here.", 15), (2, "", 0), (None, "", 0), (1, "Some text here.", 15)])
    assert html_cut.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_generated_pages(spark, sf):
    """The driver's pages hold their text in one article of paragraphs."""
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_cut.op4_main_text(spark, sf).collect():
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
    assert F is not None


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-ads", "with-comments"])
def test_away_word_around_the_whole_page(name):
    lines = [f"Paragraph {i} of the article, with some words in it." for i in range(12)]
    body = "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "<div class=related><p>Read this as well, please.</p></div></article>"
    page = PAGE.replace("<body>", f'<body><div class="{name}">').replace("</body>", "</div></body>")
    assert html_cut.main_text(page % body) == "\n".join(lines)


def test_articles_in_a_small_away_element_stay_out():
    body = "<article>" + "<p>A paragraph of the article itself, with words.</p>" * 12 + "</article><div class=related><article><p>A teaser of another story, to be read later.</p></article></div>"
    assert "teaser" not in html_cut.main_text(PAGE % body)
