"""Main text of pages: shapes that stay and shapes that go, votes of hosts, broken markup."""

import time

import pytest

from funnelscope.llm.html_text import Reader, main_text

TEXT = "<p>The long text of the page, told in whole sentences, one after another.</p>" * 5
MENU = "<nav><a href='/'>Home</a></nav><div class='sidebar'><p>Buy our things.</p></div><div class='site-footer'>All rights.</div>"


def read(html):
    return " ".join(b[1] for b in Reader().blocks(html))


@pytest.mark.parametrize("around", [
    "<div class='layout has-sidebar'>{}</div>", "<div id='page' class='sticky-header'>{}</div>", "<section class='story related'>{}</section>",
    "<div class='content no-ads'>{}</div>", "<form action='/'>{}</form>", "<div class='widget'><article>{}</article></div>"])
def test_wrappers_do_not_take_the_text_away(around):
    expected = read(f"<body>{TEXT}</body>")
    assert expected.count("The long text") == 5
    assert read(f"<body>{around.format(TEXT + MENU)}</body>") == expected
    assert read(f"<body>{around.format(TEXT)}{MENU}</body>") == expected


def test_what_is_left_out():
    teaser = "<div class='related'><article><p>Another text.</p></article></div>"
    comments = f"<div class='comments'>{TEXT * 9}</div>"
    assert read(f"<body><article><p>Short.</p></article>{teaser}{comments}{MENU}</body>") == "Short."


LEAD = "<p>KEEP</p>"
LINKS = "<ul><li><a href=a>KEEP</a></li><li><a href=b>two</a></li><li><a href=c>three</a></li></ul>"
STAYS = {
    "heading": "<h2 class='section-header'>KEEP</h2>", "marked heading": "<h2 class='header'>KEEP</h2>",
    "article header": f"<div class='article-header'><h1>T</h1>{LEAD}</div>", "post header": f"<div class='post-header'>{LEAD}</div>",
    "code comment": "<pre><code>x <span class='hljs-comment'>KEEP</span></code></pre>", "plain code comment": "<pre><span class='comment'>KEEP</span></pre>",
    "formula": "<p>by <math><mi>KEEP</mi><mo>=</mo></math></p>", "related work": f"<section class='related-work'>{LEAD}</section>",
    "references": f"<h2>References</h2>{LINKS}", "two links": "<ul><li><a href=a>KEEP</a></li><li><a href=b>b</a></li></ul>",
    "definition": "<dl><dt>a<dd>KEEP</dl>", "cells": "<table><tr><td>KEEP<td>b</table>", "quote": f"<blockquote>{LEAD}</blockquote>",
    "unclosed": "<p><b>KEEP", "sign": "<p>a < b, KEEP</p>", "stray quote": "<p title=it's>KEEP</p>", "comment": "<!-- > -->" + LEAD, "bare comment": "<!-->" + LEAD,
    "entity": "<p>KEE&#80;</p>", "script text": "<script>var a = '<!--';</script>" + LEAD, "closed svg": "<svg/>" + LEAD, "open svg": "<svg>" + LEAD,
    "inline tags": "<p>K<b>E</b><i>E</i>P</p>", "upper case": "<P>KEEP</P>", "own element": "<x-note>KEEP</x-note>", "no ads": f"<div class='no-ads'>{LEAD}</div>",
}
GOES = {
    "script": "<script src=https://a.b/js/>var KEEP=1;</script>", "upper script": "<SCRIPT>KEEP</SCRIPT >", "svg": "<svg><svg><text>x</text></svg><text>KEEP</text></svg>",
    "style": "<style>KEEP</style>", "footer": "<div class='site-footer'>KEEP</div>", "comments": "<div class='comment-list'><p>KEEP</p></div>",
    "advert": "<div class=ad>KEEP</div>", "numbered": "<div id='ad-12'>KEEP</div>", "consent": "<div class='cookie-banner'>KEEP</div>",
    "menu": "<nav>KEEP</nav>", "aside": "<aside>KEEP</aside>", "role": "<div role='navigation'>KEEP</div>", "share": "<div class='share-buttons'>KEEP</div>",
    "hidden": "<div hidden>KEEP</div>", "form": "<form><label>KEEP</label><input></form>", "template": "<template><p>KEEP</p></template>",
}


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>"])
@pytest.mark.parametrize("shape", [*STAYS, *GOES])
def test_shapes_within_an_article(shape, shell):
    text = read(f"<html><body>{MENU}{shell.format(TEXT + (STAYS | GOES)[shape])}</body></html>")
    assert text.count("The long text") == 5 and ("KEEP" in text) == (shape in STAYS)
    assert "Buy our" not in text and "All rights" not in text


@pytest.mark.parametrize("shape", sorted({*STAYS, *GOES} - {"marked heading"}))
def test_shapes_within_a_plain_container(shape):
    text = read(f"<html><body><div class='c'>{TEXT}{(STAYS | GOES)[shape]}</div></body></html>")
    assert text.count("The long text") == 5 and ("KEEP" in text) == (shape in STAYS)


def test_link_lists_without_prose_are_menus():
    assert read(f"<body>{LINKS}{TEXT}</body>").startswith("The long text")
    assert "KEEP" not in read(f"<body><div class='x'>{LINKS}</div>{TEXT}</body>")


@pytest.mark.parametrize("piece", ["<a ", "<!", "<svg>", "<a '", "<!--", "<script>", "<div>", "<div>x", "<form>", "<form>x", "<blockquote>", "<b>x", "<p></i>", "<ul><li>", "</div>", "<a <b"])
def test_broken_markup_takes_linear_time(piece):
    start = time.process_time()
    Reader().blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 20


def test_host_votes_do_not_replace_articles(spark):
    """Twenty-six templates on one host; a side box of each has the path of the next one's article."""
    def page(i):
        body = f"<div class='t{chr(97 + i)}'>{TEXT}<p>number {i}</p></div><div class='t{chr(97 + (i + 1) % 26)}'><p>Side.</p></div>"
        return i, f"http://h.example/{i}", f"<body>{MENU}{body}</body>", "mine", "mine"
    rows = [page(i % 26) for i in range(76)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, page string, path string")).collect()
    assert len(got) == 76
    for row in got:
        assert row.main_text.text.count("The long text") == 5 and f"number {row.page_id}" in row.main_text.text and "Side." not in row.main_text.text


def test_votes_choose_among_fair_containers(spark):
    """Two containers of about equal size: the host's majority decides for the page whose own score is for the other."""
    def body(a, b):
        return f"<body><div class='left-story'>{'<p>Left words here.</p>' * a}</div><div class='other'>{'<p>Right words now.</p>' * b}</div></body>"
    rows = [(i, "http://v.example/", body(10, 2)) for i in range(5)] + [(9, "http://v.example/", body(10, 14))]
    got = {r.page_id: r.main_text.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "Left" in got[9] and "Right" not in got[9]


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, None, "", 1), (1, "no url", "<p>text", 2), (1, "no url", "<p>text", 2), (2, "http://a/", "x" * 3_000_000, 3), (3, "http://a/", "<>&&&;<", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long").selectExpr("*", "1 as vote", "2 as blocks", "3 as paths", "4 as main_text")
    got = sorted(((r.page_id, r.main_text.text) for r in main_text(pages).collect()), key=str)
    assert got == sorted([(None, ""), (1, ""), (1, "text"), (1, "text"), (2, "x" * 3_000_000), (3, "<>&&&;<")], key=str)
    assert main_text(pages.limit(0)).collect() == []
