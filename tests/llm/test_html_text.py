from __future__ import annotations

import time

import pytest

from coldledger.llm.html_text import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu entry one</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more of them to make this page work well for everybody who reads it.</div>
<div class="ad">Buy this now, it is the best thing that you could ever buy, says everybody.</div>
<main><article><h1>Head&shy;line &amp; more</h1><p>First <b>bold</b> para<i>graph</i>
   goes on.<p>No.<p>Third&nbsp;&eacute;&#8212;<br>x</p><ul><li>item<li>other item</ul><pre>a
   b</pre><form><label>Name</label><input></form><table><tr><td>c1<td>c2</table></article>
<aside>Related things that nobody wants to read</aside>
<section id="comments"><p>A reader comment that is long, longer than most of the text, and still no part of it at all, never.</p></section></main>
<div class="sidebar"><p>Popular texts of the week and of the month</p></div>
<footer>&copy; example</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "\n".join([
        "Head\xadline & more", "First bold paragraph goes on.", "No.", "Third é— x", "item", "other item", "a b", "c1", "c2"])


def test_unclosed_and_plain_pages():
    assert main_text("<article><p><b>One.<br><p>Two.</p></article><footer>no") == "One.\nTwo."
    assert main_text("just text &lt;here&gt;") == "just text <here>"
    assert main_text("<div><div class=nav><a href=x>a</a></div><div id=content><p>Real text of the page, long enough.</p>"
                     "<p>More</p></div></div>") == "Real text of the page, long enough.\nMore"
    assert main_text("<p>cut off in a ta") == "cut off in a ta"
    assert [main_text(t) for t in (None, "", "<nav>only menu</nav>", "<script>x", "<")] == ["", "", "", "", "<"]


HEAD, INTRO, END = "A heading of some words", "An introduction, not long.", "And so it ends."
BODY = "The body of the text goes on for much longer than the parts around it do. " * 8
MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>News of today</a><li><a href=/c>Contact</a></ul>"
TEXT = [HEAD, INTRO, BODY.strip(), END]
PARTS = f"<h1>{HEAD}</h1><p>{INTRO}</p><p>{BODY}</p><p>{END}</p>"
#: Pages whose text is TEXT, in layouts of many kinds.
LAYOUTS = {
    "article": f"<nav>{MENU}</nav><article>{PARTS}</article><footer>Imprint</footer>",
    "main with sections": f"<header>{MENU}</header><main><section><h1>{HEAD}</h1><p>{INTRO}</p></section><section><p>{BODY}</p></section>"
                          f"<section><p>{END}</p></section></main><aside>Read this too, it is about the same matter.</aside>",
    "three divs": f"<div id=menu>{MENU}</div><div><h1>{HEAD}</h1><p>{INTRO}</p></div><div><p>{BODY}</p></div><div><p>{END}</p></div>",
    "nested divs": f"<div class=page><div class=top-menu>{MENU}</div><div class=story><div>{PARTS.replace('<p>', '<div><p>').replace('</p>', '</p></div>')}</div></div></div>",
    "class with a sidebar's name": f"<div class='content has-sidebar'>{PARTS}</div><div class='sidebar left'>Popular: texts of the week</div>",
    "class with tags enabled": f"<div class='post tags-enabled no-comments'>{PARTS}</div><div class=comments-area><p>{BODY} I say.</p></div>",
    "wrapper named like a part": f"<div class=widget><div>{PARTS}</div></div><div class=cookie-notice>We use cookies.</div>",
    "unclosed menu": f"<nav>{MENU}<div>{PARTS}</div>",
    "unclosed header": f"<header><a href=/>Site</a><div class=body>{PARTS}</div><footer>Imprint",
    "link list without names": f"<div>{MENU}</div><div>{PARTS}</div><div>{MENU}</div>",
    "table": f"<table><tr><td>{MENU}<td>{PARTS}<tr><td><td></table>",
    "bare paragraphs": f"<body>{PARTS}<div class=ad>Buy this.</div>",
    "comment that never ends": f"<nav>{MENU}</nav><article>{PARTS}</article><!-- <p>",
    "article in a promo wrapper": f"<div id=promo-box>Only today!</div><div class='site main-header'><article>{PARTS}</article></div>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert main_text(LAYOUTS[layout]).split("\n") == TEXT


@pytest.mark.parametrize("page", [
    "<!--" * 500_000, "<!" * 500_000, "<a <" * 500_000, "<div>" * 100_000 + "x", "<p>" + "<b>" * 50_000 + "</i>" * 50_000,
    "<div class=x>a</div>" * 50_000, "<section>" * 20_000 + "</article>" * 50_000 + "x"], ids=range(7))
def test_time_grows_with_length(page):
    started = time.perf_counter()
    main_text("<p>t</p>" + page)
    assert time.perf_counter() - started < 6


def test_short_blocks_stay():
    body = "".join(f"<p>{'Long text here. ' * 9}</p><p>A.</p>" for _ in range(40))
    assert main_text(f"<nav><a href=1>x</a></nav><article>{body}</article>").count("\n") == 79


def test_given_pages_give_their_article(spark):
    import html
    import re

    from coldledger.llm.queries import op10_html_text

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op10_html_text(spark, sf).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b)))).strip()
                  for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    long_page = "<article>" + "<p>many words in a line</p>" * 50_000 + "</article>"
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (None, None, "<p>t</p>", "x"), (1, "u", None, "x"), (3, "u", long_page, "x")],
        "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["n_chars"]) for r in extract_pages(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, 1), (3, 50_000 * 21 - 1)], key=str)
    assert extract_pages(pages.limit(0)).count() == 0
