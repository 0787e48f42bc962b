"""Main text of pages: brute force over whole tables, malformed markup, size of the work."""

import html
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import html_text, queries

BITS = (
    "< > </ p div a span <p> </p> <a> </a> <div> </div> href=\" \" ' = <!-- --> --!> <![foo[ <![CDATA[ ]]> <!DOCTYPE [ <!ENTITY <script> </script> <style> <table> <td> <tr> </table> <li> <ul> </ul> &amp; &#x &#xD800; text, "
    "<? /> <br> <article> </article> <head> </head> <body> <form> <h1> </h1> <h2> <svg/> é <button> </button> <label> <title> <textarea> <select> <option> <b> </b> class=sidebar class=ad hidden"
).split(" ")


def plain_article(page):
    """What stands between the article's tags, by splitting at block tags alone."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = (html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1|li|ul)\b[^>]*>", inside))
    return " ".join(x for x in (" ".join(p.split()) for p in parts) if x)


@pytest.mark.parametrize("tag", ["div", "section"])
def test_pages_without_an_article_element(spark, data, tag):
    """The scores find the same text where the article is any container."""
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        assert html_text.main_text(r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == plain_article(r.html)


KEPT = [
    '<h2 id="navigation">{}</h2>', '<h3 id="notice">{}</h3>', '<h2 id="modal">{}</h2>', '<h2 id="newsletter-history">{}</h2>', '<h2 class="related">{}</h2>', '<p id="share">{}</p>', '<p id="warning">{}</p>', '<p class="ad-hoc">{}</p>', '<p class="subscription">{}</p>',
    '<section id="comments-on-kant"><p>{}</p></section>', '<section id="navigation"><p>{}</p></section>', '<table class="navbar-table"><tr><td>{}</td></tr></table>', '<div class="no-sidebar"><p>{}</p></div>', '<ul id="related-work"><li>{}</li></ul>', '<p class="hidden-xs">{}</p>', '<li class="reply-all">{}</li>',
]
LEFT_OUT = [
    '<div class="ad">{}</div>', '<div class="site-notice"><p>{}</p></div>', '<section id="comments"><p>{}</p></section>', '<ol class="comment-list"><li>{}</li></ol>', '<div class="left-sidebar">{}</div>', '<ul class="share-buttons"><li>{}</li></ul>', '<p class="notice">{}</p>', '<p class="ad">{}</p>',
    '<div class="newsletter-signup">{}</div>', '<div id="cookieBanner">{}</div>', '<h2 class="visually-hidden">{}</h2>', '<article class="comment"><p>{}</p></article>', '<table class="nav"><tr><td>{}</td></tr></table>', '<nav>{}</nav>', '<aside>{}</aside>', '<footer>{}</footer>',
]


@pytest.mark.parametrize("around", ["article", "main"])
def test_names_inside_an_article(around):
    text = "One paragraph of the article, with a comma, that is long enough to be its text."
    for kept, snippets in ((" A few words. ", KEPT), (" ", LEFT_OUT)):
        for snippet in snippets:
            assert html_text.main_text(f"<body><{around}><p>{text}</p>{snippet.format('A few words.')}<p>{text}</p></{around}></body>") == text + kept + text, snippet


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, size):
    d = f"/root/testdata/{size}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = queries.op1_html_text(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        want = plain_article(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40))
def test_no_markup_is_an_error(bits):
    for page in ("".join(bits), " ".join(bits)):
        text = html_text.main_text(page)
        assert text == " ".join(text.split())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_escaped_text_comes_back(text):
    want = " ".join(text.replace("\x00", "").split())
    got = html_text.main_text(f"<article><p>{html.escape(text.replace(chr(0), ''))}</p></article>")
    assert got == want


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a</p><![foo[x]]><p>b</p>", "a b"), ("<p>x</p><!-- y", "x"), ("<p>x</p><!-- a --!><p>z</p>", "x z"), ("<!DOCTYPE [<!ENTITY x>]><p>q</p>", "q"), ("<!doctype [a><p>b</p>]<p>c</p>", "b ] c"), ("<!doctype [a]><!doctype [b><p>c</p>", "c"), ("<p>a<!-->b<!--->c</p>", "abc"),
        ("<p title=it's>one</p><p>it's</p>", "one it's"), ("<p class='a>b'>c</p>", "c"), ("a < b, c > d", "a < b, c > d"), ("<p>x</ p></p><p>y</p>", "x y"), ("<p>one<wbr>two</p>", "onetwo"),
        ("<article><ul><li><a>Linked item</a></li><li>Plain item</li></ul></article>", "Linked item Plain item"),
        ("<article><p>Use the <button>Shift</button> key.</p><button>Share</button></article>", "Use the Shift key."),
        ('<article><p>First.</p><section class="related-work"><p>Prior art.</p></section><p class="warning-text">Careful.</p><div class="ad">Buy</div><div class="share-buttons">Send</div></article>', "First. Prior art. Careful."),
        ('<article><header><h1>Title</h1></header><div class="entry-content"><p>Some text, which is long enough.</p></div><section class="comments"><p>A reader, who says, a lot, of things, here.</p></section></article>', "Title Some text, which is long enough."),
        ('<form id="page"><article><p>The whole page stands in a form, as some servers do it.</p></article><input></form>', "The whole page stands in a form, as some servers do it."),
        ("<p>Text, that is long enough for a block.</p><form><label>Name</label><p>Send us, your name, and address.</p></form>", "Text, that is long enough for a block."),
        ("<div><p>One, two, three, and some more words.</p></div><div><p>One, two, three, and some more words.</p></div>", "One, two, three, and some more words. One, two, three, and some more words."),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_clashing_columns_ties_and_repeats(spark):
    page = "<div><p>One, two, three, four.</p></div>"
    rows = [(1, "u", page, "t", 5, 1), (1, "u", page, "t", 5, 1), (2, None, "", None, None, None), (None, None, None, None, None, None)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, tag int")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, "u", "One, two, three, four.", 22)] * 2 + [(2, None, "", 0), (None, None, "", 0)], key=repr)


def test_work_grows_with_the_page_alone():
    """Four times as many siblings, levels, unclosed tags or quotes take about four times as long."""
    rng = random.Random(0)
    shapes = {
        "siblings": lambda n: "<div><a href=x>link text here</a></div>" * n + "<p>A, b, c text.</p>", "levels": lambda n: "<div>" * n + "<p>deep, text here, long enough to count.</p>", "inline": lambda n: "<b>" * n + "<hr>" * n + "x",
        "sidebars": lambda n: '<div class="sidebar">' * n + "text, of the page", "quotes": lambda n: '<a b="x>y ' * n, "items": lambda n: "<ul>" + "<li>item, one" * n, "doctypes": lambda n: "<!doctype[>" * n, "bracket": lambda n: "<!doctype[>" * n + "]" + " " * n, "soup": lambda n: "".join(rng.choice(BITS) for _ in range(n)),
    }
    for name, shape in shapes.items():
        took = []
        for n in (8_000, 32_000):
            page = shape(n)
            began = time.process_time()
            html_text.main_text(page)
            took.append(time.process_time() - began)
        assert took[1] < 10 * max(took[0], 0.02), name
