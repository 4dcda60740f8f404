"""The state machine for pages on broken, odd and very long markup."""

import time
from html import escape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import html, markup

ALL = frozenset(markup.FIELDS)


def read(page):
    return markup.evidence(page, ALL)


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("a < b > c", "a < b > c"), ("<", "<"), ("a<b", "a"), ("a<a href='x", "a"),
    ("<p>a<script>var x='<b>no</b>'", "a"), ("<style>p{}</style >b", "b"), ("<script>'</scripted>'</SCRIPT\n>b", "b"), ("<script/>b", "b"),
    ("a<!-- <p>no</p> -->b<!-->c<!--->d<!-- x --!>e<!-- no", "a b c d e"), ("a<!doctype x>b<?x y?>c<![CDATA[d]]>e</ f>g</>h", "a b c e g h"),
    ('<p title="x>y" data-a=\'>\'>a</p><p title=">b', "a"), ('<a title=x"y>a</a>', "a"),
    ("<table><tr><td>a<table><tr><td>b</table><td>c", "a b c"), ("<svg><g>no</svg>a<noscript>no", "a"), ("<div><svg>no</div>a", "a"), ("</p></div>a", "a"),
    ("&#65;&#x42;&#67 &nbsp;&eacute;&lt;b&gt;&amp;amp; &nosuch;", "ABC é<b>&amp; &nosuch;"), ("<textarea><b>a</b> &amp;</textarea>b", "<b>a</b> & b"), ("<title>a</title><iframe><p>no</iframe>b", "a b"),
])
def test_text(page, text):
    assert read(page)["text"] == text


def test_sections():
    got = read("<title>A <b></title><svg><title>no</title></svg><h1>B<h1>C</h1><h2>d<h3>e</h3><h2></h2><li><a href=1>one<li><a href=' 2 '>two <i>2</i></a>3<a name=x>4</a><div><a href='?a=1&amp;b=2&copy=3&lt'>5</div>6")
    assert (got["title"], got["h1"]) == ("A <b>", "B C")
    assert [(h["tag"], h["text"]) for h in got["headings"]][1:] == [("h3", "e"), ("h2", "")]
    assert [(a["href"], a["anchor"]) for a in got["links"]] == [("1", "one"), ("2", "two 2"), ("?a=1&b=2&copy=3<", "5")]


def test_attributes():
    got = read("<META CONTENT=' a  b ' Name=Description name=no><meta property=\"og:x\"content=c/><link rel='x CANONICAL' href=/a><link rel=canonical href=' /b '/>"
               "<script type='application/ld+json; charset=x'>{\"a\": \"</b>\"}</script><script type=application/LD+JSON>{")
    assert [tuple(m.values()) for m in got["metas"]] == [("description", "", "", "a b"), ("", "og:x", "", "c/")]
    assert got["canonical"] == "/b" and got["jsonld"] == ['{"a": "</b>"}', "{"]
    assert not read("<input type=password>")["password"] and read("<form><p><input type=Password />")["password"]
    assert read("<div class='a H-Captcha'>")["captcha"] and not read("<div class='h-captchas' title='h-captcha'><!-- <b class=h-captcha> -->")["captcha"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "/>", "<p>", "</p>", "<script>", "</script>", "<!--", "-->", "'", '"', "=", "<a href=", " ", "x", "&", "&amp;", "<svg>", "</svg>", "<title>", "<h2>"]), max_size=30).map("".join))
def test_any_markup_is_read(page):
    pieces = list(markup.tokens(page))
    assert sum(len(p) for kind, _, p, _ in pieces if kind == "text") <= len(page)
    got = read(page)
    assert set(got) == ALL and all(t in page + "&" for t in got["text"].split() if "&" not in page)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_escaped_text_comes_back(text, value):
    """What is escaped is read back, as text and as attribute."""
    text, value = (x.encode("utf-8", "ignore").decode().translate({c: None for c in [0, 13, *range(127, 160)]}) for x in (text, value))
    got = read(f'<p><a href="{escape(value)}">{escape(text)}</a><script>{escape(text)}</script>')
    assert got["text"] == " ".join(text.split())
    assert [a["href"] for a in got["links"]] == ([value.strip()] if value.strip() else [])


@pytest.mark.parametrize("unit", ['<a href="x>y">z</a>', "<", "<a ", "<!--", "<p><b>", "</x", "<a b='", "<script>", "&amp;", "<a =", "<h2>", "<a href=x>", "<svg></p>"])
def test_long_pages_take_linear_time(unit):
    def seconds(n):
        page, start = unit * (n // len(unit)), time.process_time()
        read(page)
        return time.process_time() - start

    seconds(100_000)
    assert seconds(4_000_000) < 6 * seconds(1_000_000) + 1


def test_columns(spark):
    rows = spark.createDataFrame([(1, "https://e.org/d/p", "<title>T<a>x</title><h2>B<p>&#233;<script>"), (2, "https://e.org/", None), (3, "https://e.org/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in rows.select("page_id", html.visible_text(rows.html).alias("text"), html.element_texts(rows.html, "h2").alias("h2")).collect()}
    assert (got[1].text, got[1].h2) == ("T<a>x B é", ["B é"])
    assert got[2].text is None and got[3].text == ""
    assert spark.range(1).select(html.plain_text(F.lit("&lt;p&gt;a &amp;amp; b&lt;/p&gt;"))).first()[0] == "a & b"
