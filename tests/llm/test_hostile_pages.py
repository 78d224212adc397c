"""Links of real and hostile pages: quotes, comments, scripts, several canonicals, unclosed tags."""

import time

import pytest

from emberday.llm import url_filter as U


def _links(spark, html):
    pages = spark.createDataFrame([("http://a.net/p/q", html)], "url string, html string")
    return sorted(r.v for r in U.page_links(pages).collect())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("""<link rel="canonical" href="http://a.net/es/it's">""", ["http://a.net/es/it's"]),
        ("""<link rel='canonical' href='http://a.net/es/say"x"'>""", ['http://a.net/es/say"x"']),
        ("""<meta http-equiv="refresh" content="0; url=http://a.net/es/a b">""", ["http://a.net/es/a b"]),
        ("""<meta http-equiv=refresh content="5;URL='http://a.net/es/x'">""", ["http://a.net/es/x"]),
        ("""<!-- <link rel="canonical" href="http://b.net/es/q"> -->""", []),
        ("""<!-- open <link rel="canonical" href="http://b.net/es/q">""", []),
        ("""<script>var s = '<link rel="canonical" href="http://c.net/fr/q">';</script>""", []),
        ("""<SCRIPT type=x>'<!--'</SCRIPT><link rel=canonical href=http://c.net/fr/q><!-- x -->""", ["http://c.net/fr/q"]),
        ("""<title><link rel=canonical href=http://c.net/fr/q></title>""", []),
        ("""<link rel=canonical href=http://c.net/1><link rel=canonical href=http://c.net/2>""", ["http://c.net/1", "http://c.net/2"]),
        ("""<link title="a > b" rel="canonical" href="/x">""", ["http://a.net/x"]),
        ("""<link rel="canonical"> href="http://c.net/fr/q" """, []),
        ("""<link data-href="/no" rel="canonical" href = "/yes" href="/second">""", ["http://a.net/yes"]),
        ("""<link rel="alternate  CANONICAL" href=/x/>""", ["http://a.net/x/"]),
        ("""<link rel="canonicals" href=/x><link href=/x><meta content="0;url=/x">""", []),
        ("""<link\nrel=canonical\n href="/a?x=1&amp;y=2">""", ["http://a.net/a?x=1&y=2"]),
        ("""<link rel="canonical" href="/open""", []),  # never closed, names nothing
        ("""<link rel="canonical" <link rel=canonical href="/y">""", ["http://a.net/y"]),
        ("""<meta http-equiv="refresh" content="30">""", []),
    ],
)
def test_forms(spark, html, want):
    assert _links(spark, html) == want


@pytest.mark.parametrize(
    "piece",
    ["<link ", "<link rel='canonical' href=\"", "<script ", "<!-- <link ", "<meta content='", "<link a=\"b' ", "<link " + "a" * 50, "<link = \" ' >"],
)
def test_a_megabyte_of_unclosed_tags_is_quick(spark, piece):
    html = "canonical " + piece * ((1 << 20) // len(piece))
    _links(spark, "canonical <link >")
    start = time.time()
    _links(spark, html)
    assert time.time() - start < 15  # a pattern that gives back what it took needs minutes


def test_nulls_and_none(spark):
    pages = spark.createDataFrame([(None, "<link rel=canonical href=/x>"), ("http://a.net/", None)], "url string, html string")
    assert U.page_links(pages).count() == 0 and U.page_links(pages.limit(0)).count() == 0
