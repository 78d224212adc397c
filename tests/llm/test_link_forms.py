"""Forms of canonical links and refresh redirects that carry a block decision to an alias."""

from emberday.llm import url_filter as U

RULES = [("block", "net", "/es/")]
BLOCKED = [
    # url, html: each names a page below a.net/es/
    ("http://b.org/q1", """<meta http-equiv="refresh" content="0; url='http://a.net/es/x'">"""),
    ("http://b.org/q2", """<meta http-equiv='refresh' content='0;URL="http://a.net/es/x"'>"""),
    ("http://b.org/rel1", '<link rel="alternate canonical" href="http://a.net/es/x">'),
    ("http://b.org/rel2", "<link href='http://a.net/es/x' rel='canonical nofollow'>"),
    ("http://b.org/e1", '<link rel="canonical" href="http://a.net/&#101;s&#x2F;x">'),
    ("http://b.org/plain", '<link rel=canonical href=http://a.net/es/x>'),
]
# page, html and the page it names on the same host
NAMED = [
    ("http://c.org/d/e/p", '<link rel="canonical" href="../x">', "c.org/d/x"),
    ("http://c.org/d/e/r?z=1", '<link rel="canonical" href="./y/../../w/.">', "c.org/d/w/"),
    ("http://c.org/f/g", '<link rel="canonical" href="?q=1&amp;b=2">', "c.org/f/g?q=1&b=2"),
    ("http://c.org/f/h", '<link rel="canonical" href="/k?a=1&amp;b=2&amp;#38;&copy=3">', "c.org/k?a=1&b=2&"),
    ("http://c.org/f/i", '<link rel="canonical" href="/go?to=http://z.org/">', "c.org/go?to=http://z.org/"),
    ("http://c.org/f/j", '<link rel="canonical" href="../../../top">', "c.org/top"),
]
NONE = [
    ("http://n.org/1", '<link rel="canonical-not" href="http://a.net/es/x">'),
    ("http://n.org/2", '<link data-rel="canonical" rel="next" href="http://a.net/es/x">'),
    ("http://n.org/3", '<link rel="canonical" href="#top">'),
    ("http://n.org/4", '<link rel="canonical" href="mailto:a@a.net">'),
]


def test_link_forms(spark):
    pages = [(u, h) for u, h, *_ in BLOCKED + NAMED + NONE] + [("http://a.net/es/x", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    links = {r.a: r.b for r in U.page_links(df).select(U.node_of(U.F.col("u")).alias("a"), U.node_of(U.F.col("v")).alias("b")).collect()}
    node = lambda u: u.partition("://")[2]
    assert {u: links.get(node(u)) for u, *_ in BLOCKED} == {u: "a.net/es/x" for u, *_ in BLOCKED}
    assert {u: links.get(node(u)) for u, *_ in NAMED} == {u: v for u, _, v in NAMED}
    assert [links.get(node(u)) in (None, node(u)) for u, _ in NONE] == [True] * len(NONE)
    got = {pages[r.page_id][0]: r for r in U.verdicts(df, RULES).collect()}
    assert {u: got[u].verdict for u, _ in BLOCKED} == {u: "block" for u, _ in BLOCKED}
    assert all(got[u].verdict == "allow" and got[u].alias_of is None for u, _ in NONE)


def test_dotted_urls_are_named_alike(spark):
    df = spark.createDataFrame([("http://A.net/x/../es/./y?p=../q#f",), ("http://a.net/es/y?p=../q",), (None,)], "url string")
    assert [r.n for r in df.select(U.node_of(U.F.col("url")).alias("n")).collect()] == ["a.net/es/y?p=../q"] * 2 + [None]
