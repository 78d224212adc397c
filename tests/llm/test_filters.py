import random
import re

import numpy as np
import pytest

from emberday.llm import decontamination as D
from emberday.llm import quality as Q
from emberday.llm import url_filter as U

DOCS = "doc_id long, text string, score double, quality int"


# --- benchmark decontamination


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(min(a.count(k), b.count(k)) for k in keys) / max(1, sum(max(a.count(k), b.count(k)) for k in keys))


def brute_best(doc, item):
    d, w = words(doc), words(item)
    if not d or not w:
        return 0
    if len(w) < 5 or len(d) < 5:
        return float(d == w) if len(w) < 5 or d == w else 0
    g, h = grams(d), grams(w)
    n = min(len(h), len(g))
    return max(similarity(g[i : i + n], h) for i in range(len(g) - n + 1))


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(text(rng.choice((20, 33, 33, 47))))) for i in range(12)]
    items += [(20, "two words"), (21, None), (22, ""), (23, items[0][1]), (24, "tick tock " * 12)]
    docs = []
    for i in range(60):
        w = text(rng.randint(0, 80))
        passage = words(items[i % 12][1])
        for _ in range(i % 4):
            passage[rng.randrange(len(passage))] = "changed"
        if i % 3:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w).capitalize() + "."))
    docs += [(70, None), (71, ""), (72, "Two, WORDS!"), (73, "x " * 40_000 + items[1][1]), (74, "tick tock " * 30), (5, docs[5][1]), (None, items[2][1])]
    return docs, items


def test_contamination_matches_brute_force(spark, leaky):
    docs, items = leaky
    d = spark.createDataFrame([(i, t, 0.0, 1) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in D.contamination(d, b).collect()), key=str)
    want = []
    for i, t in docs:
        for k, item in items:
            s = brute_best(t, item) if i != 73 else float(item == items[1][1])
            if s >= D.SIMILARITY:
                want.append((i, k, round(s, 9)))
    assert got == sorted(want, key=str)
    clean = D.without_contaminated(d, b)
    dirty = {i for i, _, _ in want}
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i not in dirty)


def test_no_fingerprint_within_the_radius_is_lost():
    rng = np.random.default_rng(1)
    index = D.build_index([0], [" ".join(f"t{i}" for i in range(30))])
    (size,) = index.sizes
    base = index.sizes[size].fingerprints[0]
    for distance in (0, 5, D.RADIUS):
        flips = [sum(1 << int(b) for b in rng.choice(64, distance, replace=False)) for _ in range(200)]
        prints = np.array([int(base) ^ f for f in flips], np.uint64)
        assert len(D.candidates(index, size, prints)[0]) == 200


def test_decontamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f", 0.0, 1)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(d, b).count() == 0 and D.without_contaminated(d, b).count() == 1
    assert D.contamination(d.limit(0), b).count() == 0


# --- quality


def test_quality_ranks_held_out_documents(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(300):
        w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(20, 200))]
        good = i % 3 > 0
        docs.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), 0.0, 0))
        labels.append((i, int(good), None))
    docs += [(900, None, 0.0, 0), (901, "", 0.0, 0), (None, "plain words here", 0.0, 0), (5, docs[5][1], 0.0, 0), (902, "z " * 60_000, 0.0, 0)]
    labels += [(None, 1, 0), (7777, 1, 0), (3, 7, 0), (4, 1, 0)]
    df = spark.createDataFrame(docs, DOCS)
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = Q.quality_scores(df, lb).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id < 300)
    kept = Q.accepted(df, lb)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 300} == {i for i in range(300) if i % 3}


def test_quality_without_both_classes_keeps_all(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0), (2, None, 0.0, 0)], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.predicted for r in Q.quality_scores(df, labels).collect()] == [1, 1]
    assert Q.accepted(df.limit(0), labels.limit(0)).count() == 0


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(Q.FEATURES)))
    w = np.zeros(len(Q.FEATURES))
    w[:3] = (2, -1, 0.5)
    good = x @ w + rng.logistic(size=2000) > 0
    model = Q.fit_ranking(x[good], x[~good], (~good).mean())
    cosine = model.weights @ w / np.linalg.norm(model.weights) / np.linalg.norm(w)
    assert cosine > 0.97


# --- url rules

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


PAGES = [
    (1, "http://A.Example.com/en/x?q#f", ""), (2, "https://www.example.com/en/", None), (3, "http://x.net/es/a", ""),
    (4, "http://example.org/one", '<link rel="canonical" href="http://x.net/es/a">'),
    (5, "http://example.org/two", '<LINK href="/one" REL=canonical>'),
    (6, "http://example.org/three", '<meta http-equiv="refresh" content="0; url=http://ok.com/">'),
    (7, "http://example.org/four", '<link rel=canonical href="//example.org/three"><meta http-equiv=refresh content="1;url=http://x.net/es/b">'),
    (8, None, "x"), (9, "no scheme", ""), (10, "http://notexample.com", ""), (11, "x://h?a/b", ""), (12, "", None),
    (1, "http://A.Example.com/en/x?q#f", ""), (None, "http://x.net/es/a", ""),
]


@pytest.mark.parametrize("inline", [200, 0])
def test_url_verdicts(spark, monkeypatch, inline):
    monkeypatch.setattr(U, "INLINE_RULES", inline)
    df = spark.createDataFrame([(*p, "r") for p in PAGES], "page_id long, url string, html string, rule string")
    rows = U.verdicts(df, RULES).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: r for r in rows}
    for page, url, _ in PAGES:
        r = got[page]
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        assert (r.host, r.path) == (host, path)
        rule, action = brute_rule(host, path)
        assert r.rule == rule and (action is None or r.verdict == action)
    # 4 and 5 are aliases of a blocked page, 6 and 7 of a blocked and an allowed one
    assert [got[k].verdict for k in (4, 5, 6, 7, 8, 9, 10)] == ["block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert got[4].alias_of == got[5].alias_of and got[8].alias_of is None


def test_url_rules_of_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.verdicts(df, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://x.net/es/a", "")], "page_id long, url string, html string")
    assert U.verdicts(one, []).first().verdict == "allow"
