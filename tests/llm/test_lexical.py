"""Ranked search against plain integer arithmetic over every document and item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from emberday.llm import lexical as X

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, items, top=50):
    found = [(d, _TERM.findall((t or "").translate(_LOW))) for d, t in docs]
    found = [(d, Counter(t), len(t)) for d, t in found if t]
    n, total = len(found), sum(k for _, _, k in found)
    df = Counter(t for _, tf, _ in found for t in tf)
    out = []
    for item_id, text in items:
        asked = set(_TERM.findall((text or "").translate(_LOW)))
        scores = []
        for doc_id, tf, size in found:
            m = 50 + (50 * size * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in asked & tf.keys()
            )
            if s:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return out


def _rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def corpus():
    rng = random.Random(4)
    words = ["Über", "x1", "straße", "the", "of", "a", "漢字"] + [f"w{k}" for k in range(60)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(400)]
    docs += [(k + 400, "copied words w1 W2 the") for k in range(120)] + [(7, "the of"), (7, "the of"), (None, "w3 w4"), (900, None), (901, " .,"), (902, "")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(30)]
    return docs, items + [(30, "copied"), (31, ""), (32, None), (33, "nowhere"), (None, "the W1"), (0, items[0][1])]


@pytest.mark.parametrize("tiles", [(256, 2048, 4096, 1 << 24), (4, 3, 16, 1 << 24), (5, 2048, 100, 200)])
def test_ranks_equal_plain_arithmetic(spark, corpus, monkeypatch, tiles):
    for name, size in zip(("ITEM_TILE", "VOCABULARY_TILE", "DOCUMENT_TILE", "BLOCK_BYTES"), tiles):
        monkeypatch.setattr(X, name, size)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in corpus[0]], "doc_id long, text string, item_id int, n int").repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in corpus[1]], "item_id long, text string, score int")
    assert _rows(X.ranked(docs, items)) == sorted(expected(*corpus), key=str)


def test_nothing_to_search(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert X.ranked(docs.limit(0), items).count() == 0
    assert X.ranked(docs, items.limit(0)).count() == 0
    assert X.ranked(docs.where("text is null"), items).count() == 0


def test_text_ids_and_one_very_long_text(spark):
    docs = [("b", "alpha " * 50_000 + "beta"), ("a", "alpha"), ("c", "alpha"), ("é", "alpha")]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    got = X.ranked(frame, spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got if r.doc_id != "b"] == ["a", "c", "é"] and len(got) == 4


def test_sums_stay_exact_near_the_limit():
    # weights and impacts so large that a tile holds one term at a time
    weight = np.array([1 << 27, 1 << 27, 3], np.int64)
    impact = np.array([(1 << 25) - 1, (1 << 25) - 3, 5], np.int64)
    got = X.tile_scores([np.array([0, 1, 2])], weight, np.zeros(3, int), np.arange(3), impact, 1)
    assert got[0, 0] == sum(int(w) * int(v) for w, v in zip(weight, impact))


def test_lengths_beyond_64_bits():
    got = X.impacts(np.array([1]), np.array([10**9]), 10**12, 10**15)
    assert got[0] == 1_000_000_000 // (1000 + 20 * (50 + 50 * 10**9 * 10**12 // 10**15))


def test_ties_take_the_smaller_place():
    scores = np.array([5, 9, 5, 0, 5, 9])
    assert X.best(scores, np.array([3, 5, 1, 0, 2, 4]), 4, 1).tolist() == [5, 1, 2, 4]
