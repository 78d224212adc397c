import random
import re

import pytest

from emberday.llm import ngram_join
from emberday.llm.components import components
from emberday.llm.ngram_join import jaccard_classes, one_of_each_class

SCHEMA = "doc_id long, text string, component_id string, n int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                of[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


def family(rng, words, size, edits):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(size)] = rng.choice(words)
        yield " ".join(copy)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = [t for size, edits in ((60, 4), (30, 2), (9, 1)) for t in family(rng, words, size, edits)]
    common = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{common} {' '.join(rng.choice(words) for _ in range(50))}" for _ in range(30)]
    texts += ["one two", "One  TWO", "one two three", "", None, " \n\t", "a b c d e", "a b c d e f", "É b c d e f", "é b c d e f"]
    texts += ["long " * 30_000 + "end", "long " * 30_000 + "end"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)] + [(3, texts[2]), (6, "quite another text here now"), (None, texts[5])]


@pytest.mark.parametrize("block, small", [(2048, 16), (8, 2)])
def test_classes_match_brute_force(spark, documents, monkeypatch, block, small):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in documents], SCHEMA)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()]
    assert sorted(got, key=str) == brute(documents)


def test_one_of_each_class_keeps_columns_and_clean_rows(spark, documents):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in documents], SCHEMA)
    kept = one_of_each_class(df)
    assert kept.columns == df.columns
    want = {c for d, n, c in brute(documents) if n} | {d for d, n, _ in brute(documents) if not n}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard_classes(df).count() == 0
    assert one_of_each_class(df).count() == 0


def test_components_of_chains_hubs_and_repeats(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(200, 7), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
