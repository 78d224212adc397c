import math
import random

import numpy as np
import pytest

from emberday.llm import ann as A
from emberday.llm import langid as L
from emberday.llm import toxicity as X
from emberday.llm.queries import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")


# --- language


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "ba", "▁ab", "c"]
    rng = np.random.default_rng(0)
    logs = np.log(rng.dirichlet(np.ones(len(pieces)), size=2).T)
    number = {p: i for i, p in enumerate(pieces)}

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in number:
                out += math.exp(logs[number[word[:k]], lang]) * total(word[k:], lang)
            elif k == 1:
                out += L._FLOOR * total(word[1:], lang)
        return out

    words = ["abab", "a", "cab", "xbx", "bbbb"]
    got = L.word_logs(L.Pieces(pieces), logs, words)
    assert np.allclose(got, [[math.log(total("▁" + w, k)) for k in (0, 1)] for w in words])
    # expected counts: derivative of the log probability by the log of each piece probability
    counts = L.expected_counts(L.Pieces(pieces), logs, words, np.ones(len(words)), np.zeros(len(words), int))
    for i in range(len(pieces)):
        up = logs.copy()
        up[i, 0] += 1e-6
        slope = (L.word_logs(L.Pieces(pieces), up, words) - got)[:, 0].sum() / 1e-6
        assert abs(counts[i, 0] - slope) < 1e-3


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    syllables = {"en": ["th", "ing", "er", "on", "wh"], "de": ["sch", "ung", "ein", "ü", "ß"], "fr": ["eau", "oi", "é", "ç", "aux"]}
    docs = []
    for i in range(240):
        lang = rng.choice(list(syllables))
        docs.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(15)), lang, 0.5))
    extra = [(900, None, "en", 0.5), (901, "123 ...", "de", 0.5), (902, "", None, 0.5), (None, "thing wher", None, 0.5), (903, "thinger " * 40_000, None, 0.5), (3, docs[3][1], None, 0.5), (904, "eau" * 100, None, 0.5)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score double")
    rows = L.predictions(df, PIECES).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {d[0]: d[2] for d in docs}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    got = {r.doc_id: r for r in rows}
    assert [got[k].lang_pred for k in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "en", "fr", "en"]
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = df.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in L.predictions(nothing, PIECES).collect()} == {"und"}
    assert L.predictions(df.limit(0), PIECES).count() == 0


# --- toxicity


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.2
    fire = np.zeros((len(y), X.VOTERS), bool)
    for k in range(6):
        fire[:, k] = rng.random(len(y)) < np.where(y, 0.7, 0.03)
    fire[:, 6] = fire[:, 7] = fire[:, 8] = rng.random(len(y)) < np.where(y, 0.5, 0.3)  # one weak voter three times
    masks = (fire << np.arange(X.VOTERS)).sum(axis=1)
    patterns, which = np.unique(masks, return_inverse=True)
    n = np.bincount(which).astype(float)
    posterior = X.label_model(patterns, n, 0 * n, 0 * n)
    assert ((posterior[which] >= 0.5) == y).mean() > 0.97
    cliques = X._cliques((patterns[:, None] >> np.arange(X.VOTERS)) & 1, posterior, n, 0 * n, 0 * n)
    assert any(set(c) >= {6, 7, 8} for c in cliques)


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(3)
    clean = [f"c{i}" for i in range(800)]
    marks = ["blarg" + s for s in ("en", "a", "ity", "os")] + ["idiot", "Worthless,", "zorp"]
    docs, labels = [], []
    for i in range(500):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(marks))
        docs.append((i, " ".join(w), 1.0))
        labels.append((i, int(toxic)))
    docs += [(900, None, 1.0), (901, "", 1.0), (902, "c1 " * 60_000, 1.0), (None, "c1 c2", 1.0), (5, docs[5][1], 1.0)]
    labels += [(None, 1), (8888, 1), (7, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, mask double")
    lb = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = X.toxicity_scores(df, lb).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and r.doc_id < 500]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    assert not any(r.predicted for r in rows if r.doc_id is None or r.doc_id >= 900)
    assert X.toxicity_scores(df.limit(0), lb).count() == 0
    alone = {r.doc_id: r.predicted for r in X.toxicity_scores(spark.createDataFrame([(1, "idiot moron scum", 0.0), (2, "fine", 0.0)], df.schema), lb.limit(0)).collect()}
    assert alone[2] == 0


# --- nearest neighbours


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK_CANDIDATES", 100)
    monkeypatch.setattr(A, "CHUNK_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).tolist(), 0) for i in range(700)]
    rows += [(1000 + 10 * i, rows[0][1], 0) for i in range(60)]  # one common vector, queries among it
    bad = [(2000, None, 0), (2010, [0.0] * 24, 0), (2020, [math.nan] * 24, 0), (2030, [math.inf] + [1.0] * 23, 0), (2040, [1.0, None] + [1.0] * 22, 0), (2050, [1.0] * 5, 0), (2060, [], 0), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows + bad + [rows[10]], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in A.nearest(df, every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    assert set(got) == {i for i in ids.tolist() if i % 10 == 0}
    found = total = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11))
        far = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        assert all(abs(far[np.flatnonzero(ids == v)[0]] - d) < 1e-12 for _, v, d in hits)
        assert [(d, v) for _, v, d in hits] == sorted((d, v) for _, v, d in hits)
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        found += len({v for _, v, _ in hits} & set(ids[order].tolist()))
        total += 10
    assert found / total >= 0.9
    # the nearest of a copy are the copies with the smallest ids
    assert [v for _, v, _ in sorted(got[1000])] == [0, *range(1010, 1100, 10)]


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [3.0, 3.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in A.nearest(df).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert A.nearest(df.limit(0)).count() == 0
