"""The adaptive scan gives candidates up, and still finds the neighbours."""

import math

import numpy as np
import pytest

from emberday.llm import ann as A


def _vectors(n, dims=48, seed=1):
    """Rows around a few hundred centres, which is what embeddings look like at best."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(n // 20, 1), dims))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * 0.6


def _nearest(x, i, k):
    far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    return [j for j in np.lexsort((np.arange(len(x)), far)) if j != i][:k]


@pytest.mark.parametrize("bounded", [False, True])
def test_candidates_are_given_up_at_two_thousand_vectors(bounded):
    x = _vectors(2000)
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(48, 48)))[0]
    queries = x[:50]
    bounds = np.array([math.dist(x[i], x[_nearest(x, i, 10)[-1]]) for i in range(50)]) if bounded else None
    found, given_up = A.scan(queries, x, rotation, 11, bounds)
    assert given_up > 0.4 * len(queries) * len(x)
    hits = sum(len(set(_nearest(x, i, 10)) & set(where.tolist())) for i, (where, _) in enumerate(found))
    assert hits >= 0.97 * 50 * 10


@pytest.mark.parametrize("n", [600, 3000])
def test_recall_with_lists_and_early_tests(spark, n, monkeypatch):
    counted = []
    scan = A.scan
    monkeypatch.setattr(A, "scan", lambda *a: counted.append(1) or scan(*a))
    x = _vectors(n, seed=n)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in A.nearest(df, every=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for i in range(0, n, 20):
        mine = sorted(got[i])
        assert [k for k, _, _ in mine] == list(range(1, 11)) and [s for *_, s in mine] == sorted(s for *_, s in mine)
        assert all(math.isclose(s, math.dist(x[i], x[j])) for _, j, s in mine)
        hits += len({j for _, j, _ in mine} & set(_nearest(x, i, 10)))
    assert hits >= 0.9 * 10 * len(got)


def test_ten_hits_when_ids_repeat(spark):
    x = _vectors(60, dims=8)
    rows = [(i + 1000 if i else 100, v.tolist()) for i, v in enumerate(x)] + [(100, (x[0] + 0.01).tolist()), (100, (x[0] - 0.01).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in A.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    # three query rows of id 100 and one of each hundred beyond
    assert len(got[100]) == 30 and 100 not in got[100]


def test_one_vector_under_many_ids(spark):
    same = [0.5] * 8
    rows = [(i, same) for i in range(400)] + [(1000 + i, (np.ones(8) * (2 + i)).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in A.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == list(range(1, 11)) and got[100] == list(range(10)) and got[300] == list(range(10))
