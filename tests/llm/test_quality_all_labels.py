"""The quality ranking learns from every labelled row, also from those beyond one block."""

import numpy as np
import pytest

from emberday.llm import quality as Q


@pytest.fixture
def labelled(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words[: 50 if i % 2 else 12], 30)) + "!" * int(rng.integers(0, 4)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    return docs, labels


def test_each_labelled_row_moves_the_weights(labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(Q, "ROWS_PER_CLASS", 10)
    whole = Q.fit_from_labels(docs, labels).weights
    for absent in (17, 64):
        assert np.abs(Q.fit_from_labels(docs, labels.where(f"doc_id <> {absent}")).weights - whole).max() > 1e-9


def test_blocks_hold_every_row(labelled, spark, monkeypatch):
    docs, labels = labelled
    rows = docs.join(labels.where("quality = 1 or doc_id < 40"), "doc_id").selectExpr(
        "doc_id", "quality", f"transform(sequence(1, {len(Q.FEATURES)}), i -> cast(doc_id as double)) AS x", "doc_id AS h"
    )
    monkeypatch.setattr(Q, "ROWS_PER_CLASS", 10)
    found = Q._blocks(rows, {1: 60, 0: 20}).collect()
    side = {c: [v for r in found for v in np.frombuffer(r[c]).reshape(-1, len(Q.FEATURES))[:, 0]] for c in ("good", "bad")}
    assert sorted(side["good"]) == list(range(1, 120, 2))
    assert set(side["bad"]) == set(range(0, 40, 2))
