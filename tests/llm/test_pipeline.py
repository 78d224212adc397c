import os

import pytest

import corpus_pipeline
from emberday.llm import decontamination, ngram_join, quality

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.columns == columns
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_filter":
            want = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            want = {r.component_id for r in ngram_join.jaccard_classes(docs).collect()}
        elif name == "benchmark_filter":
            want = before - {r.doc_id for r in decontamination.contamination(docs, benchmark).collect()}
        else:
            want = ids
        assert ids == want and ids <= before
        seen.append(len(ids))
        docs = docs.where(docs.doc_id.isin(sorted(ids)))
    assert 0 < seen[-1] <= seen[0]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).orderBy("start").collect()
    assert rows and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))
