"""Helper columns give way to columns of the tables, and null edits are none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberday.llm import mixing, ngram_join, queries, token_counts
from emberday.llm.names import free_names

EXTRA = ["_id", "_hash", "ID", "Hash", "_mix_plan", "plan", "times", "copy", "level_0", "hash_", "text_hash", "component_id"]


def test_free_names(spark):
    df = spark.range(1).select(F.lit(1).alias("Id"), F.lit(1).alias("id_"))
    assert free_names(df, "id", "id", "x") == ["id__", "id___", "x"]


def test_near_duplicates_and_mixing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other words here"), (3, "other words here")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(c) for c in EXTRA}).withColumns({"lang": F.lit("en"), "source": F.lit("src0")})
    kept = ngram_join.one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    mixed = mixing.mixed(kept, queries.mixing_tree(), 1.0, 1)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == [1, 3]


def test_null_edits(spark):
    edits = "array<struct<start:int,stop:int,insert:string>>"
    df = spark.createDataFrame(
        [(1, "some words", [None, (0, 4, "few"), None]), (2, "a b", [None]), (3, "a b", None)], f"doc_id long, text string, edits {edits}"
    )
    got = {r.doc_id: (r.n_edits, r.n_tokens, r.n_tokens_edited) for r in token_counts.edited_counts(df, queries.tokenizer_file("byte_bpe_50k.json")).collect()}
    assert got[1][0] == 1 and got[2] == (0, 2, 2) and got[3] == (0, 2, 2)


@pytest.mark.parametrize("what", ["empty", "null"])
def test_pipeline_without_content(spark, tmp_path, what):
    source = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        table = table.limit(0) if what == "empty" else table.limit(4).select(*[F.lit(None).cast(t).alias(c) for c, t in table.dtypes])
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
