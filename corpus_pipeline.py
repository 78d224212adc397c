"""From raw documents to token files: five stages, each over all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberday.llm import decontamination, mixing, ngram_join, quality, queries, token_store
from emberday.session import written

# Words a worker remembers: it keeps them while later stages run in it.
KNOWN_WORDS = 300_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the pairwise quality ranking accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    return ngram_join.one_of_each_class(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; a document used in two epochs comes twice."""
    return mixing.mixed(docs, queries.mixing_tree(), queries.MIX_SHARE, queries.MIX_EPOCHS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in directly addressable codes; a row per document as read back."""
    return token_store.encoded_documents(docs, queries.tokenizer_file("byte_bpe_50k.json"), special=True, known=KNOWN_WORDS)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("benchmark_filter", benchmark_filter),
    ("mix", mix),
    ("token_files", token_files),
]

# Tokenizing has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
