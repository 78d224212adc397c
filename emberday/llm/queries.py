"""The operators of this subpackage applied to their whole driver tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberday.llm import (
    ann, decontamination, langid, lexical, mixing, ngram_join, pieces, quality, token_counts, token_links, token_store,
    toxicity, url_filter,
)


def tokenizer_file(name: str) -> str:
    """A file of the public tokenizers installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mixing_tree() -> list[mixing.Level]:
    """Domains by source, languages and sources below them, with the weights of siblings."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    domain = F.when(F.col("source") == "src0", "web").when(number % 2 == 0, "books").otherwise("forums")
    return [
        mixing.Level("domain", domain, F.expr("CASE domain WHEN 'web' THEN 0.4 WHEN 'books' THEN 0.4 ELSE 0.2 END")),
        mixing.Level("lang", F.col("lang"), F.expr("CASE lang WHEN 'en' THEN 0.4 ELSE 0.2 END")),
        mixing.Level("source", F.col("source"), F.lit(1.0)),
    ]


MIX_SHARE, MIX_EPOCHS = 0.6, 2


def op1_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_read(spark, sf_dir, "documents"), mixing_tree(), MIX_SHARE, MIX_EPOCHS)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_read(spark, sf_dir, "documents"))


def op3_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op4_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(_read(spark, sf_dir, "pages"), URL_RULES)


def op5_directly_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encoded_documents(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), special=True)


def three_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits each: a sentence put in, a span rewritten, a span taken out.

    Places follow from the doc_id, over the whole text.
    """
    size = F.coalesce(F.length("text"), F.lit(0))

    def place(k: int):
        return F.pmod(F.xxhash64(F.lit(k), "doc_id"), size + 1).cast("int")

    def edit(start, length: int, insert):
        return F.struct(start.alias("start"), (start + length).alias("stop"), insert.alias("insert"))

    note = F.concat(F.lit(" Note "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(": corrected here. "))
    edits = F.array(edit(place(1), 0, note), edit(place(2), 12, F.lit("rewritten")), edit(place(3), 60, F.lit("")))
    return docs.select("doc_id", "text", edits.alias("edits"))


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = three_edits(_read(spark, sf_dir, "documents"))
    return token_counts.edited_counts(docs, tokenizer_file("byte_bpe_50k.json"), special=True)


def op7_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_incidence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return token_links.link_digests(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op13_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_hierarchical_mixing": op1_hierarchical_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_segmentation_unigrams": op3_segmentation_unigrams,
    "op4_url_aliases": op4_url_aliases,
    "op5_directly_addressable_tokens": op5_directly_addressable_tokens,
    "op6_edit_aware_counts": op6_edit_aware_counts,
    "op7_weak_supervision_toxicity": op7_weak_supervision_toxicity,
    "op8_adaptive_dimension_scan": op8_adaptive_dimension_scan,
    "op9_simhash_decontamination": op9_simhash_decontamination,
    "op10_bradley_terry_quality": op10_bradley_terry_quality,
    "op11_incidence_alignment": op11_incidence_alignment,
    "op12_offset_pieces": op12_offset_pieces,
    "op13_blocked_search": op13_blocked_search,
}
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Classes of linked documents, every pair with a common shingle counted.
_OP2_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), cut AS (
  SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)) AS i FROM worded
), items AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM cut
), sized AS (
  SELECT d.doc_id, count(i.s) AS n FROM documents d LEFT JOIN items i USING (doc_id) GROUP BY 1
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sized x ON x.doc_id = a.doc_id JOIN sized y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (max(x.n) + max(y.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT sized.doc_id, sized.n AS n_shingles, min(reach.r) AS component_id
FROM sized JOIN reach USING (doc_id) GROUP BY 1, 2
"""

# The test pages hold no canonical link or refresh, so the rules alone decide there.
_OP4_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM named
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict,
  CAST(NULL AS VARCHAR) AS alias_of
FROM ruled
"""

_OP13_SQL = f"""
WITH worded AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
), sized AS (
  SELECT doc_id, r, t, len(t) AS n FROM worded WHERE len(t) > 0
), total AS (
  SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sized
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM sized) GROUP BY 1, 2
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY 1
), impact AS (
  SELECT doc_id, r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))) AS v
  FROM tf JOIN sized USING (r) JOIN weight USING (term), total
), asked AS (
  SELECT DISTINCT item_id, i, term FROM (
    SELECT item_id, row_number() OVER () AS i,
      unnest(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
), scored AS (
  SELECT item_id, i, doc_id, r, CAST(sum(v) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY 1, 2, 3, 4
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""

SQL: dict[str, str] = {
    "op2_ngram_join": _OP2_SQL,
    "op4_url_aliases": _OP4_SQL,
    "op13_blocked_search": _OP13_SQL,
}
