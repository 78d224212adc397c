"""Ranked lexical search: every document against a stated set of items, by blocked dense products.

Items come in blocks of bounded size. For a block, each document keeps the terms it shares with
the block's vocabulary; these rows are written once and give the corpus statistics. Then tiles
of documents meet tiles of items: the items' weights over the compact vocabulary of their tile
times the documents' impacts over it, as matrices of doubles. All entries are whole numbers and
vocabulary tiles are so narrow that sums stay below 2^53, so every product is exact; tiles are
added up as 64-bit integers. Each task keeps the best of each item, ties to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.llm import shingles as S
from emberday.session import release, written

TOP = 50
# An item block's texts have about so many bytes, or it is one longer item.
BLOCK_BYTES = 16 << 20
ITEM_TILE, VOCABULARY_TILE, DOCUMENT_TILE = 256, 2048, 4096
# Tasks' bests of an item are first reduced in so many parts.
PARTS = 64
_EXACT = 1 << 53
# letters and digits of ASCII, A-Z lowered; other ASCII parts terms, further bytes are kept
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lowered."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Block:
    """Some items: their ids, the ids of their distinct terms, and the vocabulary of all of them."""

    items: list
    item_terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """All items in blocks of about ``BLOCK_BYTES`` of text, one block in memory at a time."""
    block, size = Block([], [], {}), 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        number = block.vocabulary.setdefault
        found = np.unique(np.array([number(t, len(block.vocabulary)) for t in terms(text)], np.int64))
        block.items.append(item_id)
        block.item_terms.append(found)
        size += len(text or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = Block([], [], {}), 0
    if block.items:
        yield block


def shared_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of documents with a term: their terms of a vocabulary, ``n`` counts all."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of a block of items of bounded size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in S.slices_of(texts):
                n, found, times = [], [], []
                for text in texts[part]:
                    words = terms(text)
                    known = np.array([k for k in map(number, words) if k is not None], np.int32)
                    ids, tf = np.unique(known, return_counts=True)
                    n.append(len(words))
                    found.append(ids)
                    times.append(tf)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(part.start, part.stop - part.start),
                        "n": pa.array(n, pa.int64()), "terms": pa.array(found, pa.list_(pa.int32())),
                        "tfs": pa.array(times, pa.list_(pa.int64())),
                    }
                )

    schema = f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(rows, schema).where("n > 0")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Whole-number weights of terms by the number of documents that hold them."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Saturated frequencies of terms in documents of ``n`` terms, before the weight."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        length = np.array([(50 * k * documents) // total for k in n.tolist()], np.int64)
    else:
        length = 50 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + length))


def tile_scores(
    item_terms: list[np.ndarray], weight: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int
) -> np.ndarray:
    """Scores (items x docs) from entries ``(doc, term, impact)`` by products over the tile's own terms."""
    own = np.unique(np.concatenate(item_terms))
    own = own[weight[own] > 0]
    scores = np.zeros((len(item_terms), docs), np.int64)
    if not len(own):
        return scores
    place = np.full(len(weight), -1)
    place[own] = np.arange(len(own))
    column = place[term]
    inside = column >= 0
    column, doc, impact = column[inside], doc[inside], impact[inside]
    if not len(column):
        return scores
    largest = int(weight[own].max()) * int(impact.max())
    width = max(1, min(VOCABULARY_TILE, (_EXACT - 1) // max(largest, 1)))
    order = np.argsort(column, kind="stable")
    column, doc, impact = column[order], doc[order], impact[order]
    rows = np.repeat(np.arange(len(item_terms)), [len(t) for t in item_terms])
    columns = place[np.concatenate(item_terms)]
    for at in range(0, len(own), width):
        end = min(at + width, len(own))
        some = (columns >= at) & (columns < end)
        left = np.zeros((len(item_terms), end - at))
        left[rows[some], columns[some] - at] = weight[own[columns[some]]]
        a, b = np.searchsorted(column, [at, end])
        right = np.zeros((end - at, docs))
        right[column[a:b] - at, doc[a:b]] = impact[a:b]
        scores += (left @ right).astype(np.int64)
    return scores


def best(scores: np.ndarray, place: np.ndarray, keep: int, floor: int) -> np.ndarray:
    """Positions of the ``keep`` highest scores above 0 and not below ``floor``, ties by ``place``, best first."""
    at = np.flatnonzero((scores > 0) & (scores >= floor))
    if len(at) > keep:
        least = np.partition(scores[at], len(at) - keep)[len(at) - keep]
        above, level = at[scores[at] > least], at[scores[at] == least]
        need = keep - len(above)
        if len(level) > need:
            level = level[np.argpartition(place[level], need - 1)[:need]]
        at = np.concatenate([above, level])
    return at[np.lexsort((place[at], -scores[at]))]


def _order(doc_id) -> tuple:
    return doc_id is None, 0 if doc_id is None else doc_id


class _Best:
    """The best documents so far of each item of a block."""

    def __init__(self, items: int):
        self.found: list[list[tuple]] = [[] for _ in range(items)]

    def add(self, first: int, scores: np.ndarray, doc_ids: list, place: np.ndarray) -> None:
        for i, row in enumerate(scores, first):
            held = self.found[i]
            floor = -held[-1][0] if len(held) == TOP else 1
            new = [(-int(row[k]), _order(doc_ids[k]), doc_ids[k]) for k in best(row, place, TOP, floor).tolist()]
            if new:
                self.found[i] = sorted([*held, *new], key=lambda x: x[:2])[:TOP]


def _search(rows: DataFrame, block: Block, weight: np.ndarray, documents: int, total: int) -> DataFrame:
    """Each task's best documents of every item of a block."""
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast((block.item_terms, weight))  # of one block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_terms, weight = shared.value
        held = _Best(len(item_terms))
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for at in range(0, len(batch), DOCUMENT_TILE):
                part = batch.slice(at, DOCUMENT_TILE)
                doc_ids, n = part.column("doc_id").to_pylist(), part.column("n").to_numpy()
                count = np.diff(part.column("terms").offsets.to_numpy())
                doc = np.repeat(np.arange(len(part)), count)
                term = part.column("terms").flatten().to_numpy()
                impact = impacts(part.column("tfs").flatten().to_numpy(), n[doc], documents, total)
                place = np.empty(len(part), np.int64)
                place[sorted(range(len(part)), key=lambda k: _order(doc_ids[k]))] = np.arange(len(part))
                for first in range(0, len(item_terms), ITEM_TILE):
                    tile = item_terms[first : first + ITEM_TILE]
                    held.add(first, tile_scores(tile, weight, doc, term, impact, len(part)), doc_ids, place)
        item = [i for i, found in enumerate(held.found) for _ in found]
        if item:
            flat = [f for found in held.found for f in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array(item, pa.int32()), "doc_id": pa.array([f[2] for f in flat], doc_type),
                    "score": pa.array([-f[0] for f in flat], pa.int64()),
                }
            )

    return rows.mapInArrow(search, f"item int, doc_id {kind}, score bigint")


def _block_results(docs: DataFrame, block: Block, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    rows = written(shared_terms(docs, block.vocabulary), "search-terms")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    for term, count in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[term] = count
    found = _search(rows.where(F.size("terms") > 0), block, weights(df, documents), documents, total)
    ascending = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    few = (
        found.withColumn("part", part).withColumn("k", F.row_number().over(W.partitionBy("item", "part").orderBy(*ascending)))
        .where(F.col("k") <= TOP)
        .withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*ascending))).where(F.col("rank") <= TOP)
    )
    names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {item_type}")
    top = written(few.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "search-top")
    release(rows)
    return top


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``TOP`` best documents of each item, best first.

    Only scores above 0 count; equal scores go to the smaller doc_id, a null doc_id comes last.
    Documents are rows of ``docs``: repeated ones rank one after the other, null texts and
    texts without terms take no part. Items are rows of ``items``: repeated ones are answered
    each; an item without terms, or any item where there are no documents, has no rows. Other
    columns are not read. Documents are read once for each block of items.
    """
    item_type, doc_type = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    results = [_block_results(docs, block, item_type) for block in item_blocks(items)]
    if not results:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score bigint")
    return reduce(DataFrame.unionByName, results)
