"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Texts are words of letters and digits (A-Z lower-cased), items are multisets of five-word
shingles. In every document each window of an item's size gets a 64-bit SimHash; the
multi-index finds all items of that size whose fingerprint lies within ``RADIUS`` bits; the
weighted Jaccard similarity of the two multisets, ``sum(min) / sum(max)`` of the counts,
decides at ``SIMILARITY``.

* The index cuts a fingerprint into ``BLOCKS`` bytes. If two fingerprints differ in at most
  ``RADIUS = BLOCKS * 3 - 1`` bits, one block differs in at most two, and each block's table
  holds all values within two bits of an item's. So no fingerprint within the radius is lost.
* At similarity 0.8 fingerprints differ in some 10 bits with a standard deviation of 3, so
  the radius misses practically no window that counts.
* A window without any shingle of the benchmark has similarity 0; windows are built only
  around benchmark shingles, which loses nothing.

The benchmark is dealt into chunks of a bounded number of words; each chunk is sent to the
tasks and all documents are read against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberday.llm import shingles as S

SIMILARITY = 0.8
BLOCKS = 8
RADIUS = BLOCKS * 3 - 1
CHUNK_WORDS = 1_000_000
_WINDOWS_AT_ONCE = 4096


@dataclass(frozen=True)
class _Size:
    """Items with the same number of shingles and their multi-index."""

    items: list[int]
    fingerprints: np.ndarray
    tables: np.ndarray  # (BLOCKS, 256, items): is the block value within two bits of the item's


@dataclass(frozen=True)
class Index:
    ids: list
    shingles: list[np.ndarray]
    known: np.ndarray
    sizes: dict[int, _Size]
    short: dict[int, list[int]]


def simhash_windows(hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the ``size`` shingles from each start; every occurrence counts."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[starts + size] - total[starts]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts of two multisets of hashes."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a = np.bincount(where[: len(a)], minlength=len(values))
    in_b = np.bincount(where[len(a) :], minlength=len(values))
    return float(np.minimum(in_a, in_b).sum() / max(1, np.maximum(in_a, in_b).sum()))


def build_index(ids: list, texts: list) -> Index:
    """Items under five words have one shingle, the whole sequence; without words, none."""
    near = np.array([[(i ^ j).bit_count() <= 2 for j in range(256)] for i in range(256)])
    shingles, by_size, short = [], {}, {}
    for k, words in enumerate(S.text_word_hashes(texts, S.NOT_ALPHANUMERIC)):
        shingles.append(S.shingle_hashes(words))
        if 0 < len(words) < S.SHINGLE_WORDS:
            short.setdefault(int(shingles[-1][0]), []).append(k)
        elif len(words):
            by_size.setdefault(len(shingles[-1]), []).append(k)
    sizes = {}
    for size, members in by_size.items():
        prints = np.concatenate([simhash_windows(shingles[k], size, np.array([0])) for k in members])
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        sizes[size] = _Size(members, prints, np.stack([near[:, blocks[:, b]] for b in range(BLOCKS)]))
    known = np.unique(np.concatenate([shingles[k] for m in by_size.values() for k in m] or [np.empty(0, np.uint64)]))
    return Index(ids, shingles, known, sizes, short)


def candidates(index: Index, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (window, item) with fingerprints within ``RADIUS``, items of this size only."""
    entry = index.sizes[size]
    blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
    hit = np.zeros((len(prints), len(entry.items)), bool)
    for b in range(BLOCKS):
        hit |= entry.tables[b, blocks[:, b]]
    window, item = np.nonzero(hit)
    close = np.bitwise_count(prints[window] ^ entry.fingerprints[item]) <= RADIUS
    return window[close], np.array(entry.items)[item[close]]


def matches(words: np.ndarray, index: Index) -> dict[int, tuple[float, int, int]]:
    """``item number: (similarity, first word, words)`` of the best window, ties to the first."""
    best: dict[int, tuple[float, int, int]] = {}
    runs = S.shingle_hashes(words)
    if not len(runs):
        return best
    if len(words) < S.SHINGLE_WORDS:
        return {k: (1.0, 0, len(words)) for k in index.short.get(int(runs[0]), ())}
    if not len(index.known):
        return best
    at = np.minimum(np.searchsorted(index.known, runs), len(index.known) - 1)
    hits = np.flatnonzero(index.known[at] == runs)
    if not len(hits):
        return best
    for size in index.sizes:
        width = min(size, len(runs))
        for near in _touching(hits, width, len(runs)):
            low = int(near[0])
            prints = simhash_windows(runs[low : int(near[-1]) + width], width, near - low)
            for w, k in zip(*candidates(index, size, prints)):
                start = int(near[w])
                score = weighted_jaccard(runs[start : start + width], index.shingles[k])
                if score >= SIMILARITY and score > best.get(k, (0.0,))[0]:
                    best[int(k)] = (score, start, width + S.SHINGLE_WORDS - 1)
    return best


def _touching(hits: np.ndarray, width: int, n: int) -> Iterator[np.ndarray]:
    """Window starts whose window holds a hit, in runs of neighbours of bounded length."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(hits - width + 1, 0), 1)
    np.add.at(mark, hits + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark)[: n - width + 1] > 0)
    for part in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
        for at in range(0, len(part), _WINDOWS_AT_ONCE):
            yield part[at : at + _WINDOWS_AT_ONCE]


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark as indexes of about ``CHUNK_WORDS`` words each."""
    items = benchmark.select("item_id", "text").where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    chunks = -(-words // CHUNK_WORDS)
    for k in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).orderBy("item_id", "text").collect()
        yield build_index([r.item_id for r in rows], [r.text for r in rows])


def _batch_matches(batch: pa.RecordBatch, index: Index) -> Iterator[dict[int, tuple[float, int, int]]]:
    texts = batch.column("text").to_pylist()
    for part in S.slices_of(texts):
        for words in S.text_word_hashes(texts[part], S.NOT_ALPHANUMERIC):
            yield matches(words, index)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: a row per document row and item found.

    A window is as long as the item, or the whole document if that is shorter; the best
    window of an item counts, the first of equal ones. Items under five words match only a
    document of just these words. Null and empty texts and items match nothing; repeated
    documents and items are reported each; ids may be null. Other columns are not read. An
    empty benchmark or document table gives no rows.
    """
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, similarity double, first_word bigint, n_words bigint"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for i, best in enumerate(_batch_matches(batch, shared.value)):
                    rows += [i] * len(best)
                    found += [(shared.value.ids[k], *v) for k, v in sorted(best.items())]
                if rows:
                    item, score, first, n = zip(*found)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column("doc_id").take(pa.array(rows)),
                            "item_id": pa.array(item, item_type), "similarity": pa.array(score),
                            "first_word": pa.array(first), "n_words": pa.array(n),
                        }
                    )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with all their columns."""
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not best for best in _batch_matches(batch, shared.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
