"""Links between the tokens of two tokenizers over the same text.

Tokens of either side are rows of a token-by-byte incidence matrix. The product ``A @ B.T``
counts the bytes that two tokens share: overlap links. Where neighbouring rows of it have no
column in common, tokens of both sides end together; these places cut the tokens into groups,
and the product of the two token-by-group matrices links all tokens of a group.

Both tokenizers begin a new word at a space between two other characters, so no token or group
reaches across one. Each distinct word of a chunk of documents therefore is one diagonal
block: it is tokenized and multiplied once and counts for all its occurrences. A chunk is one
row of a written table; pairs of ids are counted per chunk first, so that an id pair of all
documents is one row for each chunk when counts are summed and handed back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberday.llm import shingles as S
from emberday.llm.charmap import SPACE
from emberday.llm.pieces import PieceEncoder, merged
from emberday.llm.sparse import Csr
from emberday.llm.tokens import Codes, Encoder, byte_values, words_of
from emberday.session import release, written

# Characters of a chunk of documents; a longer document is a chunk by itself.
CHUNK_CHARACTERS = 1 << 20
# Words whose tokens are kept from one chunk to the next.
KNOWN_WORDS = 250_000
_ROWS = 256
_SIDE = np.int64(32)


class Blocks:
    """Tokens, groups and links of distinct words, each read with a space in front."""

    def __init__(self, a: tuple, b: tuple, words: int):
        (self.a_ids, a_word, a_size), (self.b_ids, b_word, b_size) = a, b
        self.words = words
        self.a_word, self.b_word = a_word, b_word
        self.overlaps = Csr.intervals(a_size) @ Csr.intervals(b_size).transposed()
        first, last = self.overlaps.indices[self.overlaps.indptr[:-1]], self.overlaps.indices[self.overlaps.indptr[1:] - 1]
        cut = np.append(True, first[1:] != last[:-1]) if len(first) else np.empty(0, bool)
        self.a_group = np.cumsum(cut) - 1
        self.groups = int(self.a_group[-1]) + 1 if len(cut) else 0
        self.b_group = np.empty(len(self.b_ids), np.int64)
        self.b_group[self.overlaps.indices] = self.a_group[self.overlaps.rows()]
        self.group_word = a_word[cut]

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of links: tokens of A and of B that share a group."""
        one, other = Csr.members(self.a_group, self.groups), Csr.members(self.b_group, self.groups).transposed()
        for at, block in one.product_blocks(other):
            yield at + block.rows(), block.indices

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word, pair, times)``: id pairs linked in each word; a pair is A's id shifted by 32 bits, plus B's."""
        found = []
        for a, b in self.shared():
            pair = (self.a_ids[a].astype(np.int64) << _SIDE) + self.b_ids[b]
            found.append(_counted(self.a_word[a], pair, np.ones(len(pair), np.int64)))
        word, pair, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else [[]] * 3))
        return _counted(word, pair, times)

    def spelled(self) -> list[bytes]:
        """For each word its groups as ``a1,a2|b1;a3|b2``."""
        group, side = np.concatenate([self.a_group, self.b_group]), np.repeat([0, 1], [len(self.a_ids), len(self.b_ids)])
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        ids = np.concatenate([self.a_ids.astype(np.int64), self.b_ids])[order]
        if not len(ids):
            return [b""] * self.words
        table = _decimals(1 << int(ids.max()).bit_length())
        text, ends = table.joined(ids).copy(), np.cumsum(table.sizes[ids])
        # every number has a comma behind it; the last of a side and of a group have other signs
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        text[ends[last] - 1] = np.where(side[last] == 0, ord("|"), ord(";"))
        stops = np.concatenate([[0], ends])[np.searchsorted(self.group_word[group], np.arange(self.words), side="right")]
        raw, starts = text.tobytes(), np.concatenate([[0], stops[:-1]])
        return [raw[p : max(p, q - 1)] for p, q in zip(starts.tolist(), stops.tolist())]

    def per_word(self) -> dict[str, np.ndarray]:
        """Tokens, groups and links of each word."""
        count = {
            "n_a": np.bincount(self.a_word, minlength=self.words),
            "n_b": np.bincount(self.b_word, minlength=self.words),
            "n_groups": np.bincount(self.group_word, minlength=self.words),
        }
        links = np.bincount(self.a_group, minlength=self.groups) * np.bincount(self.b_group, minlength=self.groups)
        count["n_links"] = np.zeros(self.words, np.int64)
        np.add.at(count["n_links"], self.group_word, links)
        return count


def _counted(word: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (word, pair) added up, in order."""
    order = np.lexsort((pair, word))
    word, pair, times = word[order], pair[order], times[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1]))) if len(word) else []
    return (word[first], pair[first], np.add.reduceat(times, first)) if len(word) else (word, pair, times)


class Aligner:
    """A table of words known so far with the tokens of both sides, and the blocks of chosen words.

    Words stand after a space each, as ``words_of`` cuts them; ``whole`` tells which are spelled
    by the tokens of both sides, others have none.
    """

    def __init__(self, a_path: str, b_path: str):
        self._a, self._b = Encoder(a_path), PieceEncoder(b_path).vocabulary
        if not self._a.plain or not self._b.normalizer.is_plain or not self._b.cuts:
            raise ValueError("only plain byte-level and unnormalised piece tokenizers align word by word")
        texts, kinds = self._b.texts, self._b.kinds.tolist()
        # <0xHH> pieces are type 6 of the model format
        pieces = [bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() for t, k in zip(texts, kinds)]
        self._bytes = (_Table(byte_values(a_path)), _Table(pieces))
        self._forget()

    def renew(self, most: int = KNOWN_WORDS) -> None:
        """Forget all words if there are more than ``most``."""
        if len(self.codes) > most:
            self._forget()

    def _forget(self) -> None:
        self.codes = Codes()
        self._sides = [_Ids(), _Ids()]
        self.whole = np.empty(0, bool)

    def learn(self) -> None:
        """Tokenize the words that ``codes`` has met since the last call."""
        words = self.codes.take()
        if not words:
            return
        raw, begins = S.joined([" " + w for w in words], b"\n")
        size = np.diff(begins) - 1
        b_ids, _, b_count = merged(self._b, [SPACE + w.replace(" ", SPACE) for w in words])
        found = [self._a.ids_of(words), (b_ids, np.cumsum(b_count) - b_count, b_count)]
        whole = np.ones(len(words), bool)
        for side, (ids, start, count), table in zip(self._sides, found, self._bytes):
            ends = np.concatenate([[0], np.cumsum(table.sizes[ids])])
            whole &= ends[start + count] - ends[start] == size
            side.add(ids, start, count)
        # where sizes fit, compare the bytes
        inner = np.repeat(whole, np.diff(begins))
        inner[begins[1:] - 1] = False
        want, owner = raw[inner], np.repeat(np.arange(len(words)), np.diff(begins))[inner]
        first = len(self.whole)
        fits = first + np.flatnonzero(whole)
        for side, table in zip(self._sides, self._bytes):
            whole[owner[table.joined(side.of(fits)[0]) != want]] = False
        self.whole = np.concatenate([self.whole, whole])

    def blocks(self, codes: np.ndarray) -> Blocks:
        """The blocks of distinct known words; words that are not whole have no tokens."""
        place = np.flatnonzero(self.whole[codes])
        parts = []
        for side, table in zip(self._sides, self._bytes):
            ids, count = side.of(codes[place])
            parts.append((ids, np.repeat(place, count), table.sizes[ids]))
        return Blocks(parts[0], parts[1], len(codes))


class _Ids:
    """Token ids of numbered words."""

    def __init__(self):
        self._ids, self._start, self._count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        self._start = np.concatenate([self._start, len(self._ids) + start])
        self._count = np.concatenate([self._count, count])
        self._ids = np.concatenate([self._ids, ids.astype(np.int32)])

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and ids per word."""
        count = self._count[words]
        ends = np.cumsum(count)
        return self._ids[np.repeat(self._start[words] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)], count


class _Table:
    """Byte strings of a vocabulary, joined by id."""

    def __init__(self, values: list[bytes]):
        self.sizes = np.fromiter(map(len, values), np.int64, len(values))
        self._starts = np.cumsum(self.sizes) - self.sizes
        self._bytes = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return self._bytes[np.repeat(self._starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=4)
def _decimals(size: int) -> _Table:
    """Numbers below ``size``, each with a comma."""
    return _Table([b"%d," % i for i in range(size)])


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(a_path, b_path)


class _Chunk:
    """Word codes of some documents, and the blocks of their distinct words."""

    def __init__(self, texts: list[str | None], align: Aligner):
        align.renew()
        parts = [words_of(t) if t else [] for t in texts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        known = np.fromiter(map(align.codes.__getitem__, chain.from_iterable(parts)), np.int64, count.sum())
        align.learn()
        # a document with a word that is not spelled by its tokens has no tokens
        torn = np.concatenate([[0], np.cumsum(~align.whole[known])])
        ends = np.cumsum(count)
        good = torn[ends] == torn[ends - count]
        distinct, self.code = np.unique(known[np.repeat(good, count)], return_inverse=True)
        self.count = np.where(good, count, 0)
        self.ends = np.cumsum(self.count)
        self.blocks = align.blocks(distinct)

    def summed(self, per_word: np.ndarray) -> np.ndarray:
        """A number of each word added up over the words of each document."""
        return _summed(per_word, self.code, self.ends, self.count)

    def words(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.ends - self.count, self.ends):
            yield self.code[a:b]


def _summed(per_word: np.ndarray, code: np.ndarray, ends: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per_word[code])])
    return total[ends] - total[ends - count]


def _chunks(batches: Iterator[pa.RecordBatch], align: Aligner) -> Iterator[tuple[pa.Array, _Chunk]]:
    """Documents of several batches together, up to ``CHUNK_CHARACTERS``."""
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            doc_ids, found = (c.slice(at, _ROWS) for c in (batch.column("doc_id"), batch.column("text")))
            found = found.to_pylist()
            for part in S.slices_of(found, CHUNK_CHARACTERS):
                n = sum(len(t or "") for t in found[part])
                if texts and size + n > CHUNK_CHARACTERS:
                    yield pa.concat_arrays(ids), _Chunk(texts, align)
                    ids, texts, size = [], [], 0
                ids.append(doc_ids.slice(part.start, part.stop - part.start))
                texts += found[part]
                size += n
    if texts:
        yield pa.concat_arrays(ids), _Chunk(texts, align)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest whole bytes that hold the largest, that width first."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) >> 8 * w == 0)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def write_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per chunk: its documents with their counts and digests, word codes, links of words, id pairs.

    ``pairs`` are the distinct id pairs linked in the chunk, ascending, ``pair_docs`` how many
    of its documents hold each.
    """
    kind = dict(docs.dtypes)["doc_id"]
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, align = TaskContext.get().partitionId(), aligner(a_path, b_path)
        for seq, (ids, chunk) in enumerate(_chunks(batches, align)):
            blocks = chunk.blocks
            counts = {k: chunk.summed(v) for k, v in blocks.per_word().items()}
            spelled = blocks.spelled()
            digests = [
                hashlib.sha256(b";".join(map(spelled.__getitem__, w.tolist()))).hexdigest() if len(w) else ""
                for w in chunk.words()
            ]
            word, pair, times = blocks.pairs()
            pairs, link = np.unique(pair, return_inverse=True)
            per_word = np.bincount(word, minlength=blocks.words)
            held = np.zeros(len(pairs), np.int64)
            ends = np.cumsum(per_word)
            for w in chunk.words():
                w = np.unique(w)
                n = per_word[w]
                at = np.repeat(ends[w] - np.cumsum(n), n) + np.arange(n.sum())
                held[np.unique(link[at])] += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([(task << 32) + seq], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(id_type)),
                    **{k: pa.array([counts[k]], pa.list_(pa.int64())) for k in _COUNTS},
                    "groups_sha256": pa.array([digests], pa.list_(pa.string())),
                    "doc_words": pa.array([chunk.count], pa.list_(pa.int64())),
                    "words": pa.array([packed(chunk.code)], pa.binary()),
                    "word_links": pa.array([packed(per_word)], pa.binary()),
                    "links": pa.array([packed(link)], pa.binary()),
                    "times": pa.array([packed(times)], pa.binary()),
                    "pairs": pa.array([pairs], pa.list_(pa.int64())),
                    "pair_docs": pa.array([held], pa.list_(pa.int64())),
                }
            )
        align.renew(0)  # an idle worker keeps no words

    lists = ", ".join(f"{k} array<bigint>" for k in _COUNTS)
    schema = (
        f"chunk bigint, doc_ids array<{kind}>, {lists}, groups_sha256 array<string>, doc_words array<bigint>, words binary, "
        "word_links binary, links binary, times binary, pairs array<bigint>, pair_docs array<bigint>"
    )
    return written(docs.select("doc_id", "text").mapInArrow(rows, schema), "token-links")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``(pair, a_id, b_id, documents, best)`` of a chunk table: documents that hold each id pair linked.

    ``best`` tells whether no other pair of the same A id is in more documents.
    """
    counts = (
        chunks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("documents"))
        .select("pair", F.shiftright("pair", 32).alias("a_id"), F.expr("pair & 4294967295").alias("b_id"), "documents")
    )
    top = counts.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counts.join(top, "a_id").select("pair", "a_id", "b_id", "documents", (F.col("documents") == F.col("most")).alias("best"))


def link_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts, corpus-wide link figures and a digest of the groups for every row of ``docs``.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``. Texts that are
    null or empty or not spelled by the tokens of both sides have zeros and an empty digest.
    Documents are rows: repeated ones come again and count again. No rows give no rows; other
    columns are not read.
    """
    chunks = write_chunks(docs, a_path, b_path)
    counts = written(pair_counts(chunks), "token-pairs")
    known = (
        chunks.select(F.col("chunk").alias("of_chunk"), F.explode("pairs").alias("pair"))
        .join(counts.select("pair", "documents", "best"), "pair")
        .select("of_chunk", "pair", "documents", "best")
    )
    kind = dict(docs.dtypes)["doc_id"]
    numbers = (*_COUNTS, "n_best", "count_sum")

    def finish(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]  # every chunk has pairs or none, pairs have a chunk
        order = np.argsort(pairs.column("pair").to_numpy())
        documents = pairs.column("documents").to_numpy()[order]
        best = pairs.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        code, per_word, link, times = (unpacked(row[k]) for k in ("words", "word_links", "links", "times"))
        count = np.array(row["doc_words"], np.int64)
        word = np.repeat(np.arange(len(per_word)), per_word)
        out = {"doc_id": chunk.column("doc_ids").combine_chunks().flatten()}
        out |= {k: pa.array(row[k], pa.int64()) for k in _COUNTS}
        for name, value in (("n_best", best), ("count_sum", documents)):
            of_word = np.zeros(len(per_word), np.int64)
            np.add.at(of_word, word, value[link] * times)
            out[name] = pa.array(_summed(of_word, code, np.cumsum(count), count), pa.int64())
        return pa.table(out | {"groups_sha256": pa.array(row["groups_sha256"], pa.string())})

    schema = f"doc_id {kind}, {', '.join(f'{k} bigint' for k in numbers)}, groups_sha256 string"
    found = chunks.drop("pairs", "pair_docs").groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(finish, schema)
    digests = written(found, "token-digests")
    release(chunks, counts)
    return digests


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_groups, b_groups)`` of every row: ids, and the group of each token.

    Tokens of equal group number are linked. Rows without tokens, as for ``link_digests``,
    have empty lists.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(batches, aligner(a_path, b_path)):
            blocks = chunk.blocks
            a_ends, b_ends, g_ends = (np.cumsum(blocks.per_word()[k]) for k in ("n_a", "n_b", "n_groups"))
            out: dict[str, list] = {k: [] for k in ("a_ids", "b_ids", "a_groups", "b_groups")}
            for words in chunk.words():
                before = 0
                found: dict[str, list] = {k: [] for k in out}
                for w in words.tolist():
                    start = g_ends[w - 1] if w else 0
                    for side, ends, ids_, group in (("a", a_ends, blocks.a_ids, blocks.a_group), ("b", b_ends, blocks.b_ids, blocks.b_group)):
                        span = slice(ends[w - 1] if w else 0, ends[w])
                        found[f"{side}_ids"] += ids_[span].tolist()
                        found[f"{side}_groups"] += (group[span] - start + before).tolist()
                    before += g_ends[w] - start
                for k, v in found.items():
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": ids} | {k: pa.array(v, pa.list_(pa.int32())) for k, v in out.items()})

    schema = f"doc_id {kind}, " + ", ".join(f"{k} array<int>" for k in ("a_ids", "b_ids", "a_groups", "b_groups"))
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
