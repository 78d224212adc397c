"""SentencePiece encoding with source offsets, and decoding, for BPE models with byte fallback.

A text is normalised with the source byte of every normalised byte (``charmap``), cut before
each place that follows other characters, and each distinct word is merged once per worker:
in every round the best pair of each word, by score and then from the left, becomes one piece,
for all new words at once. Characters outside the vocabulary become their UTF-8 bytes. The
widths of the pieces lead back through the normaliser's map to spans of the original text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from emberday.llm import shingles as S
from emberday.llm.charmap import SPACE, Normalizer
from emberday.llm.tokens import Codes

MAX_KNOWN = 500_000
# Words of more characters are merged with a heap, one by one.
LONG_WORD = 64
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # piece types of the model format
_BPE = 2  # model type of the format
_NEVER = 1 << 30
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Vocabulary:
    """Pieces of a model, the pairs that merge into them, and its normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        kinds = [p.type for p in spec.pieces]
        if spec.trainer_spec.model_type != _BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are read")
        if spec.trainer_spec.treat_whitespace_as_suffix or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("models with own symbols, unused pieces or spaces behind words are not read")
        norm = spec.normalizer_spec
        self.normalizer = Normalizer(
            norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        )
        self.dummy_prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.unknown = spec.trainer_spec.unk_surface
        self.texts = [p.piece for p in spec.pieces]
        self.kinds = np.array(kinds)
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kinds == _BYTE).tolist():
            self.byte_ids[int(self.texts[i][3:5], 16)] = i
        self._read_pairs({p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}, [p.score for p in spec.pieces])
        # a cut before a place that follows other characters is safe if no piece has one inside
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.texts)

    def _read_pairs(self, ids: dict[str, int], scores: list[float]) -> None:
        """Symbols are pieces, and characters that only occur inside pieces."""
        symbols = dict(ids)
        for c in sorted({c for t in ids for c in t} - set(ids)):
            symbols[c] = len(self.texts) + len(symbols) - len(ids)
        self.symbols = symbols
        rank_of = {s: k for k, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for text, i in ids.items():
            for k in range(1, len(text)):
                one, other = symbols.get(text[:k]), symbols.get(text[k:])
                if one is not None and other is not None:
                    pairs[one, other] = (rank_of[scores[i]], i)
        self.base = len(self.texts) + len(symbols) - len(ids) + 1
        keys = np.array([a * self.base + b for a, b in pairs], np.int64).reshape(-1)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.pair_ids = keys[order], values[order, 0], values[order, 1]
        self._sorted_keys = array("q", self.pair_keys.tolist())  # quick to search one by one
        single = sorted((ord(t), s) for t, s in symbols.items() if len(t) == 1)
        self.characters = np.array([c for c, _ in single], np.int64)
        self.character_symbols = np.array([s for _, s in single], np.int64)

    def pair(self, left: int, right: int) -> tuple[int, int] | None:
        """Rank and piece of the merge of two symbols."""
        key = left * self.base + right
        at = bisect_left(self._sorted_keys, key)
        if at < len(self._sorted_keys) and self._sorted_keys[at] == key:
            return int(self.pair_ranks[at]), int(self.pair_ids[at])
        return None

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair of symbols (``_NEVER`` if there is none) and the piece it makes."""
        if not len(self.pair_keys):
            return np.full(len(left), _NEVER), np.zeros(len(left), np.int64)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == key
        return np.where(known, self.pair_ranks[at], _NEVER), self.pair_ids[at]


def merged(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words one after the other, the normalised bytes each id covers, and ids per word.

    Bytes of a character outside the vocabulary cover nothing but for the last, which covers it.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.minimum(np.searchsorted(vocabulary.characters, points), len(vocabulary.characters) - 1)
    known = vocabulary.characters[at] == points
    # a character unknown to all pieces is its code point below zero
    symbols = np.where(known, vocabulary.character_symbols[at], -1 - points)
    word = np.repeat(np.arange(len(words)), size)
    rest = size[word] <= LONG_WORD
    parts = [_merged_together(vocabulary, symbols[rest], word[rest])]
    ends = np.cumsum(size)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        done = _merged_alone(vocabulary, symbols[ends[k] - size[k] : ends[k]].tolist())
        parts.append((np.array(done, np.int64), np.full(len(done), k)))
    symbols, word = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(word, kind="stable")
    return _with_bytes(vocabulary, symbols[order], word[order], len(words))


def _merged_together(vocabulary: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of many words, one merge a word and round."""
    done_symbols, done_words = [], []
    last = np.append(word[1:] != word[:-1], True) if len(word) else np.empty(0, bool)
    rank, piece = np.full(len(word), _NEVER), np.zeros(len(word), np.int64)
    inner = np.flatnonzero(~last)
    rank[inner], piece[inner] = vocabulary.ranked(symbols[inner], symbols[inner + 1])
    while len(word):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        place = np.arange(len(word))
        best = np.minimum.reduceat((rank << 32) + place, first)
        open_ = best >> 32 < _NEVER
        at = best[open_] & 0xFFFFFFFF
        symbols[at] = piece[at]
        keep = np.repeat(open_, np.diff(first, append=len(word)))
        done_symbols.append(symbols[~keep])
        done_words.append(word[~keep])
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, word, rank, piece = symbols[keep], word[keep], rank[keep], piece[keep]
        at = moved[at]
        # the pairs on both sides of a new piece are new
        for left in (at, at[at > 0] - 1):
            inside = left + 1 < len(word)
            inside[inside] = word[left[inside]] == word[left[inside] + 1]
            rank[left[~inside]] = _NEVER
            left = left[inside]
            rank[left], piece[left] = vocabulary.ranked(symbols[left], symbols[left + 1])
    return np.concatenate([*done_symbols, np.empty(0, np.int64)]), np.concatenate([*done_words, np.empty(0, np.int64)])


def _merged_alone(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """Symbols left of one long word: pairs wait in a heap, stale ones are passed over."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    waiting: list[tuple[int, int, int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < len(symbols):
            found = vocabulary.pair(symbols[left], symbols[right])
            if found:
                heapq.heappush(waiting, (found[0], left, symbols[left], symbols[right], found[1]))

    gone = bytearray(len(symbols))
    for i in range(len(symbols)):
        offer(i)
    while waiting:
        _, left, a, b, piece = heapq.heappop(waiting)
        right = after[left]
        if gone[left] or right >= len(symbols) or symbols[left] != a or symbols[right] != b:
            continue
        symbols[left] = piece
        gone[right] = 1
        after[left] = after[right]
        if after[left] < len(symbols):
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [s for s, g in zip(symbols, gone) if not g]


def _with_bytes(vocabulary: Vocabulary, symbols: np.ndarray, word: np.ndarray, words: int):
    """Symbols that are no pieces spelled as bytes."""
    sizes = np.array([len(t.encode()) for t in vocabulary.texts], np.int64)
    size = len(vocabulary.texts)
    spelled = {t: s for t, s in vocabulary.symbols.items() if s >= size}
    point = {s: ord(t) for t, s in spelled.items()}
    bare = np.flatnonzero((symbols < 0) | (symbols >= size))
    count = np.ones(len(symbols), np.int64)
    raw = [chr(point[s] if s >= 0 else -1 - s).encode("utf-8", "surrogatepass") for s in symbols[bare].tolist()]
    count[bare] = np.fromiter(map(len, raw), np.int64, len(raw))
    whole = np.ones(len(symbols), bool)
    whole[bare] = False
    ids = np.repeat(np.where(whole, symbols, 0), count)
    width = np.repeat(np.where(whole, sizes[np.where(whole, symbols, 0)], 0), count)
    fallback = np.repeat(~whole, count)
    ids[fallback] = vocabulary.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    width[np.cumsum(count)[bare] - 1] = count[bare]
    return ids, width, np.bincount(np.repeat(word, count), minlength=words)


class PieceEncoder:
    """Ids and source spans of texts by a model file; null and empty texts have none."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.vocabulary = Vocabulary(f.read())
        self._clear()

    def _clear(self) -> None:
        self._codes = Codes()
        self._start = np.empty(0, np.int64)
        self._length = np.empty(0, np.int64)
        self._ids = np.empty(0, np.int32)
        self._width = np.empty(0, np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, widths in normalised bytes, and ids per word, of words cut as ``cut`` does."""
        if len(self._codes) > MAX_KNOWN:
            self._clear()
        code = np.fromiter(map(self._codes.__getitem__, words), np.int64, len(words))
        fresh = self._codes.take()
        if fresh:
            ids, width, length = merged(self.vocabulary, fresh)
            self._start = np.concatenate([self._start, len(self._ids) + np.cumsum(length) - length])
            self._length = np.concatenate([self._length, length])
            self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
            self._width = np.concatenate([self._width, width.astype(np.int32)])
        length = self._length[code]
        ends = np.cumsum(length)
        pick = np.repeat(self._start[code] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return self._ids[pick], self._width[pick], length

    def cut(self, normalised: str) -> list[str]:
        """Words of a normalised text: each begins at a place behind other characters."""
        if not self.vocabulary.cuts:
            return [normalised] if normalised else []
        if SPACE + SPACE in normalised or not normalised.startswith(SPACE):
            return _RUNS.findall(normalised)
        return [SPACE + w for w in normalised[1:].split(SPACE)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and where the span of each begins and ends in the text's bytes."""
        normal = [self.vocabulary.normalizer.normalize(t or "") for t in texts]
        words = [self.cut(n.decode()) for n, _ in normal]
        ids, width, length = self.encode_words(list(chain.from_iterable(words)))
        ends = np.concatenate([[0], np.cumsum(length)])
        at = 0
        for (_, origin), parts in zip(normal, words):
            a, b = ends[at], ends[at + len(parts)]
            at += len(parts)
            close = np.cumsum(width[a:b], dtype=np.int64)
            begin, end = origin[close - width[a:b]], origin[close]
            # the bytes of a character but the last stand where it begins
            yield ids[a:b], begin, np.where(width[a:b] > 0, end, begin)


class PieceDecoder:
    """Texts of id sequences by a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self._vocabulary = vocabulary
        kinds, texts = vocabulary.kinds, vocabulary.texts
        is_text = [k == _NORMAL for k in kinds.tolist()]
        raw = [
            t.replace(SPACE, " ").encode() if plain else bytes([int(t[3:5], 16)]) if k == _BYTE
            else vocabulary.unknown.encode() if k == _UNKNOWN else b""
            for t, k, plain in zip(texts, kinds.tolist(), is_text)
        ]
        self._raw, self._is_byte = raw, kinds == _BYTE
        self._opens = np.array([p and t.startswith(SPACE) for t, p in zip(texts, is_text)])

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 become replacement characters, one each."""
        ids = np.asarray(ids, np.int64)
        data = b"".join(map(self._raw.__getitem__, ids.tolist()))
        try:
            text = data.decode()
            apart = (self._vocabulary.kinds[ids] == _CONTROL).any()
        except UnicodeDecodeError:  # then some run of byte pieces is no UTF-8 by itself
            apart = True
        # control pieces part runs of byte pieces
        return (self._with_bytes(ids) if apart else text)[self._lead(ids) :]

    def _lead(self, ids: np.ndarray) -> int:
        """Spaces of the first pieces that stand for no source."""
        vocabulary = self._vocabulary
        if not (vocabulary.dummy_prefix or vocabulary.squeeze):
            return 0
        lead = 0
        for i in ids.tolist():
            if vocabulary.kinds[i] == _CONTROL:
                continue
            if self._opens[i]:
                lead += 1
                if vocabulary.squeeze and vocabulary.texts[i] == SPACE:
                    continue
            break
        return lead

    def _with_bytes(self, ids: np.ndarray) -> str:
        """Runs of byte pieces decoded for themselves, character by character."""
        is_byte = self._is_byte[ids]
        cuts = np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            data = b"".join(map(self._raw.__getitem__, ids[a:b].tolist()))
            out.append(_lenient(data) if is_byte[a] else data.decode())
        return "".join(out)


def _lenient(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if 0xC0 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF8 else 0
        try:
            out.append(data[at : at + size].decode() if size else "")
        except UnicodeDecodeError:
            size = 0
        if not size or len(data) < at + size:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def piece_decoder(path: str) -> PieceDecoder:
    return PieceDecoder(piece_encoder(path).vocabulary)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids, begins, ends)`` of every row: piece ids and their byte spans in the text.

    Null and empty texts have empty lists; repeated rows come again; no rows give no rows. Of
    other columns none is read. A place put in front of a text has the span ``(0, 0)`` unless
    it is part of a longer piece.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>"

    def rows(doc_ids: pa.Array, found: list) -> dict:
        return {
            "doc_id": doc_ids,
            "ids": _lists([i for i, _, _ in found], pa.int32()),
            "begins": _lists([b for _, b, _ in found], pa.int64()),
            "ends": _lists([e for _, _, e in found], pa.int64()),
        }

    return docs.select("doc_id", "text").mapInArrow(_by_slices(model, rows), schema)


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32)`` of every row of ``docs``.

    Digests of the decimal ids joined by commas, of the text decoded from the ids, and of the
    64-bit ends of the pieces' byte spans. Null is read as empty, which has no ids; repeated
    rows come again; no rows give no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint"

    def rows(doc_ids: pa.Array, found: list) -> dict:
        decode = piece_decoder(model).decode
        decimal = _decimals(len(piece_encoder(model).vocabulary.texts))
        listed = [b",".join(map(decimal.__getitem__, ids.tolist())) for ids, _, _ in found]
        return {
            "doc_id": doc_ids,
            "n_tokens": pa.array([len(ids) for ids, _, _ in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in listed]),
            "decoded_sha256": pa.array([hashlib.sha256(decode(ids).encode()).hexdigest() for ids, _, _ in found]),
            "spans_crc32": pa.array([zlib.crc32(e.astype("<i8").tobytes()) for _, _, e in found], pa.int64()),
        }

    return docs.select("doc_id", "text").mapInArrow(_by_slices(model, rows), schema)


def decoded(pieces: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` of rows with ``doc_id`` and ``ids``; null ids give a null text, a null id is left out."""
    kind = dict(pieces.dtypes)["doc_id"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = piece_decoder(model).decode
        for batch in batches:
            found = [
                None if ids is None else decode(np.array([i for i in ids if i is not None], np.int64))
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(found, pa.string())})

    return pieces.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string")


@lru_cache(maxsize=2)
def _decimals(size: int) -> list[bytes]:
    return [b"%d" % i for i in range(size)]


def _by_slices(model: str, rows):
    """A function over record batches that encodes slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(model).encode
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in S.slices_of(texts, 1 << 20):
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_pydict(rows(ids, list(encode(texts[part]))))

    return run


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate([*parts, np.empty(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))
