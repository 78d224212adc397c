"""Language ID by unigram pieces with all segmentations summed.

Each language gives every piece of a fixed public vocabulary a probability. A word's
probability in a language is the sum over all ways to cut it into pieces, found by a forward
pass; a text's is the product over its words. Piece probabilities are fitted by expectation
maximisation on a bounded sample of labelled documents: expected piece counts come from
forward and backward passes over distinct words in the tasks, only the table of pieces and
languages comes to the driver.

Words are runs of letters, lower-cased, with a word-start mark in front; characters the
vocabulary lacks are pieces of their own with a floor probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberday.llm import shingles as S
from emberday.session import written

DOCS_PER_LANGUAGE = 400
ROUNDS = 3
# (1e-7) ** 41 still is a normal double: words of so many letters need no scaling, longer ones
# are summed one by one with a scale of their own.
MAX_WORD = 40
_SMALL = 1e-150
_STRETCH = 1 << 16
_FLOOR = 1e-7
_PSEUDO = 0.05
_MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C55)


def vocabulary(path: str) -> list[str]:
    """All letter pieces of a sentencepiece model, lower-cased, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if _LETTERS.fullmatch(p.removeprefix(_MARK) or "a"))


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, however long."""
    return _LETTERS.findall((text or "").lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of marked words, one row each, zero filled, and the lengths."""
    marked = [_MARK + w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(marked), int(lengths.max(initial=0))), np.uint64)
    rows = np.repeat(np.arange(len(marked)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


class Pieces:
    """Finds the vocabulary's pieces in many words at once, by hashes of their characters."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self._order = np.argsort(hashes)
        self._sorted = hashes[self._order]
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return S.mix(np.array([h]))[0]

    def lattice(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each piece length k the piece number ending at each position, -1 for none."""
        out, run = [], np.zeros_like(codes)
        for k in range(min(self.longest, codes.shape[1])):
            # hash of the k + 1 characters ending at each position
            step = np.zeros_like(codes)
            step[:, k:] = run[:, k - 1 : -1] if k else 0
            run = step * _BASE + codes + np.uint64(1)
            key = S.mix(run).ravel()
            likely = np.flatnonzero(self._maybe[(key >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self._sorted, key[likely]), len(self._sorted) - 1)
            found = np.full(len(key), -1)
            found[likely] = np.where(self._sorted[at] == key[likely], self._order[at], -1)
            found = found.reshape(codes.shape)
            found[:, :k] = -1
            out.append(found)
        return out


def _probabilities(logs: np.ndarray) -> np.ndarray:
    """Piece probabilities, no smaller than the floor; the last row stands for no such piece."""
    return np.vstack([np.maximum(np.exp(logs), _FLOOR), np.full(logs.shape[1], _FLOOR)])


def word_logs(pieces: Pieces, logs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language, all segmentations summed."""
    out = np.zeros((len(words), logs.shape[1]))
    probability = _probabilities(logs)
    short, long = _by_length(words)
    for part, forward, lengths, _ in _passes(pieces, probability, [words[i] for i in short]):
        out[short[part]] = np.log(forward[lengths, np.arange(len(part))])
    for i in long.tolist():
        out[i] = _long_log(pieces, probability, words[i])
    return out


def _by_length(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that need no scaling, and of the others."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.flatnonzero(size <= MAX_WORD), np.flatnonzero(size > MAX_WORD)


def _arcs(pieces: Pieces, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in one marked word: where each ends (from 1), its length less 1, and its number.

    In order of the ends. A character that is no piece is the number behind the last piece.
    The word is looked through in stretches that overlap by the longest piece.
    """
    codes, _ = _codes([word])
    found = []
    for at in range(0, codes.shape[1], _STRETCH):
        low = max(0, at - pieces.longest + 1)
        lattice = pieces.lattice(codes[:, low : at + _STRETCH])
        table = np.stack([x[0, at - low :] for x in lattice], axis=1)
        table[:, 0] = np.where(table[:, 0] < 0, len(pieces.pieces), table[:, 0])
        place, less = np.nonzero(table >= 0)
        found.append((place + at + 1, less, table[place, less]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _long_log(pieces: Pieces, probability: np.ndarray, word: str) -> np.ndarray:
    """As ``word_logs`` for one word of any length, each language rescaled when it gets small."""
    ends, less, number = _arcs(pieces, word)
    cuts = np.searchsorted(ends, np.arange(1, int(ends[-1]) + 2)).tolist()
    less, number = less.tolist(), number.tolist()
    scale = np.zeros(probability.shape[1])
    recent = [np.ones(probability.shape[1])]
    for a, b in zip(cuts, cuts[1:]):
        here = sum(recent[-1 - k] * probability[p] for k, p in zip(less[a:b], number[a:b]))
        recent = [*recent[-pieces.longest :], here]
        if here.min() < _SMALL:
            scale += np.log(here)
            recent = [r / here for r in recent]
    return np.log(recent[-1]) + scale


def _long_counts(pieces: Pieces, probability: np.ndarray, word: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers and expected uses in one word of any length, in one language, by logarithms."""
    ends, less, number = _arcs(pieces, word)
    starts, logs = ends - 1 - less, np.log(probability)[number]
    n = int(ends[-1])
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0.0
    cuts = np.searchsorted(ends, np.arange(1, n + 2))
    for j, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()), 1):
        ahead[j] = np.logaddexp.reduce(ahead[starts[a:b]] + logs[a:b])
    order = np.argsort(starts, kind="stable")
    cuts = np.searchsorted(starts[order], np.arange(n + 1)).tolist()
    for j in range(n - 1, -1, -1):
        out = order[cuts[j] : cuts[j + 1]]
        back[j] = np.logaddexp.reduce(back[ends[out]] + logs[out])
    uses = np.exp(ahead[starts] + logs + back[ends] - ahead[n])
    known = number < len(pieces.pieces)
    return number[known], uses[known]


def _passes(pieces: Pieces, probability: np.ndarray, words: list[str]) -> Iterator[tuple]:
    """Forward tables (position, word, language) of words of like length, with their lattices."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        codes, lengths = _codes([words[i] for i in part])
        lattice = pieces.lattice(codes)
        forward = np.zeros((codes.shape[1] + 1, len(part), probability.shape[1]))
        forward[0] = 1
        for j in range(1, len(forward)):
            forward[j] = forward[j - 1] * probability[lattice[0][:, j - 1]]
            for k in range(1, min(j, len(lattice))):
                some = np.flatnonzero(lattice[k][:, j - 1] >= 0)
                if len(some):
                    forward[j, some] += forward[j - 1 - k, some] * probability[lattice[k][some, j - 1]]
        yield part, forward, lengths, lattice


def expected_counts(pieces: Pieces, logs: np.ndarray, words: list[str], counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language, for counted words of known language."""
    out = np.zeros((len(pieces.pieces), logs.shape[1]))
    probability = _probabilities(logs)
    short, long = _by_length(words)
    for i in long.tolist():
        piece, uses = _long_counts(pieces, probability[:, lang[i]], words[i])
        np.add.at(out[:, lang[i]], piece, uses * counts[i])
    for part, forward, lengths, lattice in _passes(pieces, probability, [words[i] for i in short]):
        part = short[part]
        rows, of = np.arange(len(part)), lang[part]
        ahead = forward[:, rows, of]
        back = np.zeros_like(ahead)
        back[lengths, rows] = counts[part] / ahead[lengths, rows]
        for j in range(len(ahead) - 1, 0, -1):
            for k in range(min(j, len(lattice))):
                piece = lattice[k][:, j - 1]
                some = np.flatnonzero(((piece >= 0) | (k == 0)) & (back[j] > 0))
                flow = probability[piece[some], of[some]] * back[j, some]
                back[j - 1 - k, some] += flow
                known = piece[some] >= 0
                use = some[known]
                np.add.at(out, (piece[use], of[use]), ahead[j - 1 - k, use] * flow[known])
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: list[str]
    logs: np.ndarray

    def scores(self, texts: list, known: WordTable) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior, languages equally likely before; ``und`` without letters."""
        words = [letter_words(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        names, top = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        lettered = np.flatnonzero(counts)
        if len(lettered) and self.languages:
            logs = known.logs_of([w for ws in words for w in ws])
            total = np.add.reduceat(logs, (np.cumsum(counts) - counts)[lettered])
            best = total.argmax(axis=1)
            names[lettered] = np.array(self.languages, dtype=object)[best]
            top[lettered] = 1 / np.exp(np.maximum(total - total.max(axis=1)[:, None], -700)).sum(axis=1)
        return names.tolist(), top


class WordTable:
    """Log probabilities of words seen so far, at most about ``MAX_KNOWN`` of them."""

    MAX_KNOWN = 300_000

    def __init__(self, model: Model):
        self._index, self._logs = Pieces(model.pieces), model.logs
        self._row: dict[str, int] = {}
        self._table = np.empty((0, model.logs.shape[1]))

    def logs_of(self, words: list[str]) -> np.ndarray:
        if len(self._row) > self.MAX_KNOWN:
            self._row, self._table = {}, self._table[:0]
        at = np.fromiter(map(self._row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing]))
            self._row.update(zip(new, range(len(self._row), len(self._row) + len(new))))
            self._table = np.concatenate([self._table, word_logs(self._index, self._logs, new)])
            at[missing] = [self._row[words[i]] for i in missing]
        return self._table[at]


def fit(docs: DataFrame, vocabulary_path: str) -> Model:
    """Fit on about ``DOCS_PER_LANGUAGE`` documents of each language, or all there are, by a hash of the id.

    The expected number is the bound: a document is learned from if its hash is below the
    language's share, so the number varies by its square root, whatever the input.

    ``docs`` are the rows to learn from; null languages and texts without letters teach nothing.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    languages = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]
    pieces = vocabulary(vocabulary_path)
    logs = np.full((len(pieces), max(1, len(languages))), -np.log(max(1, len(pieces))))
    if not languages:
        return Model([], pieces, logs)
    # a share by a hash of the id: about as many of each language
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, DOCS_PER_LANGUAGE / n)).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for w in letter_words(text):
                    table[lang, w] = table.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in table], pa.string()),
                    "word": pa.array([k[1] for k in table], pa.string()),
                    "n": pa.array(list(table.values()), pa.int64()),
                }
            )

    counted = rows.where(spread < share).mapInArrow(count, "lang string, word string, n bigint")
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    number = {lang: k for k, lang in enumerate(languages)}
    for _ in range(ROUNDS):
        current = logs

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            index = Pieces(pieces)
            total = np.zeros_like(current)
            for batch in batches:
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                n = batch.column("n").to_numpy()
                total += expected_counts(index, current, batch.column("word").to_pylist(), n, lang)
            piece, of = np.nonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(piece), "lang": pa.array(of), "n": pa.array(total[piece, of])}
            )

        sums = words.mapInArrow(expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        table = np.full_like(logs, _PSEUDO)
        for r in sums.collect():  # at most pieces times languages
            table[r.piece, r.lang] += r.n
        logs = np.log(table / table.sum(axis=0))
    return Model(languages, pieces, logs)


def predictions(docs: DataFrame, vocabulary_path: str, folds: int = 3, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``.

    Learns from rows with a language whose crc32 of the doc_id as text leaves another remainder
    than ``held``; only the text is an input of a prediction. ``lang_pred`` is a learned
    language, ``und`` with score 0 for a null text, one without a letter, or if nothing could be
    learned; ties go to the first language in order. Whole texts count, however long. A null
    doc_id is never held out and never learned from. Repeated rows are predicted each.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs.where(remainder != held), vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(shared.value)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for part in S.slices_of(texts):
                names, top = shared.value.scores(texts[part], known)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(part.start, part.stop - part.start),
                        "lang_pred": pa.array(names, pa.string()),
                        "score": pa.array(top),
                    }
                )

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return scored.select(
        "doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
