"""Word shingles of whole texts as 64-bit hashes, computed in numpy over Arrow batches.

Words are runs of bytes other than ASCII space and ``\\t``..``\\r``, with A-Z lower-cased,
so a text always gives the same words as ``[^\\x20\\x09-\\x0D]+`` does. Every function works
on plain arrays; Spark decides which task sees which rows. Texts are hashed in slices cut
between words, so that a very long text needs a few bytes of memory per byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE_WORDS = 5
_SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C55
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
# for words of letters and digits: every other ASCII byte separates
NOT_ALPHANUMERIC = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _slice_words(buffer: np.ndarray, gap: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one slice."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~gap[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    ends = np.cumsum(lengths)
    # bytes of words only, one word after the other, and the place of each byte in its word
    letters = buffer[inside[1:-1].view(bool)]
    letters = (_LOWER[letters] if fold else letters).astype(np.uint64)
    place = np.arange(ends[-1], dtype=np.int32) - np.repeat((ends - lengths).astype(np.int32), lengths)
    letters += np.uint64(1)
    letters *= _powers(int(lengths.max()))[place]
    return starts, mix(np.add.reduceat(letters, ends - lengths) + lengths.astype(np.uint64))


def words(buffer: np.ndarray, gap: np.ndarray = _IS_SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of all words of a byte buffer, in order.

    ``gap`` tells for each byte value whether it separates words; ``fold`` lower-cases A-Z.
    """
    starts, hashes, at = [], [], 0
    while at < len(buffer):
        end = at + _SLICE_BYTES
        while end < len(buffer):
            cut = np.flatnonzero(gap[buffer[end : end + _SLICE_BYTES]])
            if len(cut):
                end += int(cut[0]) + 1
                break
            end += _SLICE_BYTES
        s, h = _slice_words(buffer[at : min(end, len(buffer))], gap, fold)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def joined(texts: Sequence[str | None], end: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer of all texts with ``end``, one byte, after each, and where each begins."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    return np.frombuffer(end.join([*parts, b""]), dtype=np.uint8), begins


def shingle_hashes(word_hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of every run of ``width`` words; of the whole sequence if it is shorter."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    total = np.full(n - width + 1, np.uint64(width))
    for k, factor in enumerate(_powers(width + 1)[1:]):
        total += word_hashes[k : n - width + 1 + k] * factor
    return mix(total)


def text_word_hashes(texts: Sequence[str | None], gap: np.ndarray = _IS_SPACE) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order."""
    buffer, begins = joined(texts)
    starts, hashes = words(buffer, gap)
    cuts = np.searchsorted(starts, begins)
    for a, b in zip(cuts, cuts[1:]):
        yield hashes[a:b]


def text_sets(texts: Sequence[str | None], width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a text without words."""
    for hashes in text_word_hashes(texts):
        yield np.unique(shingle_hashes(hashes, width))


def slices_of(texts: Sequence[str | None], limit: int = 4 << 20) -> Iterator[slice]:
    """Ranges of texts of about ``limit`` characters together, at least one text each."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > limit:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))
