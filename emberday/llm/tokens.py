"""Token ids of whole texts from a tokenizer file, with repeated words looked up.

A byte-level BPE never merges across a single space between two non-space characters: the
space opens the next word. Texts are cut there, each distinct word is encoded by the tokenizers
library when a worker first meets it, and the ids of a text are the ids of its words. Most words
of a corpus are met once; a worker's table is kept small by keeping those met again.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

# Above so many known words those met only once are forgotten.
MAX_KNOWN = 900_000
# Letters below this sign are letters in every version of Unicode the libraries may follow.
_SURE_LETTERS = "\u0250"
# A space beside other white space may belong to a longer run: no cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r" \s|\s |^ | $")
_RARE_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def _uneven(text: str) -> bool:
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
        return True
    return any(c in text for c in _RARE_SPACE) and _RUN.search(text) is not None


# Put in front of a text's first word, which has no space before it; no other word holds a
# single space between other characters.
_OPENING = "x y"


def _marked(text: str | None) -> list[str]:
    if not text:
        return []
    words = words_of(text)
    words[0] = _OPENING + words[0]
    return words


def _spelled(word: str) -> str:
    return word.removeprefix(_OPENING) if word.startswith(_OPENING) else " " + word


def words_of(text: str) -> list[str]:
    """What lies between the single spaces of a text that have no white space beside them."""
    return _CUT.split(text) if _uneven(text) else text.split(" ")


class Codes(dict):
    """Numbers of words in the order they were first met."""

    def __init__(self):
        super().__init__()
        self._fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self._fresh.append(word)
        return code

    def kept(self, codes: np.ndarray) -> Codes:
        """These words alone, given by their numbers in ascending order, numbered from 0."""
        words, fewer = list(self), Codes()
        fewer.update((words[code], new) for new, code in enumerate(codes.tolist()))
        return fewer

    def take(self) -> list[str]:
        """Words met since the last call, in the order of their numbers."""
        fresh, self._fresh = self._fresh, []
        return fresh


def _is_plain_byte_level(tokenizer) -> bool:
    spec = json.loads(tokenizer.to_str())
    cut = spec["pre_tokenizer"] or {}
    options = (cut.get("add_prefix_space"), cut.get("use_regex", True))
    return not spec["normalizer"] and cut.get("type") == "ByteLevel" and options == (False, True)


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))


def byte_values(path: str) -> list[bytes]:
    """The bytes each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    back = {letter: b for b, letter in _LETTERS.items()}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]


class Encoder:
    """``encode`` gives the ids ``tokenizers`` gives for every text.

    With ``special`` the file's added tokens are found in texts, as the library does by itself;
    else they are plain text. They hold no space, so words still are encoded alone. ``known`` words
    are remembered, at some 200 bytes each; how many changes time and memory alone.
    """

    def __init__(self, path: str, special: bool = False, known: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._known = MAX_KNOWN if known is None else known
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special
        # letters are one pre-token of a byte-level BPE; the model then needs no pattern search
        self._model = self._tokenizer.model if _is_plain_byte_level(self._tokenizer) else None
        self._clear()

    @property
    def plain(self) -> bool:
        """Whether ids only depend on the words cut by ``words_of``, and spell them byte by byte."""
        return self._model is not None

    def _clear(self) -> None:
        self._codes = Codes()
        self._tails: dict[str, list[int]] = {}
        self._start = np.empty(0, np.int64)
        self._length = np.empty(0, np.int64)
        self._ids = np.empty(0, np.uint32)
        self._met = np.empty(0, np.int64)

    def _tidy(self) -> None:
        """Forget words met once since the last time; never keep more than half the table."""
        keep = np.flatnonzero(self._met > 1)
        most = self._known // 2
        if len(keep) > most:
            keep = np.sort(keep[np.argpartition(-self._met[keep], most)[:most]])
        self._codes = self._codes.kept(keep)
        self._tails.clear()
        self._ids, ends = self._gather(keep)
        self._length = self._length[keep]
        self._start = ends - self._length
        self._met = np.zeros(len(keep), np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text; null is empty."""
        code, cuts = self._look_up([_marked(t) for t in texts])
        ids, ends = self._gather(code)
        return ids, np.diff(np.concatenate([[0], ends])[cuts])

    def word_counts(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Per text: characters and number of ids of each of its words, spaces in front included.

        Words are those of ``words_of``; the ids of a text are those of its words in order.
        """
        words = [_marked(t) for t in texts]
        code, cuts = self._look_up(words)
        counts = self._length[code]
        for parts, a, b in zip(words, cuts, cuts[1:]):
            sizes = [len(w) + 1 for w in parts]
            if sizes:
                sizes[0] -= len(_OPENING) + 1
            yield sizes, counts[a:b]

    def _look_up(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all words, and where each text's words begin; unknown words are learned."""
        if len(self._codes) > self._known:
            self._tidy()
        cuts = np.cumsum([0, *map(len, words)])
        code = np.fromiter(map(self._codes.__getitem__, chain.from_iterable(words)), np.int64, cuts[-1])
        self._learn(self._codes.take())
        self._met += np.bincount(code, minlength=len(self._met))
        return code, cuts

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self._length[code]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self._ids[np.repeat(self._start[code] - (ends - lengths), lengths) + np.arange(total)], ends

    def _learn(self, words: list[str]) -> None:
        if words:
            ids, start, length = self.ids_of(words)
            self._start = np.concatenate([self._start, len(self._ids) + start])
            self._length = np.concatenate([self._length, length])
            self._ids = np.concatenate([self._ids, ids])
            self._met = np.concatenate([self._met, np.zeros(len(words), np.int64)])

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in some order, and where those of each word begin and how many they are.

        Each word stands after a space. Those of letters, with or without ASCII punctuation
        behind them, are encoded by the model, others by the whole tokenizer.
        """
        plain = self._model is not None
        by_model, rest = [], []
        ids: list[int] = []
        length = np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            core = word.rstrip(string.punctuation)
            if plain and core.isalpha() and (core.isascii() or max(core) < _SURE_LETTERS):
                before = len(ids)
                ids += self._letters(core)
                if len(core) < len(word):
                    ids += self._tail(word[len(core) :])
                length[k] = len(ids) - before
                by_model.append(k)
            else:
                rest.append(k)
        for k, found in zip(rest, self._whole([_spelled(words[k]) for k in rest])):
            length[k] = len(found)
            ids += found
        order = np.array(by_model + rest, np.int64)
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return np.array(ids, np.uint32), start, length

    def _letters(self, core: str) -> list[int]:
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self._model.tokenize("Ġ" + core)]

    def _tail(self, tail: str) -> list[int]:
        """Punctuation behind letters: a pre-token of its own, or several."""
        if tail not in self._tails:
            self._tails[tail] = self._whole([tail])[0]
        return self._tails[tail]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False, known: int | None = None) -> Encoder:
    """One encoder per worker process, file, reading of special strings and size of its table."""
    return Encoder(path, special, known)
