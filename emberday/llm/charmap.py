"""Normalisation of texts for a piece vocabulary, with the source byte of every normalised byte.

A compiled character map is a double-array trie over UTF-8 bytes and a block of replacement
strings. At each place of a text the longest prefix in the trie is replaced; without one, a
character stands for itself. Spaces are then squeezed and written as ``SPACE`` as the model
says. The walk through the trie takes one step for all places of a text at once.
"""

from __future__ import annotations

import struct

import numpy as np

SPACE = "▁"
_SPACE_BYTES = np.frombuffer(SPACE.encode(), np.uint8)
_BLANK = 32


class CharacterMap:
    """The trie and the replacements of a compiled map; an empty blob maps nothing."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        units = np.frombuffer(blob, "<u4", size // 4, 4 if blob else 0).astype(np.int64)
        self._label = units & 0x800000FF
        self._leaf = (units >> 8) & 1 == 1
        self._value = units & 0x7FFFFFFF
        self._offset = (units >> 10) << ((units & 512) >> 6)
        self._strings = np.frombuffer(blob, np.uint8, len(blob) - 4 - size, 4 + size) if blob else np.empty(0, np.uint8)
        self._ends = np.flatnonzero(self._strings == 0)

    def __bool__(self) -> bool:
        return len(self._label) > 0

    def longest(self, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of a byte array: length of the longest mapped prefix (0: none) and its replacement."""
        length, found = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        alive = np.arange(len(places))
        node = np.full(len(places), self._offset[0])
        depth = 0
        while len(alive):
            at = places[alive] + depth
            inside = at < len(text)
            alive, node, at = alive[inside], node[inside], at[inside]
            step = node ^ text[at]
            fits = step < len(self._label)
            fits[fits] = self._label[step[fits]] == text[at][fits]
            alive, step = alive[fits], step[fits]
            node = step ^ self._offset[step]
            depth += 1
            leaf = self._leaf[step]
            length[alive[leaf]] = depth
            found[alive[leaf]] = self._value[node[leaf]]
        return length, found

    def replacement(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where replacements begin in ``strings`` and how long they are."""
        return found, self._ends[np.searchsorted(self._ends, found)] - found

    @property
    def strings(self) -> np.ndarray:
        return self._strings


class Normalizer:
    """``normalize`` as a model's normaliser specification says."""

    def __init__(self, charmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self._map = CharacterMap(charmap)
        self._dummy, self._squeeze, self._escape = dummy_prefix, squeeze, escape

    @property
    def is_plain(self) -> bool:
        """Whether only a place is put in front and spaces are escaped."""
        return not self._map and not self._squeeze and self._dummy and self._escape

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source byte of each of them and of the end.

        A place put in front stands at the first source byte that counts.
        """
        source = np.frombuffer(text.encode(), np.uint8)
        if not len(source):
            return b"", np.zeros(1, np.int64)
        start = None
        if self._map:
            out, origin, opens, start = self._replaced(source)
        else:
            out, origin, opens = source, *[np.arange(len(source))] * 2
        first, end = 0, len(source)
        if self._squeeze:
            kept = self._squeezed(out, opens)
            out, origin = out[kept], origin[kept]
            first = start if start is not None else int(origin[0]) if len(origin) else end
        if self._escape:
            blank = out == _BLANK
            width = np.where(blank, len(_SPACE_BYTES), 1)
            origin, out = np.repeat(origin, width), np.repeat(out, width)
            out[np.repeat(blank, width)] = np.tile(_SPACE_BYTES, int(blank.sum()))
        if self._dummy:
            mark = _SPACE_BYTES if self._escape else np.array([_BLANK], np.uint8)
            out = np.concatenate([mark, out])
            origin = np.concatenate([np.full(len(mark), first), origin])
        result, origin = out.tobytes(), np.append(origin, end)
        if self._squeeze:
            mark = SPACE.encode() if self._escape else b" "
            size = len(result)
            while result.endswith(mark, 0, size):
                size -= len(mark)
            result, origin = result[:size], origin[: size + 1]
        return result, origin

    def _replaced(self, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Bytes after the map, their source places, for each the first byte of its replaced prefix,
        and the source place of the first prefix that is not just one space.
        """
        starts = np.flatnonzero((source & 0xC0) != 0x80)
        width = np.diff(starts, append=len(source))
        length, found = self._map.longest(source, starts)
        mapped = length > 0
        stride = np.where(mapped, length, width)
        # characters inside a longer prefix that begins before them are not begun anew
        stays = np.ones(len(starts), bool)
        until = 0
        for k in np.flatnonzero(stride > width).tolist():
            if starts[k] < until:
                continue
            until = starts[k] + stride[k]
            stays[k + 1 : np.searchsorted(starts, until)] = False
        starts, width, found, mapped = starts[stays], width[stays], found[stays], mapped[stays]
        at, size = self._map.replacement(np.where(mapped, found, 0))
        begin = np.where(mapped, at + len(source), starts)
        size = np.where(mapped, size, width)
        ends = np.cumsum(size)
        pick = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        out = np.concatenate([source, self._map.strings])[pick]
        spaces = size == 1
        spaces[spaces] = out[(ends - size)[spaces]] == _BLANK
        start = int(starts[np.argmin(spaces)])
        return out, np.repeat(starts, size), np.repeat(ends - size, size), start

    def _squeezed(self, out: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The bytes that stay: not the first spaces of a prefix that follow a space or open the text."""
        blank = out == _BLANK
        inked = np.maximum.accumulate(np.where(blank, -1, np.arange(len(out))))
        leads = blank & (inked < opens)
        before = np.where(opens > 0, blank[opens - 1], True)
        return np.flatnonzero(~(leads & before))
