"""Compressed sparse rows built by hand, with Gustavson's row-by-row product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# A block of rows of a product expands into about so many terms at a time.
TERMS = 1 << 18


class Csr:
    """A matrix of small whole numbers: ``indices[indptr[i]:indptr[i + 1]]`` are the columns of row i."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, columns: int):
        self.indptr, self.indices, self.data, self.columns = indptr, indices, data, columns

    def __len__(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def intervals(cls, sizes: np.ndarray) -> Csr:
        """Row i holds the next ``sizes[i]`` columns: tokens over the bytes of a text."""
        indptr = np.concatenate([[0], np.cumsum(sizes)])
        n = int(indptr[-1])
        return cls(indptr, np.arange(n), np.ones(n, np.int64), n)

    @classmethod
    def members(cls, groups: np.ndarray, count: int) -> Csr:
        """Row i holds the one column ``groups[i]``."""
        return cls(np.arange(len(groups) + 1), np.asarray(groups), np.ones(len(groups), np.int64), count)

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, self.rows()[order], self.data[order], len(self))

    def product_blocks(self, other: Csr) -> Iterator[tuple[int, Csr]]:
        """``self @ other`` in blocks of rows, each with the number of its first row.

        Row i of a product is the sum of the rows of ``other`` named by the entries of row i,
        times these entries; columns come in ascending order.
        """
        width = np.diff(other.indptr)
        terms = np.concatenate([[0], np.cumsum(width[self.indices])])[self.indptr]
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(terms, terms[at] + TERMS, side="right")) - 1)
            yield at, self._product(other, width, at, end)
            at = end

    def _product(self, other: Csr, width: np.ndarray, at: int, end: int) -> Csr:
        a, b = self.indptr[at], self.indptr[end]
        middle = self.indices[a:b]
        count = width[middle]
        ends = np.cumsum(count)
        pick = np.repeat(other.indptr[middle] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        row = np.repeat(np.repeat(np.arange(end - at), np.diff(self.indptr[at : end + 1])), count)
        value = np.repeat(self.data[a:b], count) * other.data[pick]
        key = row * other.columns + other.indices[pick]
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        summed = np.add.reduceat(value, first) if len(first) else value
        row, column = np.divmod(key[first], max(other.columns, 1))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - at))])
        return Csr(indptr, column, summed, other.columns)

    def __matmul__(self, other: Csr) -> Csr:
        blocks = [block for _, block in self.product_blocks(other)]
        sizes = np.concatenate([[0], *(np.diff(b.indptr) for b in blocks)]).astype(np.int64)
        return Csr(
            np.cumsum(sizes),
            np.concatenate([np.empty(0, np.int64), *(b.indices for b in blocks)]),
            np.concatenate([np.empty(0, np.int64), *(b.data for b in blocks)]),
            other.columns,
        )
