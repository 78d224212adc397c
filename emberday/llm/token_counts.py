"""Edit-aware token counts: a tree of counts per document, edits re-encode only what they touch.

Leaves are pre-token groups, a word with the space in front of it: a byte-level BPE never
merges across a single space between two other characters, so a leaf's ids depend on nothing
else. Inner nodes hold the characters and tokens below them. An edit finds its leaves by
descending the tree, takes one more leaf on either side as context, cuts and encodes that
region anew and updates the sums above it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberday.llm import shingles as S
from emberday.llm.tokens import Encoder, encoder

LEAVES_PER_BLOCK = 64


class CountTree:
    """Token counts of one text under edits. ``total`` is the count of the text as it stands."""

    def __init__(self, text: str | None, encode: Encoder, leaves: tuple[Sequence[int], Sequence[int]] | None = None):
        self.text = text or ""
        self.read = 0
        self._encode = encode
        sizes, counts = leaves if leaves is not None else next(iter(encode.word_counts([self.text])))
        self._build(list(map(int, sizes)), list(map(int, counts)))

    @property
    def total(self) -> int:
        return self._tokens[1]

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        n = LEAVES_PER_BLOCK
        self._blocks = [(sizes[i : i + n], counts[i : i + n]) for i in range(0, len(sizes), n)] or [([], [])]
        width = 1
        while width < len(self._blocks):
            width *= 2
        self._width = width
        self._chars, self._tokens = [0] * (2 * width), [0] * (2 * width)
        for k, (s, c) in enumerate(self._blocks):
            self._chars[width + k], self._tokens[width + k] = sum(s), sum(c)
        for k in range(width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self._chars[k] = self._chars[2 * k] + self._chars[2 * k + 1]
        self._tokens[k] = self._tokens[2 * k] + self._tokens[2 * k + 1]

    def _leaf_at(self, position: int) -> tuple[int, int, int]:
        """Block, place in it and first character of the leaf that holds or ends at ``position``."""
        k, start = 1, 0
        while k < self._width:
            k *= 2
            if start + self._chars[k] < position:
                start += self._chars[k]
                k += 1
        block = min(k - self._width, len(self._blocks) - 1)
        sizes = self._blocks[block][0]
        for place, size in enumerate(sizes):
            if start + size >= position or place == len(sizes) - 1:
                return block, place, start
            start += size
        return block, 0, start

    def _step(self, block: int, place: int, by: int) -> tuple[int, int] | None:
        """The next leaf to the right (1) or left (-1), over empty blocks; None at the end."""
        place += by
        while not 0 <= place < len(self._blocks[block][0]):
            block += by
            if not 0 <= block < len(self._blocks):
                return None
            place = 0 if by > 0 else len(self._blocks[block][0]) - 1
        return block, place

    def edit(self, start: int, stop: int, insert: str = "") -> None:
        """Replace characters ``start`` to ``stop`` (cut to the text) by ``insert``."""
        self.close(*next(iter(self._encode.word_counts([self.open(start, stop, insert)]))))

    def open(self, start: int, stop: int, insert: str = "") -> str:
        """Change the text; returns what ``close`` needs the words of.

        In two steps, so that the regions of many documents are encoded together.
        """
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        first_block, first, begin = self._leaf_at(start)
        if before := self._step(first_block, first, -1):
            first_block, first = before
            begin -= self._blocks[first_block][0][first]
        last_block, last, at = self._leaf_at(stop)
        end = at + (self._blocks[last_block][0][last] if self._blocks[last_block][0] else 0)
        if end <= stop and (after := self._step(last_block, last, 1)):
            last_block, last = after
            end += self._blocks[last_block][0][last]
        if after := self._step(last_block, last, 1):
            last_block, last = after
            end += self._blocks[last_block][0][last]
        region = self.text[begin:start] + insert + self.text[stop:end]
        self.text = self.text[:start] + insert + self.text[stop:]
        self.read += len(region)
        self._pending = (first_block, first, last_block, last, begin > 0)
        # an inner region begins with a leaf's space; a mark in front keeps it there
        return f"x{region}" if begin > 0 else region

    def close(self, sizes: Sequence[int], counts: Sequence[int]) -> None:
        """Put in the leaves of the region that ``open`` returned, and update the sums above."""
        *span, marked = self._pending
        skip = 1 if marked else 0
        self._splice(*span, list(sizes[skip:]), [int(c) for c in counts[skip:]])

    def _splice(self, b0: int, i0: int, b1: int, i1: int, sizes: list[int], counts: list[int]) -> None:
        head, tail = self._blocks[b0], self._blocks[b1]
        merged = (head[0][:i0] + sizes + tail[0][i1 + 1 :], head[1][:i0] + counts + tail[1][i1 + 1 :])
        for b in range(b0, b1 + 1):
            self._blocks[b] = ([], [])
        self._blocks[b0] = merged
        if len(merged[0]) > 4 * LEAVES_PER_BLOCK:
            self._build([s for b in self._blocks for s in b[0]], [c for b in self._blocks for c in b[1]])
            return
        for b in range(b0, b1 + 1):
            k = self._width + b
            self._chars[k], self._tokens[k] = sum(self._blocks[b][0]), sum(self._blocks[b][1])
            while k > 1:
                k //= 2
                self._sum(k)


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``(doc_id, text, edits)`` from a table ``(doc_id, seq, start, stop, insert)``, in order of seq.

    A document without edits has an empty list; edits of unknown documents are dropped.
    """
    lists = edits.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "insert"))),
            lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["insert"].alias("insert")),
        ).alias("edits")
    )
    return docs.select("doc_id", "text").join(lists, "doc_id", "left")


def edited_counts(docs: DataFrame, tokenizer: str, special: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, n_edits, n_tokens_edited, chars_encoded)`` for every row.

    ``docs`` has ``doc_id``, ``text`` and ``edits``, an array of (start, stop, insert) applied
    one after the other in character positions of the text as it then stands. Positions beyond
    the text are cut to it, a stop before its start inserts only, a null position is 0 and a
    null insert empty. Null texts count as empty, null edit lists as none, and so do null edits in a list. ``chars_encoded`` is
    what the edits read again. Repeated rows are counted each. ``special`` is that of the encoder.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special)
        for batch in batches:
            ids, texts, edits = batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("edits").to_pylist()
            edits = [[e for e in todo or [] if e is not None] for todo in edits]
            for part in S.slices_of(texts):
                trees = [CountTree(t, encode, leaves) for t, leaves in zip(texts[part], encode.word_counts(texts[part]))]
                before = [tree.total for tree in trees]
                n = [len(todo) for todo in edits[part]]
                for k in range(max(n)):  # the k-th edits of all documents are encoded together
                    now = [(tree, todo[k]) for tree, todo, m in zip(trees, edits[part], n) if m > k]
                    regions = [tree.open(e["start"] or 0, e["stop"] or 0, e["insert"] or "") for tree, e in now]
                    for (tree, _), leaves in zip(now, encode.word_counts(regions)):
                        tree.close(*leaves)
                after, read = [tree.total for tree in trees], [tree.read for tree in trees]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(part.start, part.stop - part.start), "n_tokens": pa.array(before, pa.int64()),
                        "n_edits": pa.array(n, pa.int64()), "n_tokens_edited": pa.array(after, pa.int64()),
                        "chars_encoded": pa.array(read, pa.int64()),
                    }
                )

    schema = f"doc_id {kind}, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, chars_encoded bigint"
    return docs.select("doc_id", "text", "edits").mapInArrow(run, schema)
