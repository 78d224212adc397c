"""Token ids in directly addressable codes, in one global order, written and read as a table.

A segment keeps its ids in levels of one byte. Level k holds byte k of every id that has one;
a bitmap beside it says which of these ids go on in the next level, and a rank directory
counts its ones in steps of 512 bits. Token i is read by following it through the levels:
its place in level k + 1 is the rank of its place in level k. No block is decoded.

Documents lie in ascending doc_id order in range partitions of segments; a table of
partition totals gives every segment its global start. Segments are rows of a Parquet table,
so that Spark's commit protocol keeps retried and speculative tasks from leaving halves.

Segment bytes (little endian): ``DAC1``, uint64 ids, uint32 levels; then for each level
uint64 length n, n bytes, ``ceil(n / 512)`` blocks of 64 bitmap bytes, as many + 1 uint32 ranks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberday.llm import shingles as S
from emberday.llm.tokens import encoder
from emberday.session import shared_folder

MAGIC = b"DAC1"
END_ID = 0
SEGMENT_TOKENS = 1 << 18
_BLOCK_BITS = 512
_ROWS = 512


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned, at most 32 bits) as one segment."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while len(rest):
        more = rest > 255
        bits = np.zeros(-(-len(rest) // _BLOCK_BITS) * _BLOCK_BITS, bool)
        bits[: len(rest)] = more
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, _BLOCK_BITS).sum(axis=1))]).astype("<u4")
        levels.append(
            struct.pack("<Q", len(rest))
            + (rest & 255).astype(np.uint8).tobytes()
            + np.packbits(bits, bitorder="little").tobytes()
            + ranks.tobytes()
        )
        rest = rest[more] >> np.uint32(8)
    return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class Segment:
    """Random access to the ids of one packed segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self._n, count = struct.unpack_from("<QI", data, 4)
        self._levels, at = [], 16
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // _BLOCK_BITS)
            at += 8
            codes = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, blocks * _BLOCK_BITS // 8, at + n)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at + n + len(bitmap))
            at += n + len(bitmap) + 4 * len(ranks)
            self._levels.append((codes, bitmap, ranks))

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, i: int) -> int:
        """Id of token ``i``: one byte, one bit and at most 64 counted bytes for each level."""
        if not 0 <= i < self._n:
            raise IndexError(i)
        value = shift = 0
        for codes, bitmap, ranks in self._levels:
            value |= int(codes[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            shift += 8
            block = i // _BLOCK_BITS
            head = bitmap[block * _BLOCK_BITS // 8 : i >> 3]
            part = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(head).sum()) + part.bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id in order, level by level."""
        out = np.zeros(self._n, np.uint32)
        where = np.arange(self._n)
        for k, (codes, bitmap, _) in enumerate(self._levels):
            out[where] |= codes.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bitmap, count=len(codes), bitorder="little").view(bool)]
        return out


def write_store(
    docs: DataFrame, tokenizer: str, path: str, partitions: int, special: bool = False, known: int | None = None
) -> None:
    """Encode every whole text and write ``(part, seq, offset, doc_ids, counts, segment)`` rows to ``path``.

    ``offset`` counts the ids before a segment within its partition. Each document is followed
    by the id ``END_ID``; null and empty texts are just that. Equal doc_ids are ordered by a
    hash of their texts, then by the texts; a null doc_id comes first. A segment holds whole
    documents, about ``SEGMENT_TOKENS`` tokens, or one longer document. ``special`` and ``known``
    are those of the encoder.
    """
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    kind = dict(docs.dtypes)["doc_id"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, offset = TaskContext.get().partitionId(), 0, 0
        held: list = []
        size = 0
        for doc_ids, counts, ids in _encoded(batches, tokenizer, special, known):
            held.append((doc_ids, counts, ids))
            size += len(ids)
            if size >= SEGMENT_TOKENS:
                yield _segment_row(part, seq, offset, held, id_type)
                held, size, seq, offset = [], 0, seq + 1, offset + size
        if held:
            yield _segment_row(part, seq, offset, held, id_type)

    # the range bounds are sampled from short keys, never from texts
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
        .repartitionByRange(partitions, "doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
    )
    schema = f"part int, seq int, offset bigint, doc_ids array<{kind}>, counts array<bigint>, segment binary"
    ordered.mapInArrow(segments, schema).write.parquet(path)


def _encoded(
    batches: Iterator[pa.RecordBatch], tokenizer: str, special: bool, known: int | None
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, token counts and ids of slices of documents, end ids included."""
    encode = encoder(tokenizer, special, known).encode
    for whole in batches:
        for at in range(0, len(whole), _ROWS):  # few texts at a time become Python strings
            batch = whole.slice(at, _ROWS)
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for piece in S.slices_of(texts, SEGMENT_TOKENS):
                ids, counts = encode(texts[piece])
                ids = np.insert(ids, np.cumsum(counts), END_ID)
                yield doc_ids[piece], counts + 1, ids


def _segment_row(part: int, seq: int, offset: int, held: list, id_type: pa.DataType) -> pa.RecordBatch:
    doc_ids = [d for docs, _, _ in held for d in docs]
    counts = np.concatenate([c for _, c, _ in held])
    ids = np.concatenate([i for _, _, i in held])
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
            "offset": pa.array([offset], pa.int64()),
            "doc_ids": pa.array([doc_ids], pa.list_(id_type)), "counts": pa.array([counts], pa.list_(pa.int64())),
            "segment": pa.array([pack(ids)], pa.binary()),
        }
    )


def placed(store: DataFrame) -> DataFrame:
    """The segments with ``start``, the number of ids before each in the whole store.

    Only the totals of the partitions are summed up, a row for each partition of the write;
    that table is broadcast and the segments stay where they are.
    """
    size = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    totals = store.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    return store.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("offset")).drop("before")


def read_documents(store: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the store."""
    kind = dict(store.dtypes)["doc_ids"].removeprefix("array<")[:-1]
    id_type = to_arrow_type(store.schema["doc_ids"].dataType.elementType)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, counts, start, data in zip(
                *(batch.column(c).to_pylist() for c in ("doc_ids", "counts", "start", "segment"))
            ):
                ids = Segment(data).all().astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, counts)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids, id_type), "start": pa.array(start + ends - counts, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    rows = placed(store).select("doc_ids", "counts", "start", "segment")
    return rows.mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(store: DataFrame, positions: DataFrame) -> DataFrame:
    """``(position, token_id)`` for global positions: each segment answers for its own, by direct access.

    Positions outside the store give no row; a repeated position gives one row each time.
    """
    sizes = placed(store).select(
        "part", "seq", "start",
        (F.col("start") + F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)).alias("stop"),
    )
    cell = F.floor(F.col("position") / SEGMENT_TOKENS)
    spans = sizes.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_TOKENS), F.floor((F.col("stop") - 1) / SEGMENT_TOKENS)))
    )
    wanted = (
        positions.select(F.col("position").cast("bigint").alias("position")).withColumn("cell", cell)
        .join(spans, "cell").where("position >= start and position < stop")
        .groupBy("part", "seq", "start").agg(F.collect_list("position").alias("positions"))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for positions, start, data in zip(*(batch.column(c).to_pylist() for c in ("positions", "start", "segment"))):
                segment = Segment(data)
                yield pa.RecordBatch.from_pydict(
                    {
                        "position": pa.array(positions, pa.int64()),
                        "token_id": pa.array([segment[p - start] for p in positions], pa.int64()),
                    }
                )

    found = store.join(wanted, ["part", "seq"]).select("positions", "start", "segment")
    return found.mapInArrow(look_up, "position bigint, token_id bigint")


def encoded_documents(
    docs: DataFrame, tokenizer: str, partitions: int | None = None, special: bool = False, known: int | None = None
) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and return its documents as read back.

    One row per row of ``docs``; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/emberday/token-store-{spark.sql('select uuid()').first()[0]}"
    write_store(docs, tokenizer, path, partitions, special, known)
    return read_documents(spark.read.parquet(path))
