"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension sampling.

Vectors are rotated by a random orthogonal matrix, so that any first d coordinates are a
random projection. Candidates of a probed list are read in column blocks. After each block
the distance so far, scaled to all dimensions, is tested against the k-th best distance known:
beyond ``(1 + EPSILON / sqrt(d))`` times that distance the candidate is given up, at a small
chance of error. Survivors get the exact distance on the original vectors.

A query first searches its nearest lists, where the k-th best distance falls as it goes. That
distance then goes with the query to all other lists it probes, so these give up candidates
from the first one on, whatever task they are in.

Equal vectors are one candidate with the few smallest ids that can ever be asked for. Large
lists are cut into chunks of candidates and of queries, so a task holds a bounded number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.session import release, written

TOP = 10
# The lists' centres are fitted on so many vectors, the first by a hash; every vector is indexed.
TRAIN_ROWS = 20_000
MAX_LISTS = 4096
# Share of the lists a query probes. Vectors of high intrinsic dimension spread their neighbours
# over many lists: a fifth of the lists finds 0.7 of them on the test vectors, 0.6 finds 0.96.
PROBE_SHARE, MIN_PROBES = 0.6, 12
EPSILON = 1.5
BLOCK_DIMS = 8
CHUNK_CANDIDATES = 4096
CHUNK_QUERIES = 1024
# Lists searched before the others, and candidates scanned before the first test; each batch
# is twice the one before.
FIRST_LISTS = 2
_BATCH = 32
# A bound that went through a square root keeps its ties.
_TIES = 1 + 1e-12


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)``: ids not null, components all finite, not all zero, of the commonest length."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v")).where(
        "vec_id is not null and size(v) > 0"
    )
    limit = F.lit(math.inf)
    rows = rows.where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes.d if sizes else 0))


def _distinct(rows: DataFrame) -> DataFrame:
    """``(v, ids)``: each vector once, with the ``TOP + 1`` smallest of its ids in order."""
    first = W.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= TOP + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def fit_lists(sample: np.ndarray, count: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres of a bounded sample; an empty list takes a random vector."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest_lists(sample, centres, 1)[:, 0]
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        empty = size == 0
        centres = total / np.maximum(size, 1)[:, None]
        centres[empty] = sample[rng.choice(len(sample), empty.sum())]
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centres of each row, nearest first."""
    out = []
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        far = (centres**2).sum(axis=1) - 2 * part @ centres.T
        if count < len(centres):
            some = np.argpartition(far, count - 1, axis=1)[:, :count]
        else:
            some = np.broadcast_to(np.arange(len(centres)), far.shape)
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, count), np.int64)


def scan(
    queries: np.ndarray, candidates: np.ndarray, rotation: np.ndarray, keep, bounds: np.ndarray | None = None
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the positions and exact distances of its best candidates found, and how many were given up.

    ``keep`` is one number or one for each query; ``bounds`` are distances beyond which a query
    needs nothing, infinite where nothing is known.
    """
    dims = candidates.shape[1]
    edges = [*range(0, dims, BLOCK_DIMS), dims]
    rotated = candidates @ rotation
    blocks = [np.ascontiguousarray(rotated[:, a:b]) for a, b in zip(edges, edges[1:])]
    slack = [(1 + EPSILON / math.sqrt(b)) ** 2 * b / dims for b in edges[1:]]
    bounds = np.full(len(queries), math.inf) if bounds is None else np.asarray(bounds, np.float64) ** 2 * _TIES
    out, abandoned = [], 0
    for query, turned, need, bound in zip(queries, queries @ rotation, np.broadcast_to(keep, len(queries)).tolist(), bounds.tolist()):
        where, best = np.empty(0, np.int64), np.empty(0)
        at, size = 0, _BATCH if bound == math.inf else len(candidates)
        while at < len(candidates):
            alive = np.arange(at, min(at + size, len(candidates)))
            part = np.zeros(len(alive))
            for block, a, b, allow in zip(blocks, edges, edges[1:], slack):
                part += ((block[alive] - turned[a:b]) ** 2).sum(axis=1)
                if b < dims and bound < math.inf:
                    stay = part <= allow * bound
                    abandoned += len(stay) - int(stay.sum())
                    alive, part = alive[stay], part[stay]
            exact = ((candidates[alive] - query) ** 2).sum(axis=1)
            near = exact <= bound
            where, best = np.concatenate([where, alive[near]]), np.concatenate([best, exact[near]])
            if len(best) > need:
                # equal distances all stay: their ids decide later
                bound = min(bound, np.partition(best, need - 1)[need - 1])
                where, best = where[best <= bound], best[best <= bound]
            at, size = at + size, 2 * size
        out.append((where, np.sqrt(best)))
    return out, abandoned


def nearest(vectors: DataFrame, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest vectors of each query, smallest distance first.

    Queries are the usable rows whose vec_id is divisible by ``every``, candidates all usable
    rows with another vec_id, ``TOP`` for each query or all if there are fewer. Null, zero,
    non-finite vectors, such of an uncommon length and null ids take no part. Equal distances
    go to the smaller vec_id; a repeated (vec_id, vector) counts once. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).distinct()
    table = written(_distinct(rows), "ann-vectors")
    n = table.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    train = _training_rows(table, n)
    centres = fit_lists(train, min(MAX_LISTS, math.ceil(math.sqrt(n))))
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(train.shape[1],) * 2))[0]
    probes = min(len(centres), max(MIN_PROBES, math.ceil(PROBE_SHARE * len(centres))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest_lists(_matrix(batch.column("v")), centres, 1)[:, 0]
            yield pa.RecordBatch.from_pydict(
                {"list": pa.array(near, pa.int32()), "v": batch.column("v"), "ids": batch.column("ids")}
            )

    kind = dict(table.dtypes)["v"]
    listed = written(table.mapInArrow(assign, f"list int, v {kind}, ids array<bigint>"), "ann-lists")
    release(table)
    sizes = {r.list: (r.m, r.few) for r in listed.groupBy("list").agg(F.count("*").alias("m"), F.sum(F.size("ids")).alias("few")).collect()}
    held = np.array([sizes.get(k, (0, 0))[1] for k in range(len(centres))])

    # rows of its own id are no candidates of a query: it keeps so many more
    wanted = rows.where(F.col("vec_id") % every == 0).withColumn("q", F.xxhash64("v"))
    own = wanted.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = wanted.join(own, "vec_id").groupBy("q").agg(F.min("v").alias("v"), (F.max("own") + TOP).cast("int").alias("keep"))
    asked = written(asked, "ann-asked")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, keep = _matrix(batch.column("v")), batch.column("keep").to_numpy()
            near = nearest_lists(x, centres, probes)
            thin = np.flatnonzero(held[near].sum(axis=1) < keep)
            picks = list(near)
            for i in thin:  # lists with too few rows: all lists, nearest first, till there are enough
                order = nearest_lists(x[i : i + 1], centres, len(centres))[0]
                picks[i] = order[: np.searchsorted(np.cumsum(held[order]), keep[i]) + 1]
            count = np.array([len(p) for p in picks])
            at = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_pydict(
                {
                    "list": pa.array(np.concatenate(picks), pa.int32()),
                    "nth": pa.array(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), pa.int32()),
                    **{c: batch.column(c).take(at) for c in ("q", "v", "keep")},
                }
            )

    probing = written(asked.mapInArrow(probe, f"list int, nth int, q bigint, v {kind}, keep int"), "ann-probes")
    lists = {k: m for k, (m, _) in sizes.items()}
    first = probing.where(F.col("nth") < FIRST_LISTS).withColumn("bound", F.lit(math.inf))
    early = written(_searched(listed, first, lists, rotation), "ann-first")
    # the k-th smallest distance of a query so far; its first lists give a bounded number of rows
    far = F.get(F.array_sort(F.collect_list("score")), F.max("keep") - 1)
    bounds = early.join(asked.select("q", "keep"), "q").groupBy("q").agg(far.alias("bound"))
    later = probing.where(F.col("nth") >= FIRST_LISTS).join(bounds, "q", "left")
    later = written(later.withColumn("bound", F.coalesce("bound", F.lit(math.inf))), "ann-later")
    found = early.unionByName(_searched(listed, later, lists, rotation))

    best = W.partitionBy("q").orderBy("score", "vec_id")
    kept = asked.select("q", "keep")
    top = (
        found.withColumn("k", F.row_number().over(best)).join(kept, "q").where(F.col("k") <= F.col("keep"))
        .groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    )
    mine = wanted.select(F.col("vec_id").alias("query_id"), "q").join(top, "q")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, TOP)
    result = mine.select("query_id", F.posexplode(others).alias("rank", "f")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score")
    )
    answer = written(result, "ann-answer")
    release(listed, asked, probing, early, later)
    return answer


def _training_rows(table: DataFrame, n: int) -> np.ndarray:
    """Some ``TRAIN_ROWS`` of the ``n`` vectors, the first by a hash.

    A share by that hash goes first, so that tasks do not each send as many as all need.
    """
    part = F.pmod(F.xxhash64("v"), F.lit(1_000_000))
    some = table.where(part < math.ceil(2_000_000 * TRAIN_ROWS / n))
    rows = some.orderBy(part, F.xxhash64("v"), "v").limit(TRAIN_ROWS).select("v").collect()
    if not rows:
        rows = table.limit(TRAIN_ROWS).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.float64)


def _searched(listed: DataFrame, probing: DataFrame, lists: dict[int, int], rotation: np.ndarray) -> DataFrame:
    """``(q, vec_id, score)``: the best of every probed list for each query, within its bound."""
    spark = listed.sparkSession
    asks = {r.list: r["count"] for r in probing.groupBy("list").count().collect()}
    chunks = [(k, -(-m // CHUNK_CANDIDATES), -(-asks[k] // CHUNK_QUERIES)) for k, m in lists.items() if k in asks]
    chunk_table = F.broadcast(spark.createDataFrame(chunks, "list int, c_chunks int, q_chunks int"))  # at most MAX_LISTS rows
    left = (
        listed.join(chunk_table, "list")
        .withColumn("c", F.pmod(F.xxhash64("v"), F.col("c_chunks")).cast("int"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("q_chunks") - 1)))
        .select("list", "c", "d", "v", "ids")
    )
    right = (
        probing.join(chunk_table, "list")
        .withColumn("d", F.pmod(F.col("q"), F.col("q_chunks")).cast("int"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("c_chunks") - 1)))
        .select("list", "c", "d", "q", "v", "keep", "bound")
    )

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        q, vec_id, score = [], [], []
        if candidates.num_rows and queries.num_rows:
            ids, keep = candidates.column("ids").to_pylist(), queries.column("keep").to_numpy()
            bounds = queries.column("bound").to_numpy()
            found, _ = scan(_matrix(queries.column("v")), _matrix(candidates.column("v")), rotation, keep, bounds)
            for key, need, (where, far) in zip(queries.column("q").to_pylist(), keep.tolist(), found):
                pairs = sorted((d, i) for w, d in zip(where, far) for i in ids[w])[:need]
                q += [key] * len(pairs)
                vec_id += [i for _, i in pairs]
                score += [float(d) for d, _ in pairs]
        return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ["list", "c", "d"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "q bigint, vec_id bigint, score double")


def _matrix(column) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)
