"""N-gram Jaccard join by grouped prefixes: classes of documents linked by similar shingle sets.

Two documents link when ``100 * |A & B| >= 80 * |A | B|`` over their distinct five-word
shingles (the whole word sequence when there are fewer words). Steps:

1. Count shingles over the whole corpus in a fixed-size table of hash buckets and order
   shingles by (bucket count, hash): any total order keeps a prefix join exact, this one puts
   rare shingles first.
2. Collapse equal sets; collapse sets with the same size and the same prefix into one group.
3. Index groups by prefix shingle. In each bucket every group meets the smallest group;
   pairs that size or position rules out go, the rest is expanded to members and verified
   on the texts.
4. Buckets whose members already are one class are settled. In the others every pair of
   members of different classes is looked at, in blocks of bounded size: a parity bitmap
   bounds the symmetric difference from below, survivors are verified. A first pass over the
   larger buckets takes only the likeliest partner of each member and class, so that a family
   of near copies becomes one class before the exhaustive pass.

Links inside a class need no check once the class is known, so a family of m near copies
costs about m verified pairs, and no bucket is cut or skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.llm import shingles as S
from emberday.llm.components import components
from emberday.llm.names import free_names
from emberday.session import release, written

SKETCH_BITS = 18
_STRIPE = 1 << 12
BLOCK = 2048
SMALL_BUCKET = 16
BROADCAST_NODES = 1_000_000
_SIG_BITS_PER_ITEM = 4
_PERCENT = 80


def required_overlap(n_a, n_b):
    """Smallest intersection size at which two sets of these sizes link (integers or arrays)."""
    return -(-(_PERCENT * (n_a + n_b)) // (100 + _PERCENT))


def prefix_length(n: int) -> int:
    """Items of a set of size n of which a partner must share one."""
    return n - -(-_PERCENT * n // 100) + 1


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").to_pylist()


# ---------------------------------------------------------------- corpus order


def shingle_counts(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Number of (document, shingle) pairs per hash bucket, over all rows of ``docs``.

    Every task adds up its own buckets, stripes of buckets are then summed in parallel; the
    result has ``2 ** bits`` numbers at any input size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts = _texts(batch)
            for part in S.slices_of(texts):
                hashes = np.concatenate([*S.text_sets(texts[part]), np.empty(0, np.uint64)])
                total += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        stripes = [k for k in range(0, 1 << bits, _STRIPE) if total[k : k + _STRIPE].any()]
        yield pa.RecordBatch.from_pydict(
            {
                "stripe": pa.array(stripes, pa.int32()),
                "counts": pa.array([total[k : k + _STRIPE].tobytes() for k in stripes], pa.binary()),
            }
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("stripe").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(blob, np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "stripe": pa.array(list(sums), pa.int32()),
                "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary()),
            }
        )

    schema = "stripe int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("stripe").mapInArrow(add, schema)
    table = np.zeros(1 << bits, np.int64)
    for stripe, counts in rows.toLocalIterator():
        table[stripe : stripe + _STRIPE] = np.frombuffer(bytes(counts), np.int64)
    return table


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Bit k is the parity of the number of items in bucket k; longer for larger sets."""
    bits = 64
    while bits < _SIG_BITS_PER_ITEM * len(hashes):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prefix_table(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, n, key, prefix, bitmap)`` per row; key is equal for equal sets."""
    bits = int(len(counts)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2 ** bits numbers, whatever the input

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            texts, ids = _texts(batch), batch.column("doc_id")
            for part in S.slices_of(texts):
                n, key, prefix, bitmap = [], [], [], []
                for s in S.text_sets(texts[part]):
                    n.append(len(s))
                    place = np.arange(1, len(s) + 1, dtype=np.uint64)
                    key.append(
                        np.array(
                            [np.bitwise_xor.reduce(S.mix(s)) if len(s) else 0, np.sum(S.mix(s ^ place))],
                            dtype=np.uint64,
                        ).tobytes()
                    )
                    rank = np.lexsort((s, order[(s >> np.uint64(64 - bits)).astype(np.int64)]))
                    prefix.append(s[rank[: prefix_length(len(s))]].view(np.int64) if len(s) else [])
                    bitmap.append(parity_bitmap(s))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(part.start, part.stop - part.start),
                        "text_hash": batch.column("text_hash").slice(part.start, part.stop - part.start),
                        "n": pa.array(n, pa.int64()),
                        "key": pa.array(key, pa.binary()),
                        "prefix": pa.array(prefix, pa.list_(pa.int64())),
                        "bitmap": pa.array(bitmap, pa.binary()),
                    }
                )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash bigint, n bigint, key binary, prefix array<bigint>, bitmap binary"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(prefixes, schema)


# ---------------------------------------------------------------- verification


def verified(pairs: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame | None:
    """The pairs ``(a, b)`` of nodes whose whole texts link, by exact intersection of their sets.

    ``wanted`` has the size and bitmap of each node and names the row of ``docs`` it stands
    for. Pairs that the bitmaps rule out go before any text is read. Only texts of nodes that occur
    in a pair are moved: their ids go to the scan as a broadcast up to ``BROADCAST_NODES``
    rows, beyond that both sides are exchanged. None without pairs.
    """
    pairs = written(_possible(pairs, wanted), "ngram-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = written(wanted.select("node", "id", "text_hash").join(ends, "node"), "ngram-needed")
    count = needed.count()
    if not count:
        release(pairs, needed)
        return None
    few = F.broadcast(needed) if count <= BROADCAST_NODES else needed
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    same_row = (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("id"))
    texts = keyed.join(few, same_row).select("node", "text").dropDuplicates(["node"])
    one, other = (
        texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b")
    )
    loaded = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def items(text: str) -> np.ndarray:
            return next(iter(S.text_sets([text])))

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                p, q = items(x.as_py()), items(y.as_py())
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= required_overlap(len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(loaded.mapInArrow(check, "a bigint, b bigint"), "ngram-links")
    release(pairs, needed)
    return links


def _possible(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow as small a symmetric difference as a link has."""
    one, other = (
        wanted.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bits_{k}"))
        for k in ("a", "b")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))):
                size = min(len(x), len(y)) // 8
                apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
                keep.append(apart <= n + m - 2 * required_overlap(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(
        check, "a bigint, b bigint"
    )


# ---------------------------------------------------------------- candidates


def _pivot_pairs(postings: DataFrame) -> DataFrame:
    """Every group of a bucket with its group of the smallest doc_id, after size and position filters."""
    pivot = postings.groupBy("token").agg(
        F.min(F.struct("first", "grp", "n", "pos")).alias("p"), F.count("*").alias("m")
    )
    both = postings.join(pivot.where("m > 1"), "token").where(F.col("grp") != F.col("p.grp"))
    small, large = F.least("n", "p.n"), F.greatest("n", "p.n")
    reachable = F.least("pos", "p.pos") + 1 + F.least(F.col("n") - F.col("pos"), F.col("p.n") - F.col("p.pos")) - 1
    needed = F.ceil(F.lit(_PERCENT) * (F.col("n") + F.col("p.n")) / F.lit(100 + _PERCENT) - F.lit(1e-9))
    return (
        both.where((small * 100 >= large * _PERCENT) & (reachable >= needed))
        .select(F.col("p.grp").alias("g"), F.col("grp").alias("h"))
        .distinct()
    )


def _open_rows(memberships: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of buckets that still hold members of several classes, with class and bucket size.

    Of buckets with the same members one stays: they would give the same pairs.
    """
    labelled = memberships.join(classes.select(F.col("id").alias("node"), "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    buckets = (
        labelled.groupBy("token")
        .agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"),
            F.bit_xor(F.xxhash64("node")).alias("members"),
        )
        .where("lo <> hi")
    )
    one_each = buckets.groupBy("members", "m").agg(F.min("token").alias("token")).select("token", "m")
    return labelled.join(one_each, "token")


def _small_bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different classes and fitting sizes within buckets of at most ``SMALL_BUCKET``."""
    small = rows.where(F.col("m") <= SMALL_BUCKET)
    a, b = (small.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "component")]) for k in ("a", "b"))
    fits = (
        (F.col("node_a") < F.col("node_b"))
        & (F.col("component_a") != F.col("component_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * _PERCENT)
    )
    return a.join(b, (a["token"] == b["token"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _block_pairs(rows: DataFrame, bitmaps: DataFrame, best_only: bool) -> DataFrame:
    """Pairs of different classes within larger buckets that size and bitmap do not rule out.

    A bucket of m members is dealt into blocks of about ``BLOCK``; every two blocks meet in
    one task, so no task holds a whole bucket. ``best_only`` keeps, for each member and each
    other class of the two blocks, the pair with the smallest bound.
    """
    block = F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int")
    dealt = (
        rows.where(F.col("m") > SMALL_BUCKET)
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "token", "node", "n", "component", "block",
            F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        )
        .join(bitmaps, "node")
        .repartition("token", "lo", "hi")
        .sortWithinPartitions("token", "lo", "hi")
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            found = _cell_pairs(cell, best_only)
            if found is not None:
                yield found

    return dealt.mapInArrow(pairs, "a bigint, b bigint")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (token, lo, hi), which lie together but may cross batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = np.stack([table.column(k).to_numpy() for k in ("token", "lo", "hi")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], cuts):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    bits = np.frombuffer(bitmap, np.uint64)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _cell_pairs(cell: pa.Table, best_only: bool) -> pa.RecordBatch | None:
    component = cell.column("component").to_numpy()
    if (component == component[0]).all():
        return None
    ids, n, block = (cell.column(k).to_numpy() for k in ("node", "n", "block"))
    lo, hi = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
    bitmaps = cell.column("bitmap").to_pylist()
    length = np.array([len(b) for b in bitmaps])
    folded: dict[int, np.ndarray] = {}  # by length: the bitmaps of at least that length, folded to it
    left, right = [], []
    for i in range(len(ids)):
        if lo == hi:
            js = np.arange(i + 1, len(ids))
        elif block[i] == lo:
            js = np.flatnonzero(block == hi)
        else:
            continue
        js = js[component[js] != component[i]]
        small, large = np.minimum(n[js], n[i]), np.maximum(n[js], n[i])
        js = js[small * 100 >= large * _PERCENT]
        if not len(js):
            continue
        size = int(min(length[i], length[js].min())) // 8
        if size not in folded:
            none = np.zeros(size, np.uint64)
            folded[size] = np.stack([_folded(b, size) if len(b) >= 8 * size else none for b in bitmaps])
        apart = np.bitwise_count(folded[size][js] ^ folded[size][i]).sum(axis=1)
        allowed = n[js] + n[i] - 2 * required_overlap(n[js], n[i])
        keep = apart <= allowed
        js, apart = js[keep], apart[keep]
        if best_only and len(js):
            rank = np.lexsort((ids[js], apart, component[js]))
            first = np.append(True, component[js][rank][1:] != component[js][rank][:-1])
            js = js[rank[first]]
        left.append(np.full(len(js), ids[i]))
        right.append(ids[js])
    if not left:
        return None
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


# ---------------------------------------------------------------- operator


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and string ``text``; other columns are not read. Null or empty
    texts and texts of white space have no shingles and stay alone. Rows with equal texts
    link. Rows repeating a doc_id are judged by their own texts and returned once each. A row
    with a null doc_id links like any other, but never names a class: a class without any
    doc_id has a null component_id. No rows give no rows.
    """
    return _row_classes(docs).select("doc_id", "n_shingles", "component_id")


def _row_classes(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    full = written(
        prefix_table(docs, shingle_counts(docs)).withColumn("node", F.xxhash64("key", "n")), "ngram-prefixes"
    )
    table = written(full.select("doc_id", "text_hash", "n", "node"), "ngram-nodes")
    # equal sets become one node, read from the text of its smallest row
    sets = (
        full.where("n > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first"),
            F.min(F.struct("doc_id", "text_hash")).alias("row"),
            *[F.min(c).alias(c) for c in ("n", "prefix", "bitmap")],
        )
        .withColumn("prefix_key", F.xxhash64("n", "prefix"))
    )
    groups = sets.groupBy("prefix_key").agg(F.min(F.struct("first", "node")).alias("g"))
    own = F.col("node") == F.col("grp")
    members = written(
        sets.join(groups.select("prefix_key", F.col("g.node").alias("grp")), "prefix_key").select(
            "node", "first", "row", "n", "grp", "bitmap", F.when(own, F.col("prefix")).alias("prefix")
        ),
        "ngram-members",
    )
    release(full)
    groups = members.where(own).select("grp", "first", "n", "prefix")
    # one exchange of narrow rows finds the tokens of several groups; most rows end here
    mine = W.partitionBy("token").orderBy("grp")
    several = F.lag("grp").over(mine).isNotNull() | F.lead("grp").over(mine).isNotNull()
    shared = groups.select("grp", F.posexplode("prefix").alias("pos", "token"))
    shared = shared.withColumn("several", several).where("several").select("grp", "pos", "token")
    postings = written(shared.join(groups.select("grp", "first", "n"), "grp"), "ngram-postings")

    wanted = members.select(
        "node", "n", "bitmap", F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("text_hash")
    )

    found = _pivot_pairs(postings).join(
        members.select(F.col("grp").alias("h"), F.col("node").alias("m")), "h"
    ).select(F.least("g", "m").alias("a"), F.greatest("g", "m").alias("b"))
    inside = members.where("grp <> node").select(F.least("grp", "node").alias("a"), F.greatest("grp", "node").alias("b"))
    classes = _joined_classes(None, verified(found.unionByName(inside).distinct(), wanted, docs), members)

    # members of one group share their whole prefix: the group is one more bucket
    crowded = members.where("grp <> node").select("grp").distinct()
    buckets = postings.select("token", "grp").unionByName(crowded.select(F.col("grp").alias("token"), "grp"))
    memberships = members.select("node", "grp", "n").join(buckets, "grp").select("node", "n", "token")
    bitmaps = members.select("node", "bitmap")
    for best_only in (True, False):
        rows = written(_open_rows(memberships, classes), "ngram-open")
        found = _block_pairs(rows, bitmaps, best_only)
        if not best_only:
            found = found.unionByName(_small_bucket_pairs(rows))
        more = verified(found.distinct(), wanted, docs)
        release(rows)
        if more is not None:
            classes = _joined_classes(classes, more, members)
    release(postings)

    of_node = (
        members.join(classes.select(F.col("id").alias("node"), "component"), "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), "first")
    )
    named = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    result = written(
        table.select("doc_id", "text_hash", "n", "node")
        .join(of_node.join(named, "component").select("node", "component_id"), "node", "left")
        .select(
            "doc_id",
            "text_hash",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ),
        "ngram-rows",
    )
    release(table, members, classes)
    return result


def _joined_classes(known: DataFrame | None, links: DataFrame | None, members: DataFrame) -> DataFrame:
    """Classes by new links and the classes known before, which are links to their smallest node."""
    if links is None:
        return written(members.select(F.col("node").alias("id"), F.col("node").alias("component")).limit(0), "ngram-classes")
    all_links = links
    if known is not None:
        all_links = links.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    classes = components(all_links)
    release(links, *([known] if known is not None else []))
    return classes


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near duplicates, the smallest doc_id, all columns.

    Of rows with that doc_id and several texts of the class all stay, of equal rows one stays.
    Rows without shingles are no duplicates of anything and all stay; so do rows of a class
    without any doc_id.
    """
    classes = _row_classes(docs)
    ids, hashes = free_names(docs, "id", "hash")

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias(ids), F.col("text_hash").alias(hashes))

    drop = named(classes.where("n_shingles > 0 and (doc_id is null or doc_id <> component_id) and component_id is not null"))
    same = docs["doc_id"].eqNullSafe(F.col(ids)) & (F.xxhash64(docs["text"]) == F.col(hashes))
    kept = docs.join(drop.distinct(), same, "left_anti")
    repeated = classes.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id", "text_hash").count()
    repeated = named(repeated.where("count > 1"))
    if not repeated.take(1):
        return kept
    return kept.join(repeated, same, "left_anti").unionByName(
        kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    )
