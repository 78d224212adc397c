"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Words and word beginnings that mark toxic texts are induced from a bounded sample of
   labelled rows, near copies counted once; a short fixed lexicon joins them.
2. Voters are lexicons and patterns over these hits. The votes of all documents are counted
   by pattern, at most ``2 ** VOTERS`` numbers at any input size.
3. The label model is a mixture of a toxic and a clean class, fitted by expectation
   maximisation over the vote patterns; labelled rows keep their class. It estimates how often
   each voter fires in either class. Voters whose votes stay correlated within the classes
   are then modelled together by a joint table, and the fit is repeated.
4. A logistic classifier over the hits is trained on the posterior labels of a bounded sample
   of documents and scores every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberday.llm import shingles as S
from emberday.session import written

THRESHOLD = 0.7
# Bounds: labelled rows per class to induce from, features kept of each kind, documents to train on.
ROWS_PER_CLASS = 2500
FEATURES_PER_KIND = 120
TRAIN_ROWS = 8000
VOTERS = 12
_PREFIXES = (4, 5, 6)
_MIN_ODDS = 20.0
_JOINT = 4
_CORRELATED = 0.3
# Common English insults.
INSULTS = (
    "bastard", "clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "lunatic",
    "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
)


def _word_values(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: word hashes, their first eight bytes (A-Z lower-cased) and lengths."""
    buffer, begins = S.joined(texts)
    starts, hashes = S.words(buffer, S.NOT_ALPHANUMERIC)
    padded = np.append(S._LOWER[buffer], np.zeros(8, np.uint8))
    inside = np.append(~S.NOT_ALPHANUMERIC[buffer], np.zeros(8, bool))
    head, length, going = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    for k in range(8):
        going &= inside[starts + k]
        head |= np.where(going, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        length += going
    cuts = np.searchsorted(starts, begins)
    for a, b in zip(cuts, cuts[1:]):
        yield hashes[a:b], head[a:b], length[a:b]


def _kinds(hashes: np.ndarray, head: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Feature values by kind: 0 for words, p for beginnings of p bytes."""
    yield 0, hashes
    for p in _PREFIXES:
        yield p, head[length >= p] & np.uint64((1 << 8 * p) - 1)


def _signature(hashes: np.ndarray) -> int:
    """The smallest shingle hash: near copies mostly share it."""
    runs = S.shingle_hashes(hashes)
    return int(runs.min().view(np.int64)) if len(runs) else 0


@dataclass(frozen=True)
class Lexicon:
    """Feature values by kind, sorted, with the feature's number; strongest features first in number."""

    values: dict[int, np.ndarray] = field(default_factory=dict)
    numbers: dict[int, np.ndarray] = field(default_factory=dict)
    size: int = 0
    group: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def hits(self, hashes: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        for kind, values in _kinds(hashes, head, length):
            mine = self.values.get(kind)
            if mine is None or not len(values):
                continue
            at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
            found = at[mine[at] == values]
            np.add.at(out, self.numbers[kind][found], 1)
        return out


def build_lexicon(induced: list[tuple[int, int, float]]) -> Lexicon:
    """``induced`` are (kind, value, strength). Group 0 is the fixed list, 1-4 words, 5-8 beginnings."""
    fixed = [int(next(_word_values([w]))[0][0]) for w in INSULTS]
    rows = [(0, v, 0) for v in fixed]
    for kinds, first in (((0,), 1), (_PREFIXES, 5)):
        mine = sorted((r for r in induced if r[0] in kinds and (r[0] or r[1] not in fixed)), key=lambda r: (-r[2], r[1]))
        rows += [(kind, value, first + 4 * k // len(mine)) for k, (kind, value, _) in enumerate(mine)]
    values, numbers = {}, {}
    for kind in {r[0] for r in rows}:
        own = sorted((r[1], k) for k, r in enumerate(rows) if r[0] == kind)
        values[kind] = np.array([v for v, _ in own], np.uint64)
        numbers[kind] = np.array([k for _, k in own])
    return Lexicon(values, numbers, len(rows), np.array([r[2] for r in rows]))


def votes(hits: np.ndarray, n_words: int, group: np.ndarray) -> int:
    """The voters that fire, as bits."""
    by_group = np.bincount(group, weights=hits, minlength=9)
    total = hits.sum()
    fired = [
        by_group[0] >= 1, by_group[0] >= 2, *(by_group[1:9] >= 1), (hits > 0).sum() >= 3, total >= 3 and 250 * total >= n_words,
    ]
    return sum(1 << k for k, f in enumerate(fired) if f)


# ---------------------------------------------------------------- label model


def label_model(patterns: np.ndarray, unknown: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """P(toxic) of each vote pattern; the arrays count unlabelled, clean and toxic rows with it."""
    bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
    # voters that always fire together must not outvote the others, so joined ones count once
    posterior = np.clip(bits.mean(axis=1) * 2, 0.02, 0.98)
    cliques = _cliques(bits, posterior, unknown, clean, toxic)
    posterior = np.clip(np.mean([bits[:, c].any(axis=1) for c in cliques], axis=0) * 2, 0.02, 0.98)
    for _ in range(3):
        posterior = _fit_mixture(bits, cliques, posterior, unknown, clean, toxic)
        cliques = _cliques(bits, posterior, unknown, clean, toxic)
    return posterior


def _fit_mixture(bits, cliques, posterior, unknown, clean, toxic) -> np.ndarray:
    states = [sum(bits[:, v] << i for i, v in enumerate(c)) for c in cliques]
    for _ in range(60):
        mass = np.stack([unknown * (1 - posterior) + clean, unknown * posterior + toxic])
        log = np.log(mass.sum(axis=1) + 1)[:, None] + np.zeros_like(mass)
        for c, state in zip(cliques, states):
            for y in (0, 1):
                table = np.bincount(state, weights=mass[y], minlength=1 << len(c)) + 0.5 / (1 << len(c))
                log[y] += np.log(table / table.sum())[state]
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        # a pattern without any vote tells nothing toxic
        after[~bits.any(axis=1)] = np.minimum(after[~bits.any(axis=1)], 0.05)
        if np.abs(after - posterior).max() < 1e-6:
            return after
        posterior = after
    return posterior


def _cliques(bits, posterior, unknown, clean, toxic) -> list[list[int]]:
    """Voters joined while their votes stay correlated within the classes, strongest pairs first."""
    strength = np.zeros((VOTERS, VOTERS))
    for mass in (unknown * (1 - posterior) + clean, unknown * posterior + toxic):
        total = mass.sum()
        if total < 1:
            continue
        centred = bits - (mass @ bits) / total
        covariance = (centred * mass[:, None]).T @ centred / total
        deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        strength = np.maximum(strength, np.abs(covariance / np.outer(deviation, deviation)))
    of = {v: [v] for v in range(VOTERS)}
    for a, b in sorted(zip(*np.triu_indices(VOTERS, 1)), key=lambda p: -strength[p]):
        if strength[a, b] >= _CORRELATED and of[a] is not of[b] and len(of[a]) + len(of[b]) <= _JOINT:
            joined = of[a] + of[b]
            for v in joined:
                of[v] = joined
    return list({id(c): c for c in of.values()}.values())


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic weights, intercept last, for soft targets."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.02)
    ridge[-1] = 1e-4
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge * w
        hessian = (x.T * (weight * p * (1 - p))) @ x + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


# ---------------------------------------------------------------- on documents


def _induce(docs: DataFrame, labels: DataFrame) -> list[tuple[int, int, float]]:
    """The strongest words and beginnings of the labelled sample, at most two times ``FEATURES_PER_KIND``."""
    parts = [
        labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_PER_CLASS) for y in (0, 1)
    ]
    sample = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value, sign = [], [], []
            for words in _word_values(batch.column("text").to_pylist()):
                found = [(k, np.unique(v)) for k, v in _kinds(*words)]
                kind.append(np.repeat([k for k, _ in found], [len(v) for _, v in found]))
                value.append(np.concatenate([v for _, v in found]).view(np.int64))
                sign.append(_signature(words[0]))
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": batch.column("toxic").cast(pa.int32()), "signature": pa.array(sign, pa.int64()),
                    "kind": pa.array(kind, pa.list_(pa.int32())), "value": pa.array(value, pa.list_(pa.int64())),
                }
            )

    one_each = written(
        sample.select("toxic", "text").mapInArrow(read, "toxic int, signature bigint, kind array<int>, value array<bigint>")
        .dropDuplicates(["toxic", "signature"]),
        "toxicity-sample",
    )
    sizes = {r.toxic: r["count"] for r in one_each.groupBy("toxic").count().collect()}
    if not sizes.get(1):
        return []
    clean, toxic = sizes.get(0, 0), sizes[1]
    pairs = one_each.select("toxic", F.explode(F.arrays_zip("kind", "value")).alias("f"))
    counts = pairs.groupBy(F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("c") + 0.5))
    strong = counts.where(F.col("t") >= max(4, 0.005 * toxic)).withColumn("odds", odds).where(F.col("odds") >= float(np.log(_MIN_ODDS)))
    strong = strong.withColumn("strength", F.col("odds") * F.col("t"))
    rows = [
        r
        for of_kind in (F.col("kind") == 0, F.col("kind") > 0)
        for r in strong.where(of_kind).orderBy(F.desc("strength"), "kind", "value").limit(FEATURES_PER_KIND).collect()
    ]
    return [(r.kind, r.value & 0xFFFFFFFFFFFFFFFF, r.strength) for r in rows]


def _hit_table(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, n_words, feature, count, mask)``: the features found in every row and its votes."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for part in S.slices_of(texts):
                n, feature, count, mask = [], [], [], []
                for words in _word_values(texts[part]):
                    hits = lex.hits(*words)
                    some = np.flatnonzero(hits)
                    n.append(len(words[0]))
                    feature.append(some.astype(np.int32))
                    count.append(hits[some])
                    mask.append(votes(hits, len(words[0]), lex.group))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(part.start, part.stop - part.start), "n_words": pa.array(n, pa.int64()),
                        "feature": pa.array(feature, pa.list_(pa.int32())), "count": pa.array(count, pa.list_(pa.int64())),
                        "mask": pa.array(mask, pa.int32()),
                    }
                )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, feature array<int>, count array<bigint>, mask int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _design(feature: list, count: list, n_words: list, size: int) -> np.ndarray:
    """Rows of the classifier: up to three hits of each feature, all hits, and their share of the words."""
    x = np.zeros((len(feature), size + 2))
    for i, (f, c, n) in enumerate(zip(feature, count, n_words)):
        if len(f):
            x[i, f] = np.minimum(c, 3) / 3
            x[i, size] = np.log1p(np.sum(c))
            x[i, size + 1] = np.log1p(1000 * np.sum(c) / n)
    return x


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learns from rows of ``labels`` whose crc32 of the doc_id as text leaves another remainder
    than ``held``; the text is the only input of a score. Null and empty texts have no hits and
    get the score of a text without any. Labels other than 0 and 1, or with a null id, are not
    used. Without labels only the fixed lexicon votes. A null doc_id is never held out.
    Repeated rows are scored each. An empty table gives no rows.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % folds
    known = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(remainder != held)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lexicon = build_lexicon(_induce(docs, known.join(docs.select("doc_id"), "doc_id", "left_semi")))
    table = written(_hit_table(docs, lexicon), "toxicity-hits")
    marked = table.select("doc_id", "mask").join(known, "doc_id", "left")
    counts: dict[int, list[int]] = {}
    for r in marked.groupBy("mask", "toxic").count().collect():  # at most 3 * 2 ** VOTERS rows
        counts.setdefault(r.mask, [0, 0, 0])[{None: 0, 0: 1, 1: 2}[r.toxic]] = r["count"]
    patterns = np.array(sorted(counts), dtype=np.int64)
    tally = np.array([counts[m] for m in sorted(counts)], dtype=float).reshape(-1, 3)
    posterior = dict(zip(patterns.tolist(), label_model(patterns, *tally.T).tolist())) if len(patterns) else {}
    weights = _train(table, posterior, lexicon.size)
    kind = dict(table.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _design(*(batch.column(c).to_pylist() for c in ("feature", "count", "n_words")), lexicon.size)
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score)})

    return table.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(remainder == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def _train(table: DataFrame, posterior: dict[int, float], size: int) -> np.ndarray:
    """Weights from at most ``TRAIN_ROWS`` documents: half of them likelier toxic, half not."""
    likely = [m for m, p in posterior.items() if p >= 0.5]
    side = F.col("mask").isin(likely) if likely else F.lit(False)
    sizes = {r.toxic: r["count"] for r in table.groupBy(side.alias("toxic")).count().collect()}
    x, target = [np.zeros((1, size + 2))], [np.array([posterior.get(0, 0.02)])]
    for toxic in (True, False):
        rows = table.where(F.col("mask").isin(likely) == toxic) if likely else table.where("not true" if toxic else "true")
        picked = _first_by_hash(rows, sizes.get(toxic, 0), TRAIN_ROWS // 2)
        x.append(_design([r.feature for r in picked], [r["count"] for r in picked], [r.n_words for r in picked], size))
        target.append(np.array([posterior[r.mask] for r in picked]))
    y = np.concatenate(target)
    heavy = (y >= 0.5).sum()
    weight = np.where(y >= 0.5, 0.5 / max(1, heavy), 0.5 / max(1, len(y) - heavy)) * len(y)
    return fit_linear(np.concatenate(x), y, weight)


def _first_by_hash(rows: DataFrame, n: int, most: int) -> list:
    """``most`` of ``n`` rows, the first by a hash of the id.

    A share by that hash goes first: tasks do not each send as many rows as all need.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    some = rows.where(part < math.ceil(2_000_000 * most / n)) if n > 4 * most else rows
    return some.orderBy(part, F.xxhash64("doc_id"), "doc_id").limit(most).collect()
