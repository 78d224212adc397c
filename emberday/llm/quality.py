"""Quality classifier: a Bradley-Terry score learned from preference pairs, cut at a score quantile.

A labelled good document is preferred to a labelled bad one. Under the Bradley-Terry model the
preference has probability ``sigmoid(w . (x_good - x_bad))``, so the weights come from a
logistic loss on feature differences, without an intercept. The threshold is a quantile of
the scores of the labelled rows; scores are shifted so that it sits at ``THRESHOLD``.

Features are properties of the whole text: repetition, letter case, symbols, lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberday.llm import shingles as S
from emberday.operators.prefix import running_totals
from emberday.session import release, written

THRESHOLD = 0.7
# Labelled rows of a class in a block, and pairs drawn from a block.
ROWS_PER_CLASS = 4000
PAIRS = 60_000
_RIDGE = 1e-3
_QUANTILES = 512

FEATURES = (
    "length", "distinct_words", "repeats_next", "repeated_shingles", "upper", "exclamations",
    "symbols", "bars", "digits", "stops", "commas", "word_length", "lines", "non_ascii", "top_word",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~_=+<>\\/{}[]", np.uint8)


def text_features(texts: list) -> np.ndarray:
    """One row of ``FEATURES`` per text. Texts without words give zeros but for their length."""
    out = np.zeros((len(texts), len(FEATURES)))
    buffer, begins = S.joined(texts)
    starts, hashes = S.words(buffer)
    cuts = np.searchsorted(starts, begins)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        n = b - a
        if n == 0:
            continue
        w = hashes[a:b]
        counts = np.bincount(buffer[begins[i] : begins[i + 1] - 1], minlength=256)
        bytes_in = counts.sum() - counts[[9, 10, 11, 12, 13, 32]].sum()
        kinds = np.unique(w, return_counts=True)[1]
        runs = S.shingle_hashes(w)
        upper, lower = counts[65:91].sum(), counts[97:123].sum()
        out[i] = (
            np.log1p(n),
            len(kinds) / n,
            np.sqrt((w[1:] == w[:-1]).sum() / n),
            np.sqrt(1 - len(np.unique(runs)) / len(runs)),
            np.sqrt(upper / (upper + lower + 1)),
            np.sqrt(counts[33] / n),
            np.sqrt(counts[_SYMBOLS].sum() / n),
            np.sqrt(counts[124] / n),
            np.sqrt(counts[48:58].sum() / n),
            np.sqrt(counts[46] / n),
            np.sqrt(counts[44] / n),
            np.log1p(bytes_in / n),
            np.sqrt(counts[10] / n),
            np.sqrt(counts[128:].sum() / (bytes_in + 1)),
            np.sqrt(kinds.max() / n) * min(1.0, n / 50),
        )
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights on raw features and the score at which a document passes."""

    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(x @ self.weights - self.threshold, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))


def fit_ranking(good: np.ndarray, bad: np.ndarray, share_bad: float, seed: int = 7) -> Ranking | None:
    """Fit on feature rows of both classes; None if one has no row, as no pair exists then.

    ``share_bad`` is the share of bad rows before the sample was balanced.
    """
    if not len(good) or not len(bad):
        return None
    both = np.concatenate([good, bad])
    scale = both.std(axis=0)
    scale[scale == 0] = 1
    rng = np.random.default_rng(seed)
    # every row of the smaller class takes part equally often
    g = rng.permuted(np.resize(np.arange(len(good)), PAIRS))
    b = rng.permuted(np.resize(np.arange(len(bad)), PAIRS))
    w = _logistic((good[g] - bad[b]) / scale) / scale
    scores = np.concatenate([good @ w, bad @ w])
    is_good = np.repeat([True, False], [len(good), len(bad)])
    mass = np.where(is_good, (1 - share_bad) / len(good), share_bad / len(bad))
    return Ranking(w, _quantile_cut(scores, is_good, mass))


def _logistic(differences: np.ndarray) -> np.ndarray:
    """Newton steps for mean log(1 + exp(-w.d)) plus a ridge."""
    w = np.zeros(differences.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        gradient = -(differences * p[:, None]).mean(axis=0) + _RIDGE * w
        hessian = (differences.T * (p * (1 - p))) @ differences / len(differences) + _RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _quantile_cut(scores: np.ndarray, is_good: np.ndarray, mass: np.ndarray) -> float:
    """The quantile of the scores that splits the classes with the smallest loss of mass.

    Every quantile in steps of 1 / ``_QUANTILES`` is tried; of equally good ones the middle,
    and between its two neighbouring scores the mean.
    """
    order = np.argsort(scores, kind="stable")
    s, good, m = scores[order], is_good[order], mass[order]
    level = np.cumsum(m)
    at = np.minimum(np.searchsorted(level, np.arange(1, _QUANTILES) / _QUANTILES), len(s) - 1)
    cuts = np.unique(np.concatenate([(s[at] + s[np.maximum(at - 1, 0)]) / 2, [s[0]]]))
    lost_good = np.append(0, np.cumsum(m * good))[np.searchsorted(s, cuts)]
    kept_bad = (m * ~good).sum() - np.append(0, np.cumsum(m * ~good))[np.searchsorted(s, cuts)]
    loss = lost_good + kept_bad
    best = cuts[loss <= loss.min() + 1e-12]
    cut = best[len(best) // 2]
    below, above = s[s < cut], s[s >= cut]
    return float((below[-1] + above[0]) / 2 if len(below) and len(above) else cut)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Learns from rows of ``labels`` whose crc32 of the doc_id as text leaves another remainder
    than ``held``; text is the only input of a score. Null and empty texts are scored by their
    features (zeros). Labels other than 0 and 1, without a document or with a null id are not
    used; a document labelled twice counts twice. A null doc_id is never held out and never
    learned from. Without a good and a bad label every score is ``THRESHOLD``: all pass.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit_from_labels(docs, labels.where(remainder != held))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(_batch_scores(batch, model))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": score})

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; learns as ``quality_scores`` does."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit_from_labels(docs, labels.where(remainder != held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(batch, model) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def _batch_scores(batch: pa.RecordBatch, model: Ranking | None) -> np.ndarray:
    if model is None:
        return np.full(batch.num_rows, THRESHOLD)
    texts = batch.column("text").to_pylist()
    return np.concatenate(
        [model.score(text_features(texts[part])) for part in S.slices_of(texts)] or [np.empty(0)]
    )


def fit_from_labels(docs: DataFrame, labels: DataFrame) -> Ranking | None:
    """Fit on every labelled row; None if a class has none, as no pair exists then.

    The larger class is dealt into blocks of about ``ROWS_PER_CLASS`` rows by a hash of the id,
    the smaller one into as many slices as it fills; a block meets one slice, a slice several
    blocks in turn. Each block draws ``PAIRS`` pairs, in which every row of it takes part.
    Newton's sums come from the blocks, the threshold from running counts over all scores.
    """
    known = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null")
    held = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    share = {r.quality: r["count"] for r in held.groupBy("quality").count().collect()}
    kind = dict(docs.dtypes)["doc_id"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = [row for part in S.slices_of(texts) for row in text_features(texts[part])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array(x, pa.list_(pa.float64()))})

    made = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(features, f"doc_id {kind}, x array<double>")
    rows = written(made.join(known, "doc_id").select("doc_id", "quality", "x", F.xxhash64("x").alias("h")), "quality")
    n = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(n) < 2:
        return None
    scale = _deviations(rows)
    blocks = _blocks(rows, n)
    w = _fit_blocks(blocks, scale) / scale
    release(blocks)
    bad = share[0] / sum(share.values())
    ranking = Ranking(w, _cut_of_scores(rows, w, {1: (1 - bad) / n[1], 0: bad / n[0]}))
    release(rows)
    return ranking


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _sums(df: DataFrame, measure) -> np.ndarray:
    """``measure`` of each batch, numbers of one length, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"v": pa.array([measure(batch)], pa.list_(pa.float64()))})

    total = df.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in total.orderBy("i").collect()])


def _deviations(rows: DataFrame) -> np.ndarray:
    """Population deviation of each feature over all rows, 1 where it is zero."""
    k = len(FEATURES)
    first = _sums(rows.select("x"), lambda b: [*_matrix(b.column("x")).sum(axis=0), b.num_rows])
    mean = first[:k] / first[k]
    squares = _sums(rows.select("x"), lambda b: list(((_matrix(b.column("x")) - mean) ** 2).sum(axis=0)))
    scale = np.sqrt(squares / first[k])
    scale[scale < 1e-12] = 1
    return scale


def _blocks(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """``(block, good, bad)``: the feature rows of both classes, packed, ordered by their hash."""
    large = max(n, key=n.get)
    count = -(-n[large] // ROWS_PER_CLASS)
    slices = max(1, min(count, n[1 - large] // ROWS_PER_CLASS))
    place = F.xxhash64("doc_id")
    dealt = rows.where(F.col("quality") == large).select(F.pmod(place, F.lit(count)).alias("block"), "quality", "x", "h")
    turns = F.sequence(F.pmod(place, F.lit(slices)), F.lit(count - 1).cast("long"), F.lit(slices).cast("long"))
    met = rows.where(F.col("quality") != large).select(F.explode(turns).alias("block"), "quality", "x", "h")

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("x").combine_chunks())
        order = np.lexsort([*x.T[::-1], table.column("h").to_numpy()])
        good = table.column("quality").to_numpy()[order] == 1
        x = x[order]
        return pa.table({"block": table.column("block")[:1], "good": [x[good].tobytes()], "bad": [x[~good].tobytes()]})

    packed = dealt.unionByName(met).groupBy("block").applyInArrow(pack, "block long, good binary, bad binary")
    return written(packed, "pairs")


def _fit_blocks(blocks: DataFrame, scale: np.ndarray, seed: int = 7) -> np.ndarray:
    """Newton steps for mean log(1 + exp(-w.d)) plus a ridge over the pairs of all blocks."""
    k = len(FEATURES)
    w = np.zeros(k)
    for _ in range(50):

        def measure(batch: pa.RecordBatch, w=w) -> list[float]:
            total = np.zeros(k + k * k + 1)
            for block, good, bad in zip(*(batch.column(c).to_pylist() for c in ("block", "good", "bad"))):
                good, bad = (np.frombuffer(v).reshape(-1, k) for v in (good, bad))
                if not len(good) or not len(bad):
                    continue
                rng = np.random.default_rng(seed + block)
                g = rng.permuted(np.resize(np.arange(len(good)), max(PAIRS, len(good), len(bad))))
                b = rng.permuted(np.resize(np.arange(len(bad)), len(g)))
                d = (good[g] - bad[b]) / scale
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                total += [*-(d * p[:, None]).sum(axis=0), *((d.T * (p * (1 - p))) @ d).ravel(), len(d)]
            return list(total)

        sums = _sums(blocks, measure)
        pairs = sums[-1]
        gradient = sums[:k] / pairs + _RIDGE * w
        hessian = sums[k:-1].reshape(k, k) / pairs + _RIDGE * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _cut_of_scores(rows: DataFrame, w: np.ndarray, mass: dict[int, float]) -> float:
    """As ``_quantile_cut``, from running counts of both classes over the scores of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"quality": batch.column("quality"), "s": pa.array(_matrix(batch.column("x")) @ w)})

    scored = rows.select(F.col("quality").cast("int"), "x").mapInArrow(run, "quality int, s double")
    counts = written(
        scored.groupBy("s").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")), "scores"
    )
    at = running_totals(counts, [], "s", ["good", "bad"])
    before_good, before_bad = F.col("cum_good") - F.col("good"), F.col("cum_bad") - F.col("bad")
    level = F.col("cum_good") * mass[1] + F.col("cum_bad") * mass[0]
    earlier = before_good * mass[1] + before_bad * mass[0]
    steps = F.floor(level * _QUANTILES + 1e-9) > F.floor(earlier * _QUANTILES + 1e-9)
    first = (before_good + before_bad) == 0
    loss = before_good * mass[1] + (F.col("all_bad") - before_bad) * mass[0]
    inner = F.ceil(earlier * _QUANTILES + 1e-9) < _QUANTILES
    tried = at.where(first | (steps & inner)).select("s", loss.alias("loss")).orderBy("s").collect()
    least = min(r.loss for r in tried) + 1e-12
    best = [r.s for r in tried if r.loss <= least]
    cut = best[len(best) // 2]
    below = counts.where(F.col("s") < cut).agg(F.max("s")).first()[0]
    release(counts)
    return cut if below is None else (below + cut) / 2
