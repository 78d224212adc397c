"""Platt and isotonic calibration of scored rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.functions.risk import logit
from emberday.operators.metrics import score_counts
from emberday.operators.prefix import ordered_ranges
from emberday.operators.splits import LABEL
from emberday.session import release, written


def _with_logit_vector(df: DataFrame, score: str) -> DataFrame:
    """Add ``_x``, the logit as a one-element vector; a null score counts as 0 there."""
    x = F.coalesce(logit(F.col(score)), F.lit(0.0))
    return df.withColumn("_x", array_to_vector(F.array(x)))



def fit_platt(scored: DataFrame, label: str = LABEL, score: str = "pred_prob") -> LogisticRegressionModel:
    """Logistic regression on the logit of the score, unit penalty on the summed loss.

    Rows with equal score and label enter once, with their count as weight.
    """
    counts = score_counts(scored, [], label, score)
    rows = counts.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0]
    weighted = counts.select(
        "score",
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("y"), F.col("pos").cast("double").alias("w")),
                F.struct(F.lit(0.0).alias("y"), F.col("neg").cast("double").alias("w")),
            )
        ),
    ).filter(F.col("w") > 0)
    return LogisticRegression(
        featuresCol="_x", labelCol="y", weightCol="w", regParam=1.0 / rows,
        elasticNetParam=0.0, standardization=False,
    ).fit(_with_logit_vector(weighted, "score"))


def apply_platt(
    model: LogisticRegressionModel, scored: DataFrame, score: str = "pred_prob"
) -> DataFrame:
    """Replace ``score`` by its calibrated value; null scores stay null."""
    calibrated = model.transform(_with_logit_vector(scored, score))
    value = F.when(F.col(score).isNotNull(), vector_to_array("probability")[1])
    return calibrated.withColumn(score, value).select(*scored.columns)


def fit_isotonic(scored: DataFrame, label: str = LABEL, score: str = "pred_prob") -> DataFrame:
    """``(x, y)``: the bounds of the blocks of an isotonic regression and their mean labels.

    Equal scores are averaged first, which leaves the fit unchanged. Scores are dealt to tasks
    by ranges; each task pools its own violators, which leaves one row a block. Pooling the
    blocks of neighbouring ranges gives the same blocks as pooling all scores at once, so the
    ranges are merged pair by pair until one is left or no two neighbours violate the order:
    a merge sees blocks, never scores. Sums of labels and counts are whole numbers, so the
    blocks do not depend on how the ranges fell.
    """
    counts = score_counts(scored, [], label, score).select("score", "pos", (F.col("pos") + F.col("neg")).alias("n"))
    ranges = counts.repartitionByRange("score").sortWithinPartitions("score")
    blocks = ranges.mapInArrow(_pooled_scores, _BLOCKS).withColumn("part", F.spark_partition_id())
    blocks = written(blocks, "isotonic")
    while True:
        edges = blocks.groupBy("part").agg(F.min_by("mean", "low").alias("first"), F.max_by("mean", "high").alias("last"))
        ahead = W.orderBy("part")  # a row for each range
        torn = edges.withColumn("next", F.lead("first").over(ahead)).where("last >= next")
        if not torn.take(1):
            break
        dense = edges.select("part", ((F.row_number().over(ahead) - 1) / 2).cast("int").alias("pair"))
        pairs = blocks.join(dense, "part").select(*_BLOCK_COLUMNS, F.col("pair").alias("part"))
        merged = pairs.groupBy("part").applyInArrow(_pooled_pair, f"{_BLOCKS}, part int")
        blocks, before = written(merged, "isotonic"), blocks
        release(before)
    ends = F.array(F.struct(F.col("low").alias("x")), F.struct(F.col("high").alias("x")))
    return blocks.select(F.explode(ends).alias("e"), F.col("mean").alias("y")).select("e.x", "y").distinct()


_BLOCK_COLUMNS = ("low", "high", "pos", "n", "mean")
_BLOCKS = "low double, high double, pos bigint, n bigint, mean double"


def _pool(low: list, high: list, pos: list, n: list) -> pa.Table:
    """Neighbouring blocks whose means do not rise become one; means are compared as fractions."""
    out: list[list] = []
    for block in zip(low, high, pos, n):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, top, more, rows = out.pop()
            out[-1][1] = top
            out[-1][2] += more
            out[-1][3] += rows
    low, high, pos, n = (list(x) for x in zip(*out)) if out else ([], [], [], [])
    return pa.table(
        {
            "low": pa.array(low, pa.float64()), "high": pa.array(high, pa.float64()), "pos": pa.array(pos, pa.int64()),
            "n": pa.array(n, pa.int64()), "mean": pa.array([p / m for p, m in zip(pos, n)], pa.float64()),
        }
    )


def _pooled_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one sorted range; blocks so far and one batch are in memory."""
    held = _pool([], [], [], [])
    for batch in batches:
        x, pos, n = (batch.column(c).to_pylist() for c in ("score", "pos", "n"))
        before = [held.column(c).to_pylist() for c in ("low", "high", "pos", "n")]
        held = _pool(*(a + b for a, b in zip(before, (x, x, pos, n))))
    yield from held.to_batches()


def _pooled_pair(blocks: pa.Table) -> pa.Table:
    part = blocks.column("part")[0].as_py()
    ordered = blocks.sort_by("low")
    pooled = _pool(*(ordered.column(c).to_pylist() for c in ("low", "high", "pos", "n")))
    return pooled.append_column("part", pa.array([part] * len(pooled), pa.int32()))


def apply_isotonic(model: DataFrame, scored: DataFrame, score: str = "pred_prob") -> DataFrame:
    """Replace ``score``; between two bounds the line counts, beyond the fitted range the outermost value.

    Bounds and scores are lined up by ranges of the score, each range seeing the last bound
    before it and the first behind it, so neither side is gathered.
    """
    knots = model.select("x", "y")
    wanted = scored.select(F.col(score).cast("double").alias("x")).where("x is not null").distinct()
    both = knots.withColumn("asked", F.lit(0)).unionByName(wanted.select("x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("asked")))
    placed = written(ordered_ranges(both, ["x", "asked"]), "isotonic-lined")
    knot = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    spans = placed.groupBy("_range").agg(F.min(knot).alias("first"), F.max(knot).alias("last"))
    ahead, behind = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.orderBy("_range").rowsBetween(1, W.unboundedFollowing)
    near = spans.select("_range", F.max("last").over(ahead).alias("before"), F.min("first").over(behind).alias("after"))
    inside = W.partitionBy("_range").orderBy("x", "asked")
    low = F.coalesce(F.last(knot, True).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("before"))
    high = F.coalesce(F.first(knot, True).over(inside.rowsBetween(0, W.unboundedFollowing)), F.col("after"))
    lined = placed.join(near, "_range").withColumns({"lo": low, "hi": high}).where("asked = 1")
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    share = F.coalesce(F.try_divide(F.col("x") - lo["x"], hi["x"] - lo["x"]), F.lit(0.0))
    values = lined.select(F.col("x").alias("_x"), (lo["y"] + (hi["y"] - lo["y"]) * share).alias("_y"))
    joined = scored.join(values, scored[score].cast("double") == values["_x"], "left")
    return joined.withColumn(score, F.col("_y")).select(*scored.columns)
