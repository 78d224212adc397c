"""Feature preparation as ML pipeline stages with exact medians."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    TargetEncoder,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.functions.risk import MISSING_CATEGORY, fill_category, finite_or_null
from emberday.operators.prefix import exact_quantiles

# Missing numbers are smaller than every value for a tree.
TREE_MISSING = -1.0e9
# Categories whose values grow with the network are target-encoded, by name and at any size,
# so that the same data set gives the same kind of model with ten stations and ten thousand.
TARGET_ENCODED = ("station_id",)
# Rows with the overall label mean that every encoded category has beside its own.
TARGET_SMOOTHING = 1.0


def typed_inputs(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fill: bool
) -> DataFrame:
    """Numbers as doubles, categories as text, the latter with a missing token if ``fill``."""
    text = fill_category if fill else (lambda c: c.cast("string"))
    return df.withColumns(
        {
            **{c: finite_or_null(F.col(c).try_cast("double")) for c in numeric},
            **{c: text(F.col(c)) for c in categorical},
        }
    )


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows of the listed columns, unrolled inside the map stage."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    )
    return df.select(F.inline(cells))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians, the mean of the middle pair where needed; all-null columns are left out."""
    if not columns:
        return {}
    found = exact_quantiles(_long(df, columns), ["feature"], "value", {"median": 0.5})
    return {r.feature: r["median"] for r in found.collect() if r["median"] is not None}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, ties to the smallest, nulls ignored."""
    if not columns:
        return {}
    counted = (
        _long(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counted.groupBy("feature").agg(F.min(F.struct(-F.col("n"), "value")).alias("b"))
    return {r.feature: r.b.value for r in best.collect()}


def _scales(
    df: DataFrame, columns: Sequence[str], fill: dict[str, float]
) -> tuple[list[float], list[float]]:
    """Mean and population deviation of the filled columns, as one vector aggregate."""
    if not columns:
        return [], []
    filled = F.array(*[F.coalesce(F.col(c), F.lit(fill[c])) for c in columns])
    stats = df.select(
        Summarizer.metrics("mean", "std", "count").summary(array_to_vector(filled)).alias("s")
    ).first().s
    population = math.sqrt((stats["count"] - 1) / stats["count"])
    return [float(m) for m in stats["mean"]], [float(s) * population for s in stats["std"]]


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    counted = _long(df, columns).distinct().groupBy("feature").agg(F.count("value").alias("n"))
    return {r.feature: r.n for r in counted.collect()}


def linear_stages(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], output: str = "features"
) -> PipelineModel:
    """Median and mode imputation, population standardising, one-hot categories.

    Values unseen in training become all zeros. Numeric columns without any value are
    left out, as are categories.
    """
    middle = medians(train, numeric)
    common = modes(train, categorical)
    used = [c for c in numeric if c in middle]
    cats = [c for c in categorical if c in common]

    means, stds = _scales(train, used, middle)
    parts = []
    for i, c in enumerate(used):
        mean, std = means[i], stds[i] or 1.0
        parts.append(f"(coalesce(`{c}`, {middle[c]!r}D) - ({mean!r}D)) / {std!r}D AS `{c}__z`")
    parts += [f"coalesce(`{c}`, {_sql_text(common[c])}) AS `{c}__c`" for c in cats]
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    names = [f"{c}__z" for c in used]

    if cats:
        prepared = stages[0].transform(train)
        index = StringIndexer(
            inputCols=[f"{c}__c" for c in cats],
            outputCols=[f"{c}__i" for c in cats],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ).fit(prepared)
        # With "keep" the last index is the unseen value; dropping it leaves zeros there.
        hot = OneHotEncoder(
            inputCols=[f"{c}__i" for c in cats],
            outputCols=[f"{c}__h" for c in cats],
            dropLast=True,
        ).fit(index.transform(prepared))
        stages += [index, hot]
        names += [f"{c}__h" for c in cats]
    stages.append(VectorAssembler(inputCols=names, outputCol=output))
    return PipelineModel(stages)


def tree_stages(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    output: str = "features",
    target_encoded: Sequence[str] = TARGET_ENCODED,
) -> tuple[PipelineModel, int]:
    """Missing numbers below all others, categories indexed; also the bins trees need.

    The categories named in ``target_encoded`` become smoothed label means instead.
    """
    large = [c for c in categorical if c in target_encoded]
    small = [c for c in categorical if c not in large]
    sizes = _distinct_values(train, small) if small else {}

    parts = [f"coalesce(`{c}`, {TREE_MISSING!r}D) AS `{c}__n`" for c in numeric]
    parts += [f"coalesce(`{c}`, {_sql_text(MISSING_CATEGORY)}) AS `{c}__c`" for c in categorical]
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    names = [f"{c}__n" for c in numeric]
    prepared = stages[0].transform(train)
    if categorical:
        index = StringIndexer(
            inputCols=[f"{c}__c" for c in categorical],
            outputCols=[f"{c}__i" for c in categorical],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ).fit(prepared)
        stages.append(index)
        prepared = index.transform(prepared)
        names += [f"{c}__i" for c in small]
    if large:
        encoder = TargetEncoder(
            inputCols=[f"{c}__i" for c in large],
            outputCols=[f"{c}__t" for c in large],
            labelCol=label,
            targetType="binary",
            handleInvalid="keep",
            smoothing=TARGET_SMOOTHING,
        ).fit(prepared)
        stages.append(encoder)
        names += [f"{c}__t" for c in large]
    stages.append(VectorAssembler(inputCols=names, outputCol=output))
    bins = max([32, *[sizes[c] + 2 for c in small if c in sizes]])
    return PipelineModel(stages), bins


def ordered_statistic(df: DataFrame, column: str, label: str, output: str, order: str = "date") -> DataFrame:
    """``df`` with the smoothed label mean of a category over the days before the row's own.

    The labels are added up per category and day first, so the running sum of a category is a
    window of at most one row a day. On its first day a category has the overall mean.
    """
    prior = df.agg(F.avg(label)).scalar()
    days = df.groupBy(column, order).agg(F.sum(label).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(column).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    past = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_sum", "_rows")}
    mean = (past["_sum"] + F.lit(TARGET_SMOOTHING) * prior) / (past["_rows"] + F.lit(TARGET_SMOOTHING))
    known = days.select(F.col(column).alias("_category"), F.col(order).alias("_day"), mean.alias(output))
    same = F.col(column).eqNullSafe(F.col("_category")) & F.col(order).eqNullSafe(F.col("_day"))
    return df.drop(output).join(known, same).drop("_category", "_day")


def ordered_features(stages: PipelineModel, train: DataFrame, categorical: Sequence[str], label: str) -> DataFrame:
    """Training rows through ``tree_stages``, label means of categories taken from earlier days only.

    An encoder applied to the rows it was fitted on would hand each row its own label.
    """
    ready = PipelineModel(stages.stages[:-1]).transform(train)
    for c in categorical:
        if c in TARGET_ENCODED:
            ready = ordered_statistic(ready, f"{c}__c", label, f"{c}__t")
    return stages.stages[-1].transform(ready)


def balanced_weight(label: Column, rows: int, positive: int) -> Column:
    """n / (2 * rows of the class)."""
    return F.when(label == 1, F.lit(rows / (2 * positive))).otherwise(
        F.lit(rows / (2 * (rows - positive)))
    )
