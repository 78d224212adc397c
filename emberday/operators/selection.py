"""Model ranking and the winner per station."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.operators.metrics import classification_metrics

_UNRANKED = ("rows", "positive", "threshold")
BENCHMARK_COLUMNS = (
    "rows", "positive", "roc_auc", "pr_auc", "brier", "log_loss", "precision", "recall", "f1",
    "false_alarm_rate", "positive_rate", "recall_at_precision",
    "recall_at_precision_threshold", "recall_at_far", "recall_at_far_threshold",
)


def pooled_predictions(frames: Sequence[DataFrame], common_keys: bool = False) -> DataFrame:
    """All models' holdout predictions in long form.

    ``common_keys`` keeps only the (station, date) rows that every model scored.
    """
    columns = ["station_id", "date", "fire_label", "pred_prob", "model_name"]
    pooled = reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])
    if not common_keys:
        return pooled
    keys = ["station_id", "date"]
    shared = (
        pooled.select(*keys, "model_name")
        .distinct()
        .groupBy(*keys)
        .count()
        .filter(F.col("count") == len(frames))
    )
    return pooled.join(shared, keys, "left_semi")


def rank_models(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(*_benchmark_order())


def _benchmark_order() -> list:
    return [
        F.desc_nulls_last("pr_auc"),
        F.desc_nulls_last("recall_at_precision"),
        F.desc_nulls_last("recall_at_far"),
        F.asc_nulls_last("brier"),
    ]


def model_benchmark(predictions: DataFrame, **limits) -> DataFrame:
    """Metrics per model over all its rows, best first."""
    metrics = classification_metrics(predictions, ["model_name"], **limits)
    return rank_models(metrics.select("model_name", *BENCHMARK_COLUMNS))


def rank_calibrations(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(
        F.asc_nulls_last("brier"), F.asc_nulls_last("log_loss"), F.desc_nulls_last("pr_auc")
    )


def station_model_metrics(predictions: DataFrame, **limits) -> DataFrame:
    """Metrics per (station, model); all of them null when only one class is present."""
    keys = ["station_id", "model_name"]
    metrics = classification_metrics(predictions, keys, **limits)
    two_classes = (F.col("positive") > 0) & (F.col("positive") < F.col("rows"))
    return metrics.select(
        *keys,
        "rows",
        "positive",
        (F.col("positive") / F.col("rows")).alias("positive_rate_true"),
        "threshold",
        *[
            F.when(two_classes, F.col(c)).alias(c)
            for c in metrics.columns
            if c not in (*keys, *_UNRANKED)
        ],
    )


def station_winners(metrics: DataFrame) -> DataFrame:
    """Best model per station; the model name settles what the metrics leave equal."""
    order = W.partitionBy("station_id").orderBy(*_benchmark_order(), F.asc("model_name"))
    return (
        metrics.withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )
