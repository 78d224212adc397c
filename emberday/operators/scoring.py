"""Probabilities to the prediction table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.risk import (
    DEFAULT_THRESHOLD,
    alert_flag,
    finite_or_null,
    operating_threshold,
    risk_level,
)

PREDICTION_COLUMNS = (
    "model_name", "station_id", "date", "pred_prob", "risk_level",
    "alert_threshold", "is_alert", "stn_lat", "stn_lon",
)
# The sequence model is always alerted at the default threshold.
SEQUENCE_MODEL = "sequence"


def resolved_thresholds(meta: DataFrame) -> DataFrame:
    """(model_name, alert_threshold) from the model metadata table."""
    stored = operating_threshold(
        F.col("operating_threshold"), F.col("far_threshold"), F.col("holdout_threshold")
    )
    fixed = F.when(F.col("model_name") == SEQUENCE_MODEL, F.lit(DEFAULT_THRESHOLD))
    return meta.select("model_name", F.coalesce(fixed, stored).alias("alert_threshold"))


def prediction_table(scores: DataFrame, thresholds: DataFrame, stations: DataFrame) -> DataFrame:
    """Scores (model_name, station_id, date, pred_prob) to the output contract.

    Models without a stored threshold use the default. Stations join on their id, many
    rows to one. Thresholds, a row per model, go to the scores: an exchange by model would
    leave all scores of a model to one task.
    """
    joined = scores.join(F.broadcast(thresholds), "model_name", "left").join(stations, "station_id", "left")
    threshold: Column = F.coalesce(F.col("alert_threshold"), F.lit(DEFAULT_THRESHOLD))
    return joined.withColumns(
        {"pred_prob": finite_or_null(F.col("pred_prob").cast("double")), "alert_threshold": threshold}
    ).select(
        "model_name",
        F.col("station_id").cast("string").alias("station_id"),
        F.col("date").cast("date").alias("date"),
        "pred_prob",
        risk_level(F.col("pred_prob")).alias("risk_level"),
        "alert_threshold",
        alert_flag(F.col("pred_prob"), F.col("alert_threshold")).alias("is_alert"),
        "stn_lat",
        "stn_lon",
    )


def rows_of_date(df: DataFrame, target_date: str) -> DataFrame:
    """Rows of one date; raises when there are none."""
    day = df.filter(F.col("date") == F.lit(target_date).cast("date"))
    if day.isEmpty():
        raise ValueError(f"no rows for date {target_date}")
    return day
