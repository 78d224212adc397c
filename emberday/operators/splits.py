"""Time splits, yearly folds and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABEL = "fire_label"
DEFAULT_HOLDOUT_DAYS = 240
DEFAULT_CALIBRATION_DAYS = 365
MIN_TRAIN_ROWS = 365


def holdout_cutoff(df: DataFrame, days: int, date_col: str = "date") -> Column:
    """First holdout day as a scalar of the plan: last date minus ``days``."""
    if days <= 0:
        raise ValueError("holdout days must be positive")
    return df.select(F.date_sub(F.max(F.col(date_col).cast("date")), days)).scalar()


def time_split(
    df: DataFrame, holdout_days: int = DEFAULT_HOLDOUT_DAYS, date_col: str = "date"
) -> DataFrame:
    """Add ``split``: train before the cutoff, test from it on (holdout_days + 1 dates)."""
    cutoff = holdout_cutoff(df, holdout_days, date_col)
    day = F.col(date_col).cast("date")
    return df.withColumn("split", F.when(day < cutoff, "train").when(day >= cutoff, "test"))


def three_way_split(
    df: DataFrame,
    holdout_days: int = DEFAULT_HOLDOUT_DAYS,
    calibration_days: int = DEFAULT_CALIBRATION_DAYS,
    date_col: str = "date",
) -> DataFrame:
    """Add ``split``: train, calibration, test, one after the other in time."""
    test_start = holdout_cutoff(df, holdout_days, date_col)
    calibration_start = holdout_cutoff(df, holdout_days + calibration_days, date_col)
    day = F.col(date_col).cast("date")
    return df.withColumn(
        "split",
        F.when(day < calibration_start, "train")
        .when(day < test_start, "calibration")
        .when(day >= test_start, "test"),
    )


def year_split(df: DataFrame, first_test_year: int = 2021, date_col: str = "date") -> DataFrame:
    year = F.year(F.col(date_col).cast("date"))
    return df.withColumn(
        "split", F.when(year < first_test_year, "train").when(year >= first_test_year, "test")
    )


def split_summary(
    df: DataFrame, by: Sequence[str] = ("split",), label: str = LABEL, date_col: str = "date"
) -> DataFrame:
    """Rows, positives, rate, date range and whether both classes occur, per split."""
    y = F.col(label).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y).alias("positive"),
        F.avg(y).alias("positive_rate"),
        F.min(F.col(date_col).cast("date")).alias("start_date"),
        F.max(F.col(date_col).cast("date")).alias("end_date"),
        (F.min(y) < F.max(y)).cast("int").alias("two_classes"),
    )


def require_two_classes(summary: DataFrame, splits: Sequence[str] = ("train", "test")) -> None:
    """Raise unless every listed split has rows of both classes."""
    flags = {r.split: r.two_classes for r in summary.select("split", "two_classes").collect()}
    for split in splits:
        if split not in flags:
            raise ValueError(f"the {split} split is empty")
        if flags[split] != 1:
            raise ValueError(f"the {split} split has one class only")


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: counts, positive rate, balanced weights and the negative/positive ratio."""
    counted = df.filter(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("positive")
    )
    rows, positive = F.col("rows"), F.col("positive")
    negative = rows - positive
    return counted.select(
        "rows",
        "positive",
        negative.alias("negative"),
        F.try_divide(positive, rows).alias("positive_rate"),
        F.try_divide(rows, 2 * positive).alias("weight_positive"),
        F.try_divide(rows, 2 * negative).alias("weight_negative"),
        F.coalesce(F.try_divide(negative, positive), F.lit(1.0)).alias("scale_pos_weight"),
    )


def yearly_folds(
    df: DataFrame,
    start_year: int | None = None,
    end_year: int | None = None,
    min_train_rows: int = MIN_TRAIN_ROWS,
    label: str = LABEL,
    date_col: str = "date",
) -> DataFrame:
    """Expanding folds: test one calendar year, train on everything before it.

    Built from per-year counts and a running sum over the years, so rows are never
    copied per fold. ``eligible`` is 1 when the train side is long enough and both
    sides have both classes.
    """
    day, y = F.col(date_col).cast("date"), F.col(label).cast("long")
    per_year = (
        df.filter(day.isNotNull() & y.isNotNull())
        .groupBy(F.year(day).alias("test_year"))
        .agg(
            F.count(F.lit(1)).alias("test_rows"),
            F.sum(y).alias("test_positive"),
            F.min(day).alias("test_start_date"),
            F.max(day).alias("test_end_date"),
        )
    )
    # One row per calendar year: the only window here without a partition key.
    before = W.orderBy("test_year").rowsBetween(W.unboundedPreceding, -1)
    folds = per_year.withColumns(
        {
            "train_rows": F.coalesce(F.sum("test_rows").over(before), F.lit(0)),
            "train_positive": F.coalesce(F.sum("test_positive").over(before), F.lit(0)),
            "train_start_date": F.min("test_start_date").over(before),
            "train_end_date": F.max("test_end_date").over(before),
        }
    )

    def both(rows: str, positive: str) -> Column:
        return (F.col(positive) > 0) & (F.col(positive) < F.col(rows))

    folds = folds.withColumn(
        "eligible",
        (
            (F.col("train_rows") >= min_train_rows)
            & both("train_rows", "train_positive")
            & both("test_rows", "test_positive")
        ).cast("int"),
    )
    if start_year is not None:
        folds = folds.filter(F.col("test_year") >= start_year)
    if end_year is not None:
        folds = folds.filter(F.col("test_year") <= end_year)
    return folds
