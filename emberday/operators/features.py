"""Leak-free features of a station's daily series.

Every window here is partitioned by station and ordered by date over a table with one
row per (station, day), so a partition is never longer than the calendar. All columns
share that one partitioning and order: one exchange and one sort for the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.functions.calendar import with_calendar_columns

# Steps back, window lengths, and the measures features are made from.
LAGS = (1, 3, 7, 14)
WINDOWS = (3, 7, 14)
CONTINUOUS = ("TA_day", "TA_dtr_day", "POP_day", "WD_sin_day", "WD_cos_day")
BINARY = ("is_precip_day", "has_00_obs", "has_12_obs")
QUALITY = ("obs_cnt_sel",)
SKY = "SKY_day"
CURRENT_DAY = (*CONTINUOUS, *BINARY, *QUALITY, SKY)

# What a row has of its own.
STATIC_FEATURES = ("station_id", "stn_lat", "stn_lon", "month", "dayofyear", "doy_sin", "doy_cos")


def by_station() -> W:
    return W.partitionBy("station_id").orderBy("date")


def lag_columns(sources: Sequence[str], lags: Sequence[int] = LAGS) -> dict[str, Column]:
    series = by_station()
    return {f"{c}_lag{k}": F.lag(c, k).over(series) for k in lags for c in sources}


def _trailing_columns(
    sources: Sequence[str],
    windows: Sequence[int],
    suffix: str,
    aggregate: Callable[[str], Column],
) -> dict[str, Column]:
    """``aggregate`` over the n rows before the current one, for every source and n."""
    series = by_station()
    frames = {n: series.rowsBetween(-n, -1) for n in windows}
    return {
        f"{c}_{suffix}_{n}": aggregate(c).over(frame)
        for n, frame in frames.items()
        for c in sources
    }


def rolling_mean_columns(
    sources: Sequence[str], windows: Sequence[int] = WINDOWS
) -> dict[str, Column]:
    return _trailing_columns(sources, windows, "rollmean", F.avg)


def rolling_sum_columns(
    sources: Sequence[str], windows: Sequence[int] = WINDOWS
) -> dict[str, Column]:
    return _trailing_columns(sources, windows, "rollsum", F.sum)


def rolling_mode_columns(
    sources: Sequence[str], windows: Sequence[int] = WINDOWS
) -> dict[str, Column]:
    """Most frequent value of the trailing rows, ties to the smallest, nulls ignored."""
    return _trailing_columns(sources, windows, "mode", lambda c: F.mode(c, True))


def with_dry_spell(df: DataFrame, precip: str = "is_precip_day") -> DataFrame:
    """Add the number of consecutive dry rows ending yesterday, null when unknown.

    It is the distance to the last break, a break being a wet or unknown yesterday. The
    flag is cut to a whole number first, so 0.5 counts as dry.
    """
    yesterday = F.lag(precip, 1).over(by_station())
    marked = df.withColumns(
        {
            "_known": yesterday.isNotNull(),
            "_break": yesterday.isNull() | (yesterday.cast("int") != 0),
            "_row": F.row_number().over(by_station()),
        }
    )
    last_break = F.max(F.when(F.col("_break"), F.col("_row"))).over(
        by_station().rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    spell = F.when(F.col("_known"), (F.col("_row") - last_break).cast("double"))
    return marked.withColumn("dry_spell_days", spell).drop("_known", "_break", "_row")


def wide_features(base: DataFrame) -> DataFrame:
    """The whole lag, trailing-window, mode and dry-spell table of a dense base table."""
    df = with_calendar_columns(base)
    df = df.withColumns(
        {
            **lag_columns(CURRENT_DAY),
            **rolling_mean_columns((*CONTINUOUS, *QUALITY)),
            **rolling_sum_columns(BINARY),
            **rolling_mode_columns((SKY,)),
        }
    )
    return with_dry_spell(df)


def feature_names() -> list[str]:
    """Model inputs: static and calendar columns plus the generated history columns."""
    names = [
        *STATIC_FEATURES,
        *[f"{c}_lag{k}" for k in LAGS for c in CURRENT_DAY],
        *[f"{c}_rollmean_{n}" for n in WINDOWS for c in (*CONTINUOUS, *QUALITY)],
        *[f"{c}_rollsum_{n}" for n in WINDOWS for c in BINARY],
        *[f"{SKY}_mode_{n}" for n in WINDOWS],
        "dry_spell_days",
    ]
    leaked = set(names) & set(CURRENT_DAY)
    if leaked:
        raise AssertionError(f"same-day measures among the features: {sorted(leaked)}")
    return names


def categorical_names() -> list[str]:
    return [
        "station_id",
        "month",
        *[f"{SKY}_lag{k}" for k in LAGS],
        *[f"{SKY}_mode_{n}" for n in WINDOWS],
    ]


def past_n_days(
    df: DataFrame, days: int = 3, columns: Sequence[str] | None = None
) -> DataFrame:
    """Columns of the k-th day before, by date and not by row, for k = 1..days.

    A day without a row k days earlier gets null. The range frame reads exactly that
    one day, so one window pass replaces ``days`` self-joins.
    """
    sources = [c for c in (columns or df.columns) if c not in ("station_id", "date")]
    day_number = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    series = W.partitionBy("station_id").orderBy(day_number)
    shifted = [
        F.max(c).over(series.rangeBetween(-k, -k)).alias(f"{c}_minus{k}d")
        for k in range(1, days + 1)
        for c in sources
    ]
    return df.select("station_id", "date", *shifted)
