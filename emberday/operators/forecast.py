"""Short-term forecasts: normalisation, latest issue per day, daily values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.parsing import clean_code, parse_obs_timestamp, to_code, to_number
from emberday.operators.daily import most_frequent

_KEYS = ("forecast_region_id", "date")


def normalise_forecast(raw: DataFrame) -> DataFrame:
    """Contract names and types; ``date`` is the day the forecast is for."""
    return raw.select(
        F.col("REG_ID").cast("string").alias("forecast_region_id"),
        parse_obs_timestamp(F.col("TM_FC")).alias("forecast_issue_ts"),
        parse_obs_timestamp(F.col("TM_EF")).alias("forecast_effective_ts"),
        to_number(F.col("ST")).alias("POP"),
        clean_code(F.col("SKY")).alias("SKY"),
        to_code(F.col("PREP")).alias("forecast_precip_code"),
    ).withColumn("date", F.to_date("forecast_effective_ts"))


def _usable(forecast: DataFrame, issue_cutoff: Column | None) -> DataFrame:
    rows = forecast.filter(
        F.col("forecast_issue_ts").isNotNull() & F.col("date").isNotNull()
    )
    return rows if issue_cutoff is None else rows.filter(F.col("forecast_issue_ts") <= issue_cutoff)


def before_target_day() -> Column:
    """Cutoff that keeps only forecasts issued before the day they are for began."""
    return F.col("date").cast("timestamp_ntz")


def latest_issue_rows(forecast: DataFrame, issue_cutoff: Column | None = None) -> DataFrame:
    """All rows of the newest issue per (region, date).

    The newest issue time is a max, which combines on the map side; rows meet it again
    in an equi-join, so no region-day is sorted in one task.
    """
    rows = _usable(forecast, issue_cutoff)
    newest = rows.groupBy(*_KEYS).agg(F.max("forecast_issue_ts").alias("forecast_issue_ts"))
    return rows.join(newest, [*_KEYS, "forecast_issue_ts"])


def daily_forecast(forecast: DataFrame, issue_cutoff: Column | None = None) -> DataFrame:
    """POP mean, most frequent sky and strongest precipitation code of the newest issue."""
    by_sky = (
        _usable(forecast, issue_cutoff)
        .groupBy(*_KEYS, "forecast_issue_ts", "SKY")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("POP").alias("pop_sum"),
            F.count("POP").alias("pop_n"),
            F.max("forecast_precip_code").alias("code"),
        )
    )
    by_issue = by_sky.groupBy(*_KEYS, "forecast_issue_ts").agg(
        F.sum("n").alias("n"),
        F.sum("pop_sum").alias("pop_sum"),
        F.sum("pop_n").alias("pop_n"),
        F.max("code").alias("code"),
        most_frequent(F.col("SKY"), F.col("n")).alias("sky"),
    )
    newest = by_issue.groupBy(*_KEYS).agg(
        F.max(
            F.struct("forecast_issue_ts", "n", "pop_sum", "pop_n", "code", "sky")
        ).alias("f")
    )
    return newest.select(
        *_KEYS,
        F.col("f.forecast_issue_ts").alias("forecast_issue_ts"),
        F.col("f.n").alias("forecast_rows"),
        F.when(F.col("f.pop_n") > 0, F.col("f.pop_sum") / F.col("f.pop_n")).alias("POP_day"),
        F.col("f.sky").alias("SKY_forecast"),
        F.col("f.code").alias("forecast_precip_code"),
    )
