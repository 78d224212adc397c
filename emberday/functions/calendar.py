"""Calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_SEASON_CYCLE = 365  # also in leap years


def season_angle(day_of_year: Column) -> Column:
    return F.lit(2 * math.pi) * day_of_year.cast("double") / F.lit(float(DAYS_PER_SEASON_CYCLE))


def with_calendar_columns(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add month, dayofyear, doy_sin and doy_cos where they are absent."""
    day = F.col(date_col).cast("date")
    day_of_year = F.col("dayofyear") if "dayofyear" in df.columns else F.dayofyear(day)
    derived = {
        "month": F.month(day),
        "dayofyear": F.dayofyear(day),
        "doy_sin": F.sin(season_angle(day_of_year)),
        "doy_cos": F.cos(season_angle(day_of_year)),
    }
    return df.withColumns(
        {date_col: day, **{n: c for n, c in derived.items() if n not in df.columns}}
    )
