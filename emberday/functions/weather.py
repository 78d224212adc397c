"""Sky, wind and precipitation codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sky codes, clear to overcast; the ordinal is the position from 1.
SKY_LEVELS = ("DB01", "DB02", "DB03", "DB04")

# Upper bound of the total cloud amount (tenths) for each sky code.
CLOUD_UPPER_BOUNDS = (2, 5, 8, 10)

# Forecast precipitation codes that mean rain or snow.
FORECAST_PRECIP_CODES = (1, 2, 3, 4)


def sky_ordinal(sky: Column) -> Column:
    """Sky code to 1..4; other text is read as a number, else null."""
    known = F.create_map(*[F.lit(v) for pair in zip(SKY_LEVELS, (1, 2, 3, 4)) for v in pair])
    return F.coalesce(F.try_element_at(known, sky), sky.try_cast("int"))


def sky_one_hot(sky: Column) -> list[Column]:
    """One 0/1 column per sky level; a missing sky gives all zeros."""
    return [
        F.coalesce((sky == level).cast("int"), F.lit(0)).alias(f"SKY_{level}")
        for level in SKY_LEVELS
    ]


def sky_from_cloud(cloud_amount: Column) -> Column:
    """Sky code from the observed cloud amount, null outside 0..10."""
    code = F.when(cloud_amount < 0, F.lit(None))
    for bound, level in zip(CLOUD_UPPER_BOUNDS, SKY_LEVELS):
        code = code.when(cloud_amount <= bound, F.lit(level))
    return code


def sky_code(forecast_sky: Column, cloud_amount: Column) -> Column:
    return F.coalesce(forecast_sky, sky_from_cloud(cloud_amount))


def wind_degrees(index: Column, points: int = 36) -> Column:
    """Compass index to degrees for a scale of ``points`` directions."""
    return index.cast("double") * F.lit(360.0) / F.lit(float(points))


def wind_sin(index: Column, points: int = 36) -> Column:
    return F.sin(F.radians(wind_degrees(index, points)))


def wind_cos(index: Column, points: int = 36) -> Column:
    return F.cos(F.radians(wind_degrees(index, points)))


def precip_flag(
    rain: Column,
    forecast_code: Column | None = None,
    weather_codes: Sequence[tuple[Column, Sequence]] = (),
) -> Column:
    """Measured rain first, then the forecast code, then observed weather codes."""
    flag = F.when(rain > 0, 1)
    if forecast_code is not None:
        flag = flag.when(forecast_code.isin(*FORECAST_PRECIP_CODES), 1)
    for column, wet_codes in weather_codes:
        flag = flag.when(column.isin(*wet_codes), 1)
    return flag.otherwise(0)
