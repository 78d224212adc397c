"""Event points to the normalised event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.parsing import parse_day_digits, parse_event_timestamp
from emberday.operators.prefix import sequential_ids

# Columns of the event table.
EVENT_COLUMNS = (
    "fire_id", "fire_datetime", "fire_date", "year", "month", "CTPRV_NM", "SGNG_NM",
    "station_id", "dist_m", "lon", "lat",
)
DEFAULT_YEARS = ("2020", "2021")


def in_years(points: DataFrame, years: Sequence[str] = DEFAULT_YEARS) -> DataFrame:
    """Points whose timestamp text starts with one of ``years``."""
    return points.filter(F.substring(F.col("OCCRR_DTM").cast("string"), 1, 4).isin(*years))


def event_time(columns: Sequence[str]) -> Column:
    if "OCCRR_DATE" in columns:
        return F.col("OCCRR_DATE").try_cast("timestamp_ntz")
    if "OCCRR_DTM" in columns:
        return parse_event_timestamp(F.col("OCCRR_DTM"))
    raise ValueError("event points need OCCRR_DATE or OCCRR_DTM")


def event_day(columns: Sequence[str]) -> Column:
    """Day only, so that a bad time of day does not lose the date."""
    if "OCCRR_DATE" in columns:
        return F.to_date(event_time(columns))
    if "OCCRR_DTM" in columns:
        return parse_day_digits(F.substring(F.col("OCCRR_DTM").cast("string"), 1, 8))
    raise ValueError("event points need OCCRR_DATE or OCCRR_DTM")


def drop_duplicate_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["fire_datetime", "lon", "lat"])


def normalise_events(
    points: DataFrame, sequential: bool = False, deduplicate: bool = False
) -> DataFrame:
    """Event table with id, time parts and position.

    Ids are a hash of time and position unless ``sequential`` asks for 0-based numbers.
    """
    events = points.withColumn("fire_datetime", event_time(points.columns))
    if deduplicate:
        events = drop_duplicate_events(events)
    events = events.withColumns(
        {
            "fire_date": F.to_date("fire_datetime"),
            "year": F.year("fire_datetime"),
            "month": F.month("fire_datetime"),
        }
    )
    if "fire_id" not in events.columns:
        if sequential:
            events = sequential_ids(events, "fire_id", "fire_datetime", ["lon", "lat"])
        else:
            events = events.withColumn("fire_id", F.xxhash64("fire_datetime", "lon", "lat"))
    return events.select(*[c for c in EVENT_COLUMNS if c in events.columns])
