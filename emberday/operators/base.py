"""Labels, the dense station-day calendar and the joins that build the base table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.functions.calendar import with_calendar_columns
from emberday.functions.parsing import to_code
from emberday.operators.joins import with_suffix_on_clash
from emberday.session import written

KEYS = ["station_id", "date"]


def require_columns(df: DataFrame, names, table: str = "input") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"{table} lacks the columns {missing}")


def fire_labels(events: DataFrame, date_col: str = "fire_date") -> DataFrame:
    """One row with ``fire_label`` 1 per (station, date) that had an event; bad ids and dates go."""
    require_columns(events, ["station_id", date_col], "events")
    return (
        events.select(
            to_code(F.col("station_id")).alias("station_id"),
            F.col(date_col).try_cast("date").alias("date"),
        )
        .dropna()
        .distinct()
        .withColumn("fire_label", F.lit(1))
    )


def with_labels(daily: DataFrame, labels: DataFrame) -> DataFrame:
    return daily.join(labels, KEYS, "left").withColumn(
        "fire_label", F.coalesce(F.col("fire_label"), F.lit(0))
    )


def station_day_calendar(stations: DataFrame, daily: DataFrame) -> DataFrame:
    """Every station on every day between the first and last day of ``daily``."""
    bounds: Column = daily.select(F.struct(F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
    return stations.select(
        "station_id",
        F.explode(F.sequence(bounds.getField("first"), bounds.getField("last"))).alias("date"),
    )


def station_dimension(stations: DataFrame) -> DataFrame:
    """One row per station: id, latitude, longitude.

    Equal rows count once; a station at two places fails the job, as either would be a guess.
    """
    return only_one(
        stations.select("station_id", "stn_lat", "stn_lon").distinct(), ["station_id"], "station"
    )


def only_one(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, failing when it is evaluated with two rows of one key; rows with null keys stay apart.

    Meets the key in the same exchange as the join that follows on it.
    """
    if "_same_key" in df.columns:
        raise ValueError("the column _same_key is reserved")
    crowd = F.count("*").over(W.partitionBy(*keys))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    message = F.concat(F.lit(f"more than one {what} row for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(known & (F.col("_same_key") > 1), F.raise_error(message).cast("boolean")).otherwise(True)
    return df.withColumn("_same_key", crowd).where(checked).drop("_same_key")


def station_day_base(daily: DataFrame, stations: DataFrame, labels: DataFrame) -> DataFrame:
    """Gap-free base table. Days without observations keep null measures and label 0.

    The daily rows are written first: they are read for the date bounds and for the join, and
    building them parses the whole raw input.
    """
    daily = written(daily, "daily")
    dimension = station_dimension(stations)
    dense = (
        station_day_calendar(dimension, daily)
        .join(dimension, "station_id", "left")
        .join(only_one(daily, KEYS, "daily"), KEYS, "left")
    )
    return with_calendar_columns(with_labels(dense, labels))


def events_with_weather(events: DataFrame, weather_daily: DataFrame) -> DataFrame:
    """Each event with the weather of its station and day; clashing names get ``_w``."""
    fires = events.withColumns(
        {"station_id": to_code(F.col("station_id"))}
    ).withColumnRenamed("fire_date", "date")
    weather = with_suffix_on_clash(weather_daily, fires.columns, KEYS, "_w")
    return fires.join(weather, KEYS, "left")
