"""Raw tables to the base table, the feature table and the sequence samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberday.functions.parsing import (
    clean_code,
    clean_measure,
    parse_obs_timestamp,
    pick_column,
    to_code,
)
from emberday.functions.weather import precip_flag, sky_code, wind_cos, wind_sin
from emberday.operators.base import fire_labels, station_day_base
from emberday.operators.daily import daily_base
from emberday.operators.features import wide_features
from emberday.operators.forecast import before_target_day, daily_forecast, normalise_forecast
from emberday.operators.hourly import HOURLY_COLUMNS
from emberday.operators.quality import require_valid_base
from emberday.operators.sequences import sequence_samples
from emberday.sources.csv_files import read_hourly_folder
from emberday.sources.sinks import adopt_base_snapshot, write_base, write_json
from emberday.sources.tables import default_stations, stations_from_contract

# Default code sets of observed weather that count as rain or snow; callers pass the
# sets of their own code tables.
WET_CODES: dict[str, tuple[int, ...]] = {"IR": (), "WW": (), "WP": ()}


def contract_hourly(
    observations: DataFrame,
    wind_points: int = 36,
    wet_codes: dict[str, tuple[int, ...]] = WET_CODES,
) -> DataFrame:
    """Contract observations (STN, TM, TA, WD, RN, ...) to hourly rows.

    Sky is taken from the cloud amount here; POP comes with the forecast.
    """

    def measure(name: str):
        actual = pick_column(observations.columns, [name])
        return F.lit(None).cast("double") if actual is None else clean_measure(F.col(actual))

    wind = measure("WD")
    weather = [(measure(c), codes) for c, codes in wet_codes.items() if codes]
    typed = observations.select(
        to_code(F.col("STN")).alias("station_id"),
        parse_obs_timestamp(F.col("TM")).alias("obs_ts"),
        measure("TA").alias("TA"),
        F.lit(None).cast("double").alias("POP"),
        precip_flag(measure("RN"), None, weather).cast("double").alias("is_precip"),
        wind_sin(wind, wind_points).alias("WD_sin"),
        wind_cos(wind, wind_points).alias("WD_cos"),
        sky_code(F.lit(None).cast("string"), measure("CA_TOT")).alias("SKY"),
    )
    return (
        typed.filter(F.col("station_id").isNotNull() & F.col("obs_ts").isNotNull())
        .withColumns({"date": F.to_date("obs_ts"), "hour": F.hour("obs_ts")})
        .select(*HOURLY_COLUMNS)
    )


def contract_daily(
    stations: DataFrame, observations: DataFrame, forecast: DataFrame, training: bool = True, **options
) -> DataFrame:
    """Daily rows with POP and sky of the newest forecast of the station's region.

    ``training`` drops forecasts issued on or after the day they are for.
    """
    hourly = contract_hourly(observations, **options).join(
        stations.select("station_id"), "station_id", "left_semi"
    )
    regions = stations.select("station_id", "forecast_region_id")
    cutoff = before_target_day() if training else None
    expected = daily_forecast(normalise_forecast(forecast), cutoff)
    daily = daily_base(hourly).join(regions, "station_id", "left").withColumnsRenamed(
        {"POP_day": "_pop", "SKY_day": "_sky", "is_precip_day": "_precip"}
    )
    joined = daily.join(expected, ["forecast_region_id", "date"], "left")
    wet = precip_flag(F.col("_precip"), F.col("forecast_precip_code"))
    return joined.select(
        "station_id",
        "date",
        "TA_day",
        "POP_day",
        "WD_sin_day",
        "WD_cos_day",
        "TA_dtr_day",
        wet.cast("int").alias("is_precip_day"),
        F.coalesce(clean_code(F.col("SKY_forecast")), F.col("_sky")).alias("SKY_day"),
        "obs_cnt_sel",
        "has_00_obs",
        "has_12_obs",
    )


def contract_base(
    station_meta: DataFrame, observations: DataFrame, forecast: DataFrame, labels: DataFrame, **options
) -> DataFrame:
    """The base table from the four contract tables."""
    stations = stations_from_contract(station_meta)
    daily = contract_daily(stations, observations, forecast, **options)
    return station_day_base(daily, stations, fire_labels(labels))


def prepared_base(hourly: DataFrame, events: DataFrame, stations: DataFrame) -> DataFrame:
    """The base table from prepared hourly rows, an event table and a station registry."""
    known = hourly.join(stations.select("station_id"), "station_id", "left_semi")
    return station_day_base(daily_base(known), stations, fire_labels(events))


def build_datasets(
    spark: SparkSession,
    weather_folder: str,
    events_path: str,
    output_folder: str,
    stations: DataFrame | None = None,
) -> DataFrame:
    """Base, feature and sequence tables as parquet; returns the summary table.

    The base table is written once and both derived tables start from the files.
    """
    registry = default_stations(spark) if stations is None else stations
    base = prepared_base(
        read_hourly_folder(spark, weather_folder), spark.read.parquet(events_path), registry
    )
    base_path = f"{output_folder}/station_day_base"
    write_base(base, base_path)
    require_valid_base(spark.read.parquet(base_path))
    return build_derived(spark, base_path, output_folder)


def build_derived(spark: SparkSession, base_path: str, output_folder: str) -> DataFrame:
    base = spark.read.parquet(base_path).drop("year")
    write_base(wide_features(base), f"{output_folder}/wide_features")
    write_base(sequence_samples(base), f"{output_folder}/sequence_samples")
    summary = dataset_summary(
        base,
        spark.read.parquet(f"{output_folder}/wide_features"),
        spark.read.parquet(f"{output_folder}/sequence_samples"),
    )
    write_json(summary.coalesce(1), f"{output_folder}/summary")
    return summary


def dataset_summary(base: DataFrame, wide: DataFrame, samples: DataFrame) -> DataFrame:
    """(table, rows, positive) of the three tables."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.col("fire_label").cast("long")), F.lit(0)).alias("positive"),
        ).select(F.lit(name).alias("table"), "rows", "positive")

    return (
        counted(base, "station_day_base")
        .unionByName(counted(wide, "wide_features"))
        .unionByName(counted(samples, "sequence_samples"))
    )


def adopt_snapshot(
    spark: SparkSession, source_path: str, versions_folder: str, version: str
) -> DataFrame:
    """Take another base table into use as a new version and rebuild what derives from it."""
    target = adopt_base_snapshot(spark, source_path, f"{versions_folder}/base", version)
    return build_derived(spark, target, f"{versions_folder}/derived/version={version}")
