"""Parquet tables, station registry and model metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberday.functions.parsing import to_code, to_number

# The two built-in stations.
DEFAULT_STATIONS = (
    (104, "북강릉", "Bukgangneung", 37.80456, 128.85535),
    (105, "강릉", "Gangneung", 37.75146, 128.89098),
)

MODEL_META_SCHEMA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("trained_at", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("categorical_features", T.ArrayType(T.StringType())),
        T.StructField("excluded_features", T.ArrayType(T.StringType())),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("holdout_days", T.IntegerType()),
        T.StructField("cutoff", T.StringType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("train_positive", T.LongType()),
        T.StructField("test_rows", T.LongType()),
        T.StructField("test_positive", T.LongType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("operating_threshold", T.DoubleType()),
        T.StructField("operating_threshold_policy", T.StringType()),
        T.StructField("operating_threshold_max_far", T.DoubleType()),
        T.StructField("operating_threshold_selected_at", T.StringType()),
        T.StructField("far_threshold", T.DoubleType()),
        T.StructField("holdout_threshold", T.DoubleType()),
    ]
)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if columns is None else table.select(*columns)


def default_stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(DEFAULT_STATIONS),
        "station_id int, name_kr string, name_en string, stn_lat double, stn_lon double",
    )


def stations_from_contract(meta: DataFrame) -> DataFrame:
    """Contract station table (STN_ID, LON, LAT, FCT_ID) under the internal names."""
    return meta.select(
        to_code(F.col("STN_ID")).alias("station_id"),
        to_number(F.col("LAT")).alias("stn_lat"),
        to_number(F.col("LON")).alias("stn_lon"),
        F.col("FCT_ID").cast("string").alias("forecast_region_id"),
    )


def read_model_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_META_SCHEMA).json(path)
