"""Writers: tables, predictions, metadata and the snapshot switch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberday.functions.calendar import with_calendar_columns

PREDICTION_FORMATS = ("parquet", "csv")


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_base(df: DataFrame, path: str) -> None:
    """Base or feature table, one folder per year so that a day reads one year.

    Rows are spread by year and a hash of the station, since one year can be most of
    the table.
    """
    (
        df.withColumn("year", F.year("date"))
        .repartition("year", F.pmod(F.xxhash64("station_id"), F.lit(64)))
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; ``mark`` puts the UTF-8 byte order mark in front of it, for spreadsheets."""
    if mark and df.columns:
        df = df.toDF(f"\ufeff{df.columns[0]}", *df.columns[1:])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, folder: str, fmt: str = "parquet") -> str:
    """Prediction table under ``folder``, one sub-folder per date and model.

    Only the (date, model) folders present in ``df`` are replaced.
    """
    if fmt not in PREDICTION_FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; use one of {PREDICTION_FORMATS}")
    path = f"{folder}/{fmt}"
    writer = (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "model_name")
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def operating_threshold_update(
    meta: DataFrame, thresholds: DataFrame, max_far: float
) -> DataFrame:
    """Metadata with the false-alarm-limited threshold of ``thresholds`` filled in.

    ``thresholds`` has model_name and recall_at_far_threshold; models without one keep
    their record as it is. Write the result to a new path.
    """
    found = thresholds.select("model_name", F.col("recall_at_far_threshold").alias("_found"))
    joined = meta.join(found, "model_name", "left")
    changed = F.col("_found").isNotNull()
    values = {
        "operating_threshold": F.col("_found"),
        "operating_threshold_policy": F.lit("recall_at_far"),
        "operating_threshold_max_far": F.lit(float(max_far)),
        "operating_threshold_selected_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    }
    return joined.withColumns(
        {c: F.when(changed, v).otherwise(F.col(c)) for c, v in values.items()}
    ).select(*meta.columns)


def adopt_base_snapshot(
    spark: SparkSession, source_path: str, versions_folder: str, version: str
) -> str:
    """Write another base table as a new version; earlier versions stay as backups.

    Nothing that is being read is ever overwritten. Returns the path of the new version.
    """
    target = f"{versions_folder}/version={version}"
    snapshot = with_calendar_columns(spark.read.parquet(source_path))
    if "year" in snapshot.columns:
        snapshot = snapshot.drop("year")
    snapshot = snapshot.withColumn("year", F.year("date"))
    snapshot.repartition("year", F.pmod(F.xxhash64("station_id"), F.lit(64))).write.mode(
        "errorifexists"
    ).partitionBy("year").parquet(target)
    return target
