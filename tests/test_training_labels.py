"""The labels the model queries learn from have two classes on a table with many rows a day."""

from pyspark.sql import functions as F

from catalog.standins import flag_labels, flag_share_labels


def _items(spark, folder, per_day):
    """Ten days of two flags; on odd days every tenth item is large and discounted, else every twentieth."""
    spark.range(10 * 2 * per_day).select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("R").alias("l_returnflag"),
        F.date_add(F.lit("2001-01-01").cast("date"), ((F.col("id") / 2).cast("int") % 10)).cast("timestamp_ntz").alias("l_shipdate"),
        (F.col("id") / 20).cast("int").alias("n"),
        ((F.col("id") / 2).cast("int") % 2).alias("odd"),
    ).select(
        "l_returnflag", "l_shipdate", F.when(F.col("n") % (20 - 10 * F.col("odd")) == 0, 50.0).otherwise(1.0).alias("l_quantity"),
        F.lit(0.1).alias("l_discount"),
    ).write.parquet(f"{folder}/lineitem.parquet")


def test_crowded_days_keep_two_classes(spark, tmp_path):
    _items(spark, tmp_path, 100)
    assert flag_labels(spark, tmp_path).count() == 20  # every day of both flags
    found = {(r.station_id, r.date.day) for r in flag_share_labels(spark, tmp_path).collect()}
    assert found == {(s, d) for s in (65, 82) for d in (2, 4, 6, 8, 10)}


def test_sparse_days_keep_their_labels(spark, rows, tmp_path):
    spark.range(200).select(
        F.lit("A").alias("l_returnflag"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 20).cast("int")).cast("timestamp_ntz").alias("l_shipdate"),
        F.when(F.col("id").isin(3, 4, 24, 105), 50.0).otherwise(1.0).alias("l_quantity"),
        F.lit(0.1).alias("l_discount"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    old = rows(flag_labels(spark, tmp_path), "station_id", "date")
    assert len(old) == 3
    assert rows(flag_share_labels(spark, tmp_path), "station_id", "date") == old
