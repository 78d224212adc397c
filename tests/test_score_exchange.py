"""Scores are not exchanged by model, of which there are few."""

import re

from pyspark.sql import functions as F

from emberday.operators.scoring import prediction_table


def test_scores_are_not_dealt_out_by_model(spark):
    scores = spark.range(1000).select(
        F.lit("one").alias("model_name"), F.col("id").alias("station_id"),
        F.lit("2024-01-01").alias("date"), F.lit(0.7).alias("pred_prob"),
    )
    thresholds = spark.createDataFrame([("one", 0.6)], "model_name string, alert_threshold double")
    stations = spark.range(1000).select(
        F.col("id").alias("station_id"), F.lit(1.0).alias("stn_lat"), F.lit(2.0).alias("stn_lon")
    )
    made = prediction_table(scores, thresholds, stations)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(model_name", plan)
    assert made.filter("is_alert = 1 and stn_lon = 2").count() == 1000
