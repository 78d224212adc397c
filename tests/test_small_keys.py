"""Keys with few values are not cut into cells, and label counts that two steps read are made once."""

from pyspark.sql import functions as F

from emberday.operators import prefix as P
from emberday.operators.metrics import recommended_thresholds


def _numbers(spark):
    """A key of 10,000 values and one of 1,000, all once."""
    ids = spark.range(11_000)
    return ids.select((F.col("id") < 10_000).cast("int").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("n"))


def test_small_key_is_one_cell(spark):
    cells = P._celled(_numbers(spark), ["k"], "v", "n").groupBy("k").agg(F.countDistinct("_cell").alias("c")).collect()
    found = {r.k: r.c for r in cells}
    assert found[0] == 1 and found[1] > 400


def test_running_sums_of_small_and_large_keys(spark):
    out = P.running_totals(_numbers(spark), ["k"], "v", ["n"])
    assert out.count() == 11_000
    wrong = out.filter(F.col("cum_n") != F.when(F.col("k") == 1, F.col("v") + 1).otherwise(F.col("v") - 9_999))
    assert wrong.count() == 0


def test_recommended_thresholds_read_written_counts(spark):
    scored = spark.range(100).selectExpr("'m' AS model_name", "cast(id % 2 AS int) AS fire_label", "sqrt(id / 100D) AS pred_prob")
    found = recommended_thresholds(scored, ["model_name"])
    assert "SQRT(" not in found._jdf.queryExecution().optimizedPlan().toString().upper()
    assert found.count() >= 1
