"""Running totals send no key's rows to one task: the bounds of its cells meet it in parts."""

from pyspark.sql import functions as F

from emberday.operators import prefix as P


def test_a_key_is_spread_over_tasks_when_nothing_is_broadcast(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") / 7).alias("v"), F.lit(1).cast("long").alias("n"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        sizes = [r["count"] for r in P._celled(rows, ["k"], "v", "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) <= 10_000


def test_totals_by_key_read_rows_that_were_made_once(spark):
    rows = spark.range(100).select(F.lit("k").alias("k"), F.sqrt("id").alias("v"), F.lit(1).cast("long").alias("n"))
    out = P.running_totals(rows, ["k"], "v", ["n"])
    assert "SQRT(" not in out._jdf.queryExecution().optimizedPlan().toString().upper()
    assert [r.cum_n for r in out.orderBy("v").collect()] == list(range(1, 101))
