"""Cells of running totals follow the data: outliers, crowds and missing stamps leave them even."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberday.operators import prefix as P


def _shapes(n):
    rng = random.Random(6)
    return {
        "even": [float(i) for i in range(n)],
        "two outliers": [float(i) for i in range(n - 2)] + [1e18, -1e18],
        "crowded in one spot": [0.5 + 1e-12 * i for i in range(n - 3)] + [0.0, 1.0, 2.0**60],
        "both ends": [1e-9 * rng.random() for _ in range(n // 2)] + [1 - 1e-9 * rng.random() for _ in range(n // 2)],
        "exponents": [10.0 ** rng.uniform(-300, 300) for _ in range(n)],
    }


def test_fullest_cell_is_near_the_mean_whatever_the_shape(spark):
    n = 40_000
    shapes = _shapes(n)
    rows = [(k, v) for k, values in shapes.items() for v in set(values)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit(1).cast("long"))
    cells = P._celled(df, ["k"], "v", "n").groupBy("k", "_cell").count()
    fullest = {r.k: (r.top, r.mean) for r in cells.groupBy("k").agg(F.max("count").alias("top"), F.avg("count").alias("mean")).collect()}
    assert set(fullest) == set(shapes)
    for k, (top, mean) in fullest.items():
        assert top <= 4 * n / P.CELLS and top <= 4 * mean, k


def test_cells_are_monotone_and_nulls_first(spark):
    values = [None, float("-inf"), -5.0, -5.0, 0.0, 1e-300, 3.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bounds = df.select(P.splitters(F.col("v")).alias("b")).first().b
    got = df.select("v", P.cell_of(F.col("v"), F.array(*[F.lit(b) for b in bounds])).alias("c")).collect()
    assert [r.c for r in got] == sorted(r.c for r in got) and got[0].c == 0
    assert len({r.c for r in got}) >= 6


@pytest.mark.parametrize("keys", [["k"], []])
def test_totals_of_outliers_and_no_rows(spark, keys):
    values = [1.0, 2.0, 3.0, 1e300, -1e300]
    df = spark.createDataFrame([("a", v, 2) for v in values], "k string, v double, n long")
    got = {r.v: (r.cum_n, r.all_n) for r in P.running_totals(df, keys, "v", ["n"]).collect()}
    assert got == {v: (2 * i, 10) for i, v in enumerate(sorted(values), 1)}
    assert P.running_totals(df.limit(0), keys, "v", ["n"]).count() == 0


def test_ids_when_moments_ties_and_copies_crowd(spark):
    t = datetime(2021, 1, 1)
    rows = [(t, 1.0, float(i)) for i in range(3000)] + [(t, 1.0, 7.0)] * 2000 + [(None, 0.0, 0.0)] * 50
    rows += [(t + timedelta(days=30_000 * s), 2.0, 2.0) for s in (-1, 1)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, lon double, lat double").repartition(7)
    got = P.sequential_ids(df, "id", "t", ["lon", "lat"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(len(rows)))
    known = [(r.t, r.lon, r.lat) for r in got if r.t is not None]
    assert known == sorted(known) and all(r.t is None for r in got[len(known) :])


def test_ranges_of_a_crowded_order_are_even(spark):
    t = datetime(2021, 1, 1)
    rows = [(t, 1.0, float(i)) for i in range(20_000)] + [(t + timedelta(days=9000), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, lon double, lat double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in P.ordered_ranges(df, ["t", "lon", "lat"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 4 * sum(sizes) / len(sizes)
