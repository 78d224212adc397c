"""Distributed isotonic regression against Spark's own and against the min-max form."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from emberday.models.calibration import apply_isotonic, fit_isotonic


def _frame(spark, shape, n=3000):
    rng = random.Random(shape)
    score = {
        "rising": lambda i: i / n, "tied": lambda i: (i % 40) / 40, "random": lambda i: rng.random(), "one": lambda i: 0.5,
        "falling": lambda i: i / n,
    }[shape]
    chance = {"rising": lambda s: s, "tied": lambda s: s * s, "random": lambda s: 0.5, "one": lambda s: 0.3, "falling": lambda s: 1 - s}[shape]
    rows = [(s, int(rng.random() < chance(s))) for s in (score(i) for i in range(n))]
    return spark.createDataFrame(rows, "pred_prob double, fire_label int")


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shape", ["rising", "tied", "random", "falling", "one"])
def test_equal_to_the_library(spark, many_ranges, shape):
    df = _frame(spark, shape)
    asked = spark.createDataFrame([(x, 1) for x in [-1.0, 0.0, 0.123456, 0.5, 0.77, 1.0, 9.0, None]], "pred_prob double, k int")
    model = IsotonicRegression(featuresCol="pred_prob", labelCol="fire_label").fit(df.withColumn("fire_label", F.col("fire_label").cast("double")))
    want = sorted((r.pred_prob, r.prediction) for r in model.transform(asked.dropna().union(df.limit(50))).collect())
    got = apply_isotonic(fit_isotonic(df), asked.dropna().union(df.limit(50)).withColumn("x", F.col("pred_prob"))).collect()
    assert np.allclose(sorted((r.x, r.pred_prob) for r in got), want, atol=1e-9)


def test_min_max_form(spark, many_ranges):
    df = _frame(spark, "tied", 600)
    rows = sorted((r.pred_prob, r.p, r.n) for r in df.groupBy("pred_prob").agg(F.sum("fire_label").alias("p"), F.count("*").alias("n")).collect())
    pos, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def mean(j, k):
        return pos[j : k + 1].sum() / n[j : k + 1].sum()

    m = len(rows)
    want = {rows[i][0]: max(min(mean(j, k) for k in range(i, m)) for j in range(i + 1)) for i in range(m)}
    asked = spark.createDataFrame([(r[0], r[0]) for r in rows], "pred_prob double, x double")
    got = {r.x: r.pred_prob for r in apply_isotonic(fit_isotonic(df), asked).collect()}
    assert got == pytest.approx(want)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (0.2, None), (0.4, 1), (float("nan"), 0)], "pred_prob double, fire_label int")
    out = sorted((r.pred_prob for r in apply_isotonic(fit_isotonic(df), df).collect()), key=str)
    assert out.count(None) == 1 and out.count(1.0) == 3
    assert apply_isotonic(fit_isotonic(df.limit(0)), df).where("pred_prob is not null").count() == 0
