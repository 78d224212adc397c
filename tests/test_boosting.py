"""The best round from one pass, cut models, and label means without the row's own label."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from emberday.models import boosting as B
from emberday.models.classifiers import FeatureSet, fit_boosted
from emberday.models.preprocess import ordered_features, ordered_statistic, tree_stages, typed_inputs


@pytest.fixture(scope="module")
def fitted(spark):
    """A short forest with splits by number and by category, and its rows."""
    rng = np.random.default_rng(8)
    rows = [
        (float(y), float(a + y), float(b), f"c{c}")
        for y, a, b, c in zip(rng.random(600) < 0.3, rng.normal(size=600), rng.normal(size=600), rng.integers(0, 5, 600))
    ]
    df = spark.createDataFrame(rows, "fire_label double, a double, b double, c string")
    df = StringIndexer(inputCol="c", outputCol="ci").fit(df).transform(df)
    df = VectorAssembler(inputCols=["a", "b", "ci"], outputCol="features").transform(df).cache()
    model = GBTClassifier(labelCol="fire_label", maxIter=12, maxDepth=3, stepSize=0.3, seed=1).fit(df)
    return model, df


def average_precision(y, p):
    """Step sum over distinct scores, straight from its definition."""
    total = 0.0
    for s in sorted(set(p), reverse=True):
        hit = [t for t, q in zip(y, p) if q >= s]
        total += sum(t for t, q in zip(y, p) if q == s) * sum(hit) / len(hit)
    return total / sum(y)


def test_margins_and_cut_models_equal_the_library(spark, fitted):
    model, df = fitted
    forest = B.forest_of(model, spark)
    assert (forest.category_row >= 0).any()
    rows = df.select("features").collect()
    margins = forest.margins(np.array([r.features.toArray() for r in rows]))
    for rounds in (1, 5, 12):
        short = B.first_rounds(model, rounds)
        assert short.getNumTrees == rounds and short.getStepSize() == model.getStepSize()
        raw = [r.rawPrediction[1] for r in short.transform(df).collect()]
        assert np.allclose(margins[:, rounds - 1], raw, atol=1e-12)


def test_best_round_equals_a_direct_computation(spark, fitted, monkeypatch):
    model, df = fitted
    monkeypatch.setattr(B, "_CELLS", 500)  # several slices a batch
    validation = df.where(F.col("b") > 0)
    y = [r.fire_label for r in validation.collect()]
    direct = {}
    for rounds in range(1, 13):
        scored = B.first_rounds(model, rounds).transform(validation).collect()
        direct[rounds] = average_precision(y, [round(r.probability[1] * B.SCORE_STEPS) for r in scored])
    counts = B.round_counts(B.forest_of(model, spark), validation, "fire_label")
    found = {r.rounds: r.pr_auc for r in B.round_precision(counts).collect()}
    assert found == pytest.approx(direct)
    assert B.best_round(model, validation, "fire_label") == min(direct, key=lambda k: (-round(direct[k], 12), k))
    assert B.best_round(model, validation.where("fire_label = 0"), "fire_label") == 12
    assert B.best_round(model, validation.limit(0), "fire_label") == 12


def _noise(spark):
    """Labels that hang on nothing; every station has few rows."""
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", day, int(rng.random() < 0.3)) for k in range(150) for day in range(8)]
    df = spark.createDataFrame(rows, "station_id string, day int, fire_label int")
    return df.select("station_id", F.date_add(F.lit("2020-01-01").cast("date"), "day").alias("date"), "fire_label", F.lit(0.0).alias("TA"))


def test_statistic_of_earlier_days(spark):
    rows = [("a", 1, 1), ("a", 1, 0), ("a", 2, 1), ("a", 4, 0), ("b", 2, 1), (None, 1, 0), (None, 3, 1)]
    df = spark.createDataFrame(rows, "c string, date int, y int")
    got = {(r.c, r.date): r.t for r in ordered_statistic(df, "c", "y", "t").collect()}
    prior = 4 / 7
    assert got == pytest.approx(
        {
            ("a", 1): prior, ("a", 2): (1 + prior) / 3, ("a", 4): (2 + prior) / 4, ("b", 2): prior,
            (None, 1): prior, (None, 3): prior / 2,
        }
    )
    assert ordered_statistic(df, "c", "y", "t").count() == len(rows)


def _gain(model, rows):
    """How well a fit ranks the rows it was fitted on."""
    scored = [(r.fire_label, r.probability[1]) for r in model.transform(rows).collect()]
    hits, misses = [p for y, p in scored if y], [p for y, p in scored if not y]
    return np.mean([(p > q) + 0.5 * (p == q) for p in hits for q in misses])


def test_a_noise_only_station_gives_no_training_gain(spark):
    data = typed_inputs(_noise(spark), ["TA"], ["station_id"], fill=True)
    stages, bins = tree_stages(data, ["TA"], ["station_id"], "fire_label")

    def gain(rows):
        fit = GBTClassifier(labelCol="fire_label", maxIter=3, maxDepth=2, stepSize=0.3, maxBins=bins, seed=1).fit(rows)
        return _gain(fit, rows)

    # the encoder calls its output a category, which no tree could split by
    encoded = PipelineModel(stages.stages[:-1]).transform(data)
    encoded = encoded.withColumn("station_id__t", F.col("station_id__t").alias("station_id__t", metadata={}))
    own = gain(stages.stages[-1].transform(encoded))
    earlier = gain(ordered_features(stages, data, ["station_id"], "fire_label"))
    assert own > 0.65 and earlier < 0.58


def test_validation_days_cut_the_model(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{k % 5}", d, int(x > 0.8), float(x + rng.normal() * 0.3)) for d in range(60) for k, x in enumerate(rng.random(10))]
    df = spark.createDataFrame(rows, "station_id string, day int, fire_label int, TA double")
    df = df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "day"))
    fit = fit_boosted(df, FeatureSet(("TA",), ("station_id",)), rounds=6, depth=2, validation_days=15)
    assert fit.model.stages[-1].getNumTrees == fit.params["rounds"] <= 6
