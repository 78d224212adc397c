"""Fits of the classifiers; every fit returns a PipelineModel that scores raw feature rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberday.models.boosting import best_round, first_rounds
from emberday.models.preprocess import (
    balanced_weight,
    linear_stages,
    ordered_features,
    tree_stages,
    typed_inputs,
)
from emberday.operators.features import categorical_names, feature_names
from emberday.operators.sequences import fit_scale, flattened, standardised
from emberday.operators.splits import LABEL, class_weights, holdout_cutoff
from emberday.session import release, written

# Inputs of the older daily models.
DAILY_FEATURES = ("TA", "POP", "is_precip", "WD_sin", "WD_cos", "SKY")
DAILY_FILE_FEATURES = ("TA", "TMN", "TMX", "RN", "DTR")


@dataclass(frozen=True)
class FeatureSet:
    """Numeric and categorical input columns of a model."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def wide_feature_set() -> FeatureSet:
    categorical = categorical_names()
    return FeatureSet(
        tuple(c for c in feature_names() if c not in categorical), tuple(categorical)
    )


@dataclass
class Fit:
    """A fitted model with what is worth recording about it."""

    model: PipelineModel
    kind: str
    features: FeatureSet
    params: dict = field(default_factory=dict)


def training_frame(df: DataFrame, features: FeatureSet, label: str = LABEL) -> DataFrame:
    """Rows with date and label, inputs present by name, label as 0/1 double."""
    missing = sorted({*features.all, label, "date"} - set(df.columns))
    if missing:
        raise KeyError(f"training table lacks the columns {missing}")
    return df.withColumn(label, F.col(label).cast("double")).dropna(subset=["date", label])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def _class_counts(train: DataFrame, label: str) -> tuple[int, int, float]:
    row = class_weights(train, label).first()
    if not row.rows or row.positive in (None, 0, row.rows):
        raise ValueError("training labels have only one class")
    return row.rows, row.positive, row.scale_pos_weight


def fit_logistic(
    train: DataFrame, features: FeatureSet, label: str = LABEL, max_iter: int = 1000
) -> Fit:
    """Balanced logistic regression, L2 with unit strength on the summed loss.

    Balanced weights add up to the row count and the loss is divided by their sum, so
    1/rows here equals a unit penalty on the sum.
    """
    data = typed_inputs(train, features.numeric, features.categorical, fill=False)
    rows, positive, _ = _class_counts(data, label)
    stages = linear_stages(data, features.numeric, features.categorical)
    ready = written(
        stages.transform(data).select(
            label, "features", balanced_weight(F.col(label), rows, positive).alias("weight")
        ),
        "fit",
    )
    try:
        fitted = LogisticRegression(
            featuresCol="features",
            labelCol=label,
            weightCol="weight",
            regParam=1.0 / rows,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
        ).fit(ready)
    finally:
        release(ready)
    params = {"class_weight": "balanced", "max_iter": max_iter, "reg_param": 1.0 / rows}
    return Fit(PipelineModel([*stages.stages, fitted]), "logistic", features, params)


def fit_boosted(
    train: DataFrame,
    features: FeatureSet,
    label: str = LABEL,
    rounds: int = 500,
    depth: int = 6,
    rate: float = 0.05,
    balanced: bool = False,
    validation_days: int | None = None,
    seed: int = 42,
) -> Fit:
    """Gradient-boosted trees; positives weigh negatives/positives, or balanced weights.

    With ``validation_days`` the last days of ``train`` are held back, the fit on the days
    before is scored after every round on them, and the rounds beyond the one with the best
    average precision are cut off. Categories in ``TARGET_ENCODED`` are label means; a training
    row only sees the labels of earlier days there.
    """
    data = typed_inputs(train, features.numeric, features.categorical, fill=True)
    late = None
    if validation_days is not None:
        cutoff = holdout_cutoff(data, validation_days)
        data, late = data.filter(F.col("date") < cutoff), data.filter(F.col("date") >= cutoff)
    stages, bins = tree_stages(data, features.numeric, features.categorical, label)
    ready = written(ordered_features(stages, data, features.categorical, label).select(label, "features"), "fit")
    best = rounds
    try:
        fitted = _boost(ready, label, rounds, depth, rate, bins, balanced, seed)
        if late is not None:
            best = best_round(fitted, stages.transform(late), label)
            fitted = first_rounds(fitted, best)
    finally:
        release(ready)
    params = {
        "rounds": best, "max_rounds": rounds, "depth": depth, "rate": rate,
        "balanced": balanced, "seed": seed,
    }
    return Fit(PipelineModel([*stages.stages, fitted]), "boosted", features, params)


def _boost(ready, label, rounds, depth, rate, bins, balanced, seed) -> GBTClassificationModel:
    rows, positive, ratio = _class_counts(ready, label)
    weight = (
        balanced_weight(F.col(label), rows, positive)
        if balanced
        else F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0))
    )
    return GBTClassifier(
        featuresCol="features",
        labelCol=label,
        weightCol="weight",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        maxBins=bins,
        seed=seed,
        cacheNodeIds=False,
    ).fit(ready.withColumn("weight", weight))


def score(fit: Fit, df: DataFrame, model_name: str, keep: Sequence[str] = ()) -> DataFrame:
    """(model_name, station_id, date, pred_prob) plus ``keep``, one narrow pass."""
    return score_model(fit.model, df, fit.features, model_name, keep, fill=fit.kind == "boosted")


def score_model(
    model: PipelineModel,
    df: DataFrame,
    features: FeatureSet,
    model_name: str,
    keep: Sequence[str] = (),
    fill: bool = False,
) -> DataFrame:
    kept = [c for c in ("station_id", "date", *keep) if c in df.columns]
    held = df.withColumns({f"_k_{c}": F.col(c) for c in kept})
    typed = typed_inputs(held, features.numeric, features.categorical, fill=fill)
    return model.transform(typed).select(
        F.lit(model_name).alias("model_name"),
        *[F.col(f"_k_{c}").alias(c) for c in kept],
        vector_to_array("probability")[1].alias("pred_prob"),
    )


def coefficients(fit: Fit) -> list[tuple[str, float]]:
    """Numeric inputs of a logistic fit with their weights, largest magnitude first."""
    weights = fit.model.stages[-1].coefficients.toArray()
    return sorted(zip(fit.features.numeric, map(float, weights)), key=lambda x: -abs(x[1]))


@dataclass
class SequenceFit:
    """Sequence classifier: channel scales of the training rows and the fitted weights."""

    model: PipelineModel
    scale: dict[str, list[float]]
    params: dict = field(default_factory=dict)
    kind: str = "sequence"


def _sequence_vectors(samples: DataFrame, scale: dict[str, list[float]]) -> DataFrame:
    flat = flattened(standardised(samples, scale))
    return flat.withColumn(
        "features", array_to_vector(F.transform("x_flat", lambda v: v.cast("double")))
    )


def fit_sequence(train: DataFrame, label: str = LABEL, max_iter: int = 1000) -> SequenceFit:
    """Balanced logistic regression on the standardised, flattened 14-day histories."""
    scale = {f: list(v) for f, v in fit_scale(train).first().asDict().items()}
    rows, positive, _ = _class_counts(train, label)
    ready = written(
        _sequence_vectors(train, scale).select(
            F.col(label).cast("double").alias(label),
            "features",
            balanced_weight(F.col(label), rows, positive).alias("weight"),
        ),
        "fit",
    )
    try:
        fitted = LogisticRegression(
            labelCol=label, weightCol="weight", regParam=1.0 / rows,
            elasticNetParam=0.0, standardization=False, maxIter=max_iter,
        ).fit(ready)
    finally:
        release(ready)
    params = {"class_weight": "balanced", "max_iter": max_iter, "reg_param": 1.0 / rows}
    return SequenceFit(PipelineModel([fitted]), scale, params)


def score_sequence(
    fit: SequenceFit, samples: DataFrame, model_name: str = "sequence", keep: Sequence[str] = ()
) -> DataFrame:
    return fit.model.transform(_sequence_vectors(samples, fit.scale)).select(
        F.lit(model_name).alias("model_name"),
        "station_id",
        "date",
        *keep,
        vector_to_array("probability")[1].alias("pred_prob"),
    )
