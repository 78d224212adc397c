"""Train-and-evaluate jobs."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberday.models.calibration import apply_isotonic, apply_platt, fit_isotonic, fit_platt
from emberday.models.classifiers import (
    FeatureSet,
    Fit,
    SequenceFit,
    fit_boosted,
    fit_logistic,
    fit_sequence,
    score,
    score_model,
    score_sequence,
    training_frame,
    wide_feature_set,
)
from emberday.operators.features import CURRENT_DAY
from emberday.operators.metrics import calibration_bins, classification_metrics
from emberday.operators.scoring import SEQUENCE_MODEL
from emberday.operators.selection import rank_calibrations
from emberday.operators.sequences import CHANNELS, SCALE_FIELDS, STATIC_CHANNELS
from emberday.operators.splits import (
    DEFAULT_CALIBRATION_DAYS,
    DEFAULT_HOLDOUT_DAYS,
    LABEL,
    require_two_classes,
    split_summary,
    three_way_split,
    time_split,
    yearly_folds,
)
from emberday.session import written
from emberday.sources.tables import MODEL_META_SCHEMA, read_model_meta

_SCALE_SCHEMA = ", ".join(f"{name} array<double>" for name in SCALE_FIELDS)
FITTERS = {"logistic": fit_logistic, "boosted": fit_boosted}


def split_part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name).drop("split")


def fit_model(train: DataFrame, kind: str, features: FeatureSet, **params) -> Fit:
    if kind not in FITTERS:
        raise ValueError(f"unknown model kind {kind!r}; use one of {sorted(FITTERS)}")
    return FITTERS[kind](train, features, **params)


def holdout_predictions(
    table: DataFrame,
    kind: str,
    model_name: str,
    features: FeatureSet | None = None,
    holdout_days: int = DEFAULT_HOLDOUT_DAYS,
    split: DataFrame | None = None,
    **params,
) -> tuple[Fit, DataFrame, DataFrame]:
    """Fit on all but the holdout and score the holdout.

    Returns the fit, (model_name, station_id, date, fire_label, pred_prob) and the
    split summary. The split table is cut from its history first, since the fit reads
    it many times.
    """
    features = features or wide_feature_set()
    if split is None:
        split = time_split(training_frame(table, features), holdout_days)
    split = written(split, "split")
    summary = split_summary(split)
    require_two_classes(summary)
    fit = fit_model(split_part(split, "train"), kind, features, **params)
    scored = score(fit, split_part(split, "test"), model_name, keep=[LABEL])
    return fit, scored.withColumn(LABEL, F.col(LABEL).cast("int")), summary


def sequence_holdout(
    samples: DataFrame, holdout_days: int = DEFAULT_HOLDOUT_DAYS, **params
) -> tuple[SequenceFit, DataFrame, DataFrame]:
    """Fit the sequence classifier on all but the holdout and score the holdout.

    Returns the fit, (model_name, station_id, date, fire_label, pred_prob) and the
    split summary.
    """
    split = written(time_split(samples, holdout_days), "samples")
    summary = split_summary(split)
    require_two_classes(summary)
    fit = fit_sequence(split_part(split, "train"), **params)
    return fit, score_sequence(fit, split_part(split, "test"), keep=[LABEL]), summary


def model_record(
    spark: SparkSession, fit: Fit | SequenceFit, model_name: str, summary: DataFrame,
    metrics: DataFrame, holdout_days: int,
) -> DataFrame:
    """One-row metadata table of a trained model."""
    parts = {r.split: r for r in summary.collect()}
    measured = metrics.first()
    sequence = isinstance(fit, SequenceFit)
    wanted = ("roc_auc", "pr_auc", "brier", "log_loss", "precision", "recall", "f1")
    row = {
        "model_name": model_name,
        "model_type": fit.kind,
        "trained_at": datetime.now().isoformat(timespec="seconds"),
        "label": LABEL,
        "features": [*CHANNELS, *STATIC_CHANNELS] if sequence else fit.features.all,
        "categorical_features": [] if sequence else list(fit.features.categorical),
        "excluded_features": list(CURRENT_DAY),
        "params": {k: str(v) for k, v in fit.params.items()},
        "holdout_days": holdout_days,
        "cutoff": str(parts["test"].start_date),
        "train_rows": parts["train"].rows,
        "train_positive": parts["train"].positive,
        "test_rows": parts["test"].rows,
        "test_positive": parts["test"].positive,
        "metrics": {m: measured[m] for m in wanted if measured[m] is not None},
        "operating_threshold": None,
        "operating_threshold_policy": None,
        "operating_threshold_max_far": None,
        "operating_threshold_selected_at": None,
        "far_threshold": measured.recall_at_far_threshold,
        "holdout_threshold": measured.threshold,
    }
    return spark.createDataFrame([row], MODEL_META_SCHEMA)


def train_and_save(
    spark: SparkSession,
    table: DataFrame,
    kind: str,
    model_name: str,
    folder: str,
    features: FeatureSet | None = None,
    holdout_days: int = DEFAULT_HOLDOUT_DAYS,
    threshold: float = 0.5,
    **params,
) -> DataFrame:
    """Fit, evaluate and store a model with its metadata; returns the metadata row."""
    fit, scored, summary = holdout_predictions(
        table, kind, model_name, features, holdout_days, **params
    )
    metrics = classification_metrics(scored, [], threshold)
    record = model_record(spark, fit, model_name, summary, metrics, holdout_days)
    fit.model.write().overwrite().save(f"{folder}/{model_name}/model")
    record.coalesce(1).write.mode("overwrite").json(f"{folder}/{model_name}/meta")
    return record


def train_and_save_sequence(
    spark: SparkSession,
    samples: DataFrame,
    folder: str,
    model_name: str = SEQUENCE_MODEL,
    holdout_days: int = DEFAULT_HOLDOUT_DAYS,
    threshold: float = 0.5,
    **params,
) -> DataFrame:
    """As ``train_and_save`` for the sequence classifier; channel scales are stored too."""
    fit, scored, summary = sequence_holdout(samples, holdout_days, **params)
    metrics = classification_metrics(scored, [], threshold)
    record = model_record(spark, fit, model_name, summary, metrics, holdout_days)
    fit.model.write().overwrite().save(f"{folder}/{model_name}/model")
    scale = spark.createDataFrame([fit.scale], _SCALE_SCHEMA)
    scale.coalesce(1).write.mode("overwrite").json(f"{folder}/{model_name}/scale")
    record.coalesce(1).write.mode("overwrite").json(f"{folder}/{model_name}/meta")
    return record


def load_sequence(
    spark: SparkSession, folder: str, model_name: str = SEQUENCE_MODEL
) -> tuple[SequenceFit, DataFrame]:
    meta = read_model_meta(spark, f"{folder}/{model_name}/meta")
    scale = spark.read.schema(_SCALE_SCHEMA).json(f"{folder}/{model_name}/scale").first()
    model = PipelineModel.load(f"{folder}/{model_name}/model")
    return SequenceFit(model, {k: list(v) for k, v in scale.asDict().items()}), meta


def evaluate_saved_sequence(
    spark: SparkSession, folder: str, samples: DataFrame, model_name: str = SEQUENCE_MODEL,
    holdout_days: int | None = None, **limits,
) -> DataFrame:
    """Metrics of the stored sequence classifier on its recorded holdout or another one."""
    fit, meta = load_sequence(spark, folder, model_name)
    days = meta.first().holdout_days if holdout_days is None else holdout_days
    test = split_part(time_split(samples, days), "test")
    return classification_metrics(
        score_sequence(fit, test, model_name, [LABEL]), ["model_name"], **limits
    )


def load_fit(spark: SparkSession, folder: str, model_name: str) -> tuple[Fit, DataFrame]:
    meta = read_model_meta(spark, f"{folder}/{model_name}/meta")
    row = meta.first()
    categorical = tuple(row.categorical_features)
    numeric = tuple(c for c in row.features if c not in categorical)
    model = PipelineModel.load(f"{folder}/{model_name}/model")
    return Fit(model, row.model_type, FeatureSet(numeric, categorical), dict(row.params)), meta


def evaluate_saved(
    spark: SparkSession, folder: str, model_name: str, table: DataFrame,
    holdout_days: int | None = None, **limits,
) -> DataFrame:
    """Metrics of a stored model on its recorded holdout, or on another one if given."""
    fit, meta = load_fit(spark, folder, model_name)
    days = meta.first().holdout_days if holdout_days is None else holdout_days
    split = time_split(training_frame(table, fit.features), days)
    scored = score_model(
        fit.model, split_part(split, "test"), fit.features, model_name, [LABEL],
        fill=fit.kind == "boosted",
    )
    return classification_metrics(scored, ["model_name"], **limits)


def calibration_study(
    table: DataFrame,
    kind: str = "boosted",
    features: FeatureSet | None = None,
    holdout_days: int = 365,
    calibration_days: int = DEFAULT_CALIBRATION_DAYS,
    threshold: float = 0.5,
    **params,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw against Platt and isotonic scores on one test period.

    Returns (ranked metrics, calibration bins, test predictions), each keyed by method.
    """
    features = features or wide_feature_set()
    split = written(
        three_way_split(training_frame(table, features), holdout_days, calibration_days), "split"
    )
    require_two_classes(split_summary(split), ("train", "calibration", "test"))
    fit = fit_model(split_part(split, "train"), kind, features, **params)
    scored = {
        part: written(score(fit, split_part(split, part), part, keep=[LABEL]), part)
        for part in ("calibration", "test")
    }
    calibration, test = scored["calibration"], scored["test"].drop("model_name")
    methods = {
        "base": test,
        "platt": apply_platt(fit_platt(calibration), test),
        "isotonic": apply_isotonic(fit_isotonic(calibration), test),
    }
    predictions = reduce(
        DataFrame.unionByName,
        [df.withColumn("method", F.lit(name)) for name, df in methods.items()],
    )
    metrics = rank_calibrations(classification_metrics(predictions, ["method"], threshold))
    return metrics, calibration_bins(predictions), predictions


def rolling_backtest(
    table: DataFrame,
    kind: str = "boosted",
    features: FeatureSet | None = None,
    start_year: int | None = 2020,
    end_year: int | None = 2021,
    min_train_rows: int = 365,
    **params,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One fit per eligible year on everything before it.

    Returns (fold table with metrics, station-year metrics, predictions). The loop is
    over the years; each fit and each scoring is a distributed job.
    """
    features = features or wide_feature_set()
    data = written(training_frame(table, features), "backtest")
    folds = yearly_folds(data, start_year, end_year, min_train_rows)
    years = [
        r.test_year
        for r in folds.filter(F.col("eligible") == 1).orderBy("test_year").collect()
    ]
    if not years:
        raise ValueError("years in range all lack rows or one of the two labels")
    year = F.year(F.col("date").cast("date"))
    predictions = []
    for y in years:
        fit = fit_model(data.filter(year < y), kind, features, **params)
        scored = score(fit, data.filter(year == y), "backtest", keep=[LABEL])
        predictions.append(scored.withColumn("test_year", F.lit(y)))
    pooled = reduce(DataFrame.unionByName, predictions)
    by_year = classification_metrics(pooled, ["test_year"])
    measures = [c for c in by_year.columns if c not in ("rows", "positive")]
    fold_table = folds.filter(F.col("eligible") == 1).join(by_year.select(*measures), "test_year")
    by_station = classification_metrics(pooled, ["test_year", "station_id"]).filter(
        (F.col("positive") > 0) & (F.col("positive") < F.col("rows"))
    )
    return fold_table, by_station, pooled
