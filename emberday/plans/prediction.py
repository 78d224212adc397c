"""Daily scoring: stored models to the prediction table of one date."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from emberday.models.classifiers import score_model, score_sequence
from emberday.operators.base import station_dimension
from emberday.operators.scoring import prediction_table, resolved_thresholds, rows_of_date
from emberday.plans.training import load_fit, load_sequence


def predict_for_date(
    spark: SparkSession,
    wide: DataFrame,
    target_date: str,
    folder: str,
    model_names: Sequence[str],
    samples: DataFrame | None = None,
) -> DataFrame:
    """Predictions of the named models for every station on ``target_date``.

    The date filter sits on the scan of the feature table. With ``samples`` the stored
    sequence model scores that date's histories as well.
    """
    if not model_names and samples is None:
        raise ValueError("no model named")
    day = rows_of_date(wide, target_date)
    scores, metas = [], []
    for name in model_names:
        fit, meta = load_fit(spark, folder, name)
        scores.append(score_model(fit.model, day, fit.features, name, fill=fit.kind == "boosted"))
        metas.append(meta)
    if samples is not None:
        fit, meta = load_sequence(spark, folder)
        scores.append(score_sequence(fit, rows_of_date(samples, target_date)))
        metas.append(meta)
    return prediction_table(
        reduce(DataFrame.unionByName, scores),
        resolved_thresholds(reduce(DataFrame.unionByName, metas)),
        station_dimension(day),
    )
