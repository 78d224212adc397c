"""Queries that fit models. Few fits have an SQL twin; their output is checked in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.standins import flag_base, flag_share_labels, r, rounded, table
from emberday.models.calibration import apply_isotonic, apply_platt, fit_isotonic, fit_platt
from emberday.models.classifiers import (
    DAILY_FEATURES,
    FeatureSet,
    coefficients,
    complete_rows,
    fit_logistic,
    training_frame,
)
from emberday.operators.features import wide_features
from emberday.operators.metrics import classification_metrics
from emberday.operators.sequences import sequence_samples
from emberday.operators.splits import year_split
from emberday.session import shared_folder, written
from emberday.plans.prediction import predict_for_date
from emberday.plans.training import (
    calibration_study,
    evaluate_saved,
    holdout_predictions,
    rolling_backtest,
    sequence_holdout,
    split_part,
    train_and_save,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _base(spark, sf_dir) -> DataFrame:
    return flag_base(spark, sf_dir, flag_share_labels)


def _wide(spark, sf_dir) -> DataFrame:
    return wide_features(_base(spark, sf_dir))


def _daily(spark, sf_dir) -> DataFrame:
    """The older labelled daily table: six plain columns."""
    base = _base(spark, sf_dir)
    return base.select(
        "station_id", "date", "fire_label",
        F.col("TA_day").alias("TA"), F.col("POP_day").alias("POP"),
        F.col("is_precip_day").alias("is_precip"), F.col("WD_sin_day").alias("WD_sin"),
        F.col("WD_cos_day").alias("WD_cos"), F.substring("SKY_day", 4, 1).alias("SKY"),
    )


@query("lr_fit_score")
def lr_fit_score(spark, sf_dir):
    _, scored, _ = holdout_predictions(_wide(spark, sf_dir), "logistic", "lr")
    return rounded(scored)


@query("gbt_fit_score")
def gbt_fit_score(spark, sf_dir):
    _, scored, _ = holdout_predictions(
        _wide(spark, sf_dir), "boosted", "gbt", validation_days=240
    )
    return rounded(scored)


@query("sequence_fit_score")
def sequence_fit_score(spark, sf_dir):
    samples = sequence_samples(_base(spark, sf_dir))
    _, scored, _ = sequence_holdout(samples)
    return rounded(scored)


@query("legacy_fit")
def legacy_fit(spark, sf_dir):
    """Balanced logistic regression on the daily columns, split at a year; weights by size."""
    features = FeatureSet(DAILY_FEATURES)
    rows = complete_rows(training_frame(_daily(spark, sf_dir), features), features.all)
    fit = fit_logistic(split_part(year_split(rows, 2000), "train"), features)
    return rounded(spark.createDataFrame(coefficients(fit), "feature string, weight double"))


@query("legacy_boosted")
def legacy_boosted(spark, sf_dir):
    """Boosted trees with balanced weights on the daily columns."""
    features = FeatureSet(DAILY_FEATURES)
    rows = complete_rows(_daily(spark, sf_dir), [*features.all, "fire_label"])
    _, scored, _ = holdout_predictions(
        rows, "boosted", "legacy", features, balanced=True
    )
    return rounded(classification_metrics(scored, ["model_name"]))


def _scored(spark, sf_dir) -> DataFrame:
    """Order items scored by price, split in two halves of time for calibration."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_suppkey").cast("int").alias("station_id"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_quantity") * F.col("l_discount") > 2).cast("int").alias("fire_label"),
        (F.col("l_quantity") / 51).alias("pred_prob"),
        (F.col("l_shipdate") < F.lit("1998-06-01")).alias("early"),
    )


@query("platt")
def platt(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    model = fit_platt(rows.filter("early"))
    return rounded(apply_platt(model, rows.filter("not early").drop("early")))


@query("isotonic")
def isotonic(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    model = fit_isotonic(rows.filter("early"))
    return rounded(apply_isotonic(model, rows.filter("not early").drop("early")))


# The min-max form: the largest, over starts at or before a score, of the smallest mean label
# up to an end at or behind it.
SQL["isotonic"] = f"""
WITH items AS (
  SELECT CAST(l_suppkey AS INTEGER) AS station_id, CAST(l_shipdate AS DATE) AS date,
    CAST(l_quantity * l_discount > 2 AS INTEGER) AS fire_label, l_quantity / 51 AS pred_prob,
    CAST(l_shipdate AS DATE) < DATE '1998-06-01' AS early
  FROM lineitem
), counts AS (
  SELECT pred_prob AS x, sum(fire_label) AS pos, count(*) AS n FROM items WHERE early GROUP BY 1
), summed AS (
  SELECT x, pos, n, row_number() OVER (ORDER BY x) AS r, sum(pos) OVER (ORDER BY x) AS cp, sum(n) OVER (ORDER BY x) AS cn
  FROM counts
), smallest AS (
  SELECT i.x, j.r, min((k.cp - j.cp + j.pos) / (k.cn - j.cn + j.n)) AS m
  FROM summed i JOIN summed j ON j.r <= i.r JOIN summed k ON k.r >= i.r GROUP BY 1, 2
), fitted AS (
  SELECT x, max(m) AS y FROM smallest GROUP BY 1
)
SELECT station_id, date, fire_label, {r("y", "pred_prob")}
FROM items LEFT JOIN fitted ON x = pred_prob WHERE NOT early
"""


@query("calibration_study")
def q_calibration_study(spark, sf_dir):
    metrics, _, _ = calibration_study(_wide(spark, sf_dir), "logistic")
    return rounded(metrics)


@query("backtest")
def backtest(spark, sf_dir):
    wide = written(_wide(spark, sf_dir), "wide")
    years = wide.agg(F.year(F.min("date")).alias("first"), F.year(F.max("date")).alias("last")).first()
    folds, _, _ = rolling_backtest(wide, "logistic", start_year=years["first"], end_year=years["last"])
    return rounded(folds)


def _saved_model(spark, sf_dir, folder):
    wide = _wide(spark, sf_dir)
    train_and_save(spark, wide, "logistic", "lr", folder)
    return wide


@query("saved_model_eval")
def saved_model_eval(spark, sf_dir):
    folder = model_folder(spark)
    wide = _saved_model(spark, sf_dir, folder)
    return rounded(evaluate_saved(spark, folder, "lr", wide))


@query("date_score")
def date_score(spark, sf_dir):
    """Train, store, load and score the last day of the table."""
    folder = model_folder(spark)
    wide = _saved_model(spark, sf_dir, folder)
    last_day = wide.agg(F.max("date")).first()[0]
    return rounded(predict_for_date(spark, wide, str(last_day), folder, ["lr"]))


def model_folder(spark) -> str:
    """A new folder for models in the folder all executors share."""
    return f"{shared_folder(spark)}/emberday/models-{uuid.uuid4().hex}"
