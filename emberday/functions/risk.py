"""Probabilities, risk levels and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive upper bound of each level; above the last one the top level.
RISK_LEVELS = ((0.4, "LOW"), (0.6, "MODERATE"), (0.8, "HIGH"))
TOP_RISK_LEVEL = "EXTREME"

DEFAULT_THRESHOLD = 0.5
MISSING_CATEGORY = "__MISSING__"


def finite_or_null(probability: Column) -> Column:
    """NaN compares as larger than every number in Spark, so it must go first."""
    return F.when(~F.isnan(probability), probability)


def risk_level(probability: Column) -> Column:
    p = finite_or_null(probability)
    level = F.when(p.isNull(), F.lit(None))
    for bound, name in RISK_LEVELS:
        level = level.when(p <= bound, F.lit(name))
    return level.otherwise(F.lit(TOP_RISK_LEVEL))


def alert_flag(probability: Column, threshold: Column) -> Column:
    return F.coalesce((finite_or_null(probability) >= threshold).cast("int"), F.lit(0))


def operating_threshold(
    configured: Column, at_far: Column, holdout: Column, default: float = DEFAULT_THRESHOLD
) -> Column:
    """Explicit threshold, else the one found under the false-alarm limit, else the holdout's."""
    return F.coalesce(configured, at_far, holdout, F.lit(float(default))).cast("double")


def clip_probability(probability: Column, eps: float = 1e-6) -> Column:
    inside = F.greatest(F.least(probability, F.lit(1.0 - eps)), F.lit(eps))
    return F.when(probability.isNotNull(), inside)


def logit(probability: Column, eps: float = 1e-6) -> Column:
    p = clip_probability(probability, eps)
    return F.log(p / (F.lit(1.0) - p))


def fill_category(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING_CATEGORY))
