"""Exact binary classification metrics per group, ties included.

Predictions are first reduced to one row per (group, score) with the two label counts,
which combines on the map side. Everything else, the point metrics as well as the
curves, is arithmetic on those counts; the cumulative counts come from
``prefix.running_totals``, so one model holding all rows is not sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.risk import finite_or_null
from emberday.operators.prefix import running_totals
from emberday.session import written

LABEL = "fire_label"
SCORE = "pred_prob"
DEFAULT_MIN_PRECISION = 0.3
DEFAULT_MAX_FAR = 0.05
CURVE_DIGITS = 6
# Smallest distance of a probability from 0 and 1 inside the logarithm: float epsilon.
LOG_LOSS_EPS = 2.220446049250313e-16


def _known_scores(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """(keys, score, pos, neg) per row.

    Rows without a label, with a null or NaN score, or without a key belong to no group
    that could be ranked and are left out.
    """
    known = F.col("score").isNotNull() & F.col("pos").isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    y = F.col(label).cast("long")
    p = finite_or_null(F.col(score).cast("double"))
    return df.select(*keys, p.alias("score"), y.alias("pos"), (1 - y).alias("neg")).filter(known)


def score_counts(
    df: DataFrame, keys: Sequence[str], label: str = LABEL, score: str = SCORE
) -> DataFrame:
    """(keys, score, pos, neg): label counts of every distinct score."""
    return (
        _known_scores(df, keys, label, score)
        .groupBy(*keys, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def cumulative_counts(counts: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Counts of rows scoring at least ``score`` (``cum_*``) and group totals (``all_*``)."""
    return running_totals(counts, keys, "score", ["pos", "neg", *more], descending=True)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates of a confusion table; a zero denominator gives 0."""
    return {
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "positive_rate": ratio_or_zero(tp + fp, tp + fp + fn + tn),
        "false_alarm_rate": ratio_or_zero(fp, fp + tn),
        "accuracy": ratio_or_zero(tp + tn, tp + fp + fn + tn),
    }


def confusion_by_group(
    df: DataFrame,
    keys: Sequence[str],
    threshold: float = 0.5,
    label: str = LABEL,
    score: str = SCORE,
) -> DataFrame:
    """Confusion counts and rates at one threshold, one aggregation."""
    hit = finite_or_null(F.col(score)) >= threshold
    positive = F.col(label) == 1

    def tally(rows: Column) -> Column:
        return F.count(F.when(rows, 1))

    counted = (
        df.filter(F.col(label).isNotNull() & finite_or_null(F.col(score)).isNotNull())
        .groupBy(*keys)
        .agg(
            tally(hit & positive).alias("tp"),
            tally(hit & ~positive).alias("fp"),
            tally(~hit & positive).alias("fn"),
            tally(~hit & ~positive).alias("tn"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.withColumns(confusion_metrics(tp, fp, fn, tn)).withColumn(
        "threshold", F.lit(float(threshold))
    )


def brier_logloss(
    df: DataFrame, keys: Sequence[str], label: str = LABEL, score: str = SCORE
) -> DataFrame:
    p = finite_or_null(F.col(score).cast("double"))
    y = F.col(label).cast("double")
    return (
        df.filter(p.isNotNull() & y.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg((p - y) * (p - y)).alias("brier"),
            F.avg(-F.log(F.when(y == 1, _log_safe(p)).otherwise(1 - _log_safe(p)))).alias(
                "log_loss"
            ),
        )
    )


def _log_safe(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - LOG_LOSS_EPS)), F.lit(LOG_LOSS_EPS))


def classification_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    threshold: float = 0.5,
    min_precision: float = DEFAULT_MIN_PRECISION,
    max_far: float = DEFAULT_MAX_FAR,
    label: str = LABEL,
    score: str = SCORE,
) -> DataFrame:
    """Every metric of one row per group.

    ``roc_auc`` and ``pr_auc`` (average precision, step sum) are null when a group has
    one class only. ``recall_at_precision`` is the best recall with at least
    ``min_precision``, at the lowest such threshold; ``recall_at_far`` the best recall
    with at most ``max_far`` false alarms, at the highest such threshold.
    """
    return _metrics_of_counts(score_counts(df, keys, label, score), keys, threshold, min_precision, max_far)


def _metrics_of_counts(
    counts: DataFrame, keys: Sequence[str], threshold: float, min_precision: float, max_far: float
) -> DataFrame:
    curve = cumulative_counts(counts, keys)
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision = tp / (tp + fp)
    far = ratio_or_zero(fp, F.col("all_neg"))

    above = s >= threshold
    exact_enough = precision >= min_precision
    quiet = far <= max_far
    # Recall and false alarms both grow as the threshold falls, so the best point is the
    # lowest allowed threshold; under the false-alarm limit, the lowest one that still
    # adds a hit, or the very highest score when no allowed one does.
    gains = quiet & (pos > 0)

    p_hit, p_miss = _log_safe(s), 1 - _log_safe(s)
    sums = curve.groupBy(*keys).agg(
        F.sum(pos).alias("positive"),
        F.sum(neg).alias("_negative"),
        F.sum(neg.cast("double") * ((tp - pos) + pos / 2)).alias("_pairs"),
        F.sum(pos * precision).alias("_ap"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_sq"),
        F.sum(-pos * F.log(p_hit) - neg * F.log(p_miss)).alias("_ll"),
        F.sum(F.when(above, pos).otherwise(F.lit(0))).alias("tp"),
        F.sum(F.when(above, neg).otherwise(F.lit(0))).alias("fp"),
        F.min(F.when(exact_enough, s)).alias("recall_at_precision_threshold"),
        F.max(F.when(exact_enough, tp)).alias("_rap_tp"),
        F.max(F.when(exact_enough, tp + fp)).alias("_rap_n"),
        F.min(F.when(gains, s)).alias("_raf_s"),
        F.max(F.when(gains, tp)).alias("_raf_tp"),
        F.max(F.when(gains, fp)).alias("_raf_fp"),
        F.max(F.when(quiet, s)).alias("_first_s"),
        F.min(F.when(quiet, fp)).alias("_first_fp"),
    )
    positive, negative = F.col("positive"), F.col("_negative")
    n = positive + negative
    two_classes = (positive > 0) & (negative > 0)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = positive - tp, negative - fp
    rates = confusion_metrics(tp, fp, fn, tn)
    raf_tp = F.when(F.col("_first_s").isNotNull(), F.coalesce(F.col("_raf_tp"), F.lit(0)))
    raf_fp = F.coalesce(F.col("_raf_fp"), F.col("_first_fp"))
    return sums.select(
        *keys,
        n.alias("rows"),
        "positive",
        F.when(
            two_classes, F.col("_pairs") / (positive.cast("double") * negative.cast("double"))
        ).alias("roc_auc"),
        F.when(two_classes, F.col("_ap") / positive).alias("pr_auc"),
        (F.col("_sq") / n).alias("brier"),
        (F.col("_ll") / n).alias("log_loss"),
        *[rates[m].alias(m) for m in ("precision", "recall", "f1", "accuracy", "positive_rate")],
        rates["false_alarm_rate"].alias("false_alarm_rate"),
        F.lit(float(threshold)).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        "recall_at_precision_threshold",
        (F.col("_rap_tp") / F.col("_rap_n")).alias("recall_at_precision_precision"),
        F.when(
            F.col("_rap_n").isNotNull(), ratio_or_zero(F.col("_rap_tp"), positive)
        ).alias("recall_at_precision"),
        F.coalesce(F.col("_raf_s"), F.col("_first_s")).alias("recall_at_far_threshold"),
        F.when(raf_tp.isNotNull(), ratio_or_zero(raf_tp, raf_tp + raf_fp)).alias(
            "recall_at_far_precision"
        ),
        F.when(raf_tp.isNotNull(), ratio_or_zero(raf_tp, positive)).alias("recall_at_far"),
        F.when(raf_tp.isNotNull(), ratio_or_zero(raf_fp, negative)).alias("recall_at_far_far"),
    )


def metrics_at_thresholds(
    counts: DataFrame, thresholds: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Confusion metrics at every row of ``thresholds`` (keys, threshold).

    Thresholds are laid among the scores as rows that count nothing, so all of them are
    evaluated by one running sum; a score equal to a threshold counts as above it.
    """
    wanted = thresholds.select(
        *keys,
        F.col("threshold").cast("double").alias("score"),
        F.lit(0).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("neg"),
        F.lit(1).cast("long").alias("asked"),
    )
    merged = (
        counts.select(*keys, "score", "pos", "neg", F.lit(0).cast("long").alias("asked"))
        .unionByName(wanted)
        .groupBy(*keys, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("asked").alias("asked"))
    )
    return _metrics_where_asked(merged, keys)


def _metrics_where_asked(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    curve = cumulative_counts(counts, keys).filter(F.col("asked") == 1)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    fn, tn = F.col("all_pos") - tp, F.col("all_neg") - fp
    rates = confusion_metrics(tp, fp, fn, tn)
    return curve.select(
        *keys,
        F.col("score").alias("threshold"),
        *[rates[m].alias(m) for m in ("precision", "recall", "f1", "false_alarm_rate")],
        rates["positive_rate"].alias("positive_rate"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
    )


def rounded_grid(counts: DataFrame, keys: Sequence[str], digits: int = CURVE_DIGITS) -> DataFrame:
    """Distinct scores rounded half to even."""
    return counts.select(*keys, F.bround("score", digits).alias("threshold")).distinct()


def threshold_curve(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = LABEL,
    score: str = SCORE,
    digits: int = CURVE_DIGITS,
) -> DataFrame:
    """Metrics at every distinct rounded score.

    Each row gives its score and, counting nothing, its rounded score, so one
    aggregation yields the scores and the thresholds among them.
    """
    nothing = F.lit(0).cast("long")
    both = F.array(
        F.struct("score", "pos", "neg", nothing.alias("asked")),
        F.struct(
            F.bround("score", digits).alias("score"),
            nothing.alias("pos"),
            nothing.alias("neg"),
            F.lit(1).cast("long").alias("asked"),
        ),
    )
    counts = (
        _known_scores(df, keys, label, score)
        .select(*keys, F.inline(both))
        .groupBy(*keys, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("asked").alias("asked"))
    )
    return _metrics_where_asked(counts, keys)


def threshold_curve_thinned(
    df: DataFrame,
    keys: Sequence[str] = (),
    max_points: int = 200,
    label: str = LABEL,
    score: str = SCORE,
    digits: int = CURVE_DIGITS,
) -> DataFrame:
    """As ``threshold_curve``, on evenly spaced quantiles of the grid when it is long."""
    counts = score_counts(df, keys, label, score)
    return metrics_at_thresholds(
        counts, thinned_grid(rounded_grid(counts, keys, digits), keys, max_points), keys
    )


def thinned_grid(grid: DataFrame, keys: Sequence[str], max_points: int) -> DataFrame:
    """``max_points`` linearly interpolated quantiles of each key's grid, distinct.

    Grids of at most ``max_points`` values are kept as they are. The neighbours of all
    quantiles are picked by rank in an equi-join.
    """
    ranked = running_totals(
        grid.withColumn("one", F.lit(1).cast("long")),
        keys, "threshold", ["one"],
    ).select(
        *keys, "threshold", (F.col("cum_one") - 1).alias("rank"), F.col("all_one").alias("n")
    )
    short = ranked.filter(F.col("n") <= max_points).select(*keys, "threshold")

    step = 1.0 / (max_points - 1)
    last = max_points - 1
    spots = (
        ranked.filter((F.col("n") > max_points) & (F.col("rank") == 0))
        .select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i"))
        .withColumn("q", F.when(F.col("i") == last, 1.0).otherwise(F.col("i") * F.lit(step)))
        .withColumn("spot", F.col("q") * (F.col("n") - 1))
        .withColumn("low", F.floor("spot"))
        .withColumn("weight", F.col("spot") - F.col("low"))
    )
    needed = spots.select(
        *keys, "i", "weight", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "low", "n"
    ).withColumn("rank", F.least(F.col("low") + F.col("side"), F.col("n") - 1).cast("long"))
    values = needed.drop("n", "low").join(ranked.drop("n"), [*keys, "rank"]).groupBy(*keys, "i", "weight").agg(
        F.max(F.when(F.col("side") == 0, F.col("threshold"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("threshold"))).alias("b"),
    )
    gap, w = F.col("b") - F.col("a"), F.col("weight")
    between = F.when(w >= 0.5, F.col("b") - gap * (1 - w)).otherwise(F.col("a") + gap * w)
    long = values.select(*keys, between.alias("threshold"))
    return short.unionByName(long).distinct()


def recommended_thresholds(
    df: DataFrame,
    keys: Sequence[str] = (),
    baseline: float = 0.5,
    min_precision: float = DEFAULT_MIN_PRECISION,
    max_far: float = DEFAULT_MAX_FAR,
    label: str = LABEL,
    score: str = SCORE,
) -> DataFrame:
    """Metrics at the baseline, the recall-priority and the false-alarm-limited threshold.

    The counts are written: the search for the thresholds and their metrics both read them.
    """
    counts = written(score_counts(df, keys, label, score), "counts")
    best = _metrics_of_counts(counts, keys, baseline, min_precision, max_far)
    picked = (
        best.select(
            *keys,
            F.explode(
                F.array(
                    "threshold", "recall_at_precision_threshold", "recall_at_far_threshold"
                )
            ).alias("threshold"),
        )
        .filter(F.col("threshold").isNotNull())
        .distinct()
    )
    return metrics_at_thresholds(counts, picked, keys)


CALIBRATION_EDGES = tuple(i / 10 for i in range(11))


def calibration_bins(
    df: DataFrame,
    keys: Sequence[str] = ("method",),
    label: str = LABEL,
    score: str = SCORE,
    edges: Sequence[float] = CALIBRATION_EDGES,
) -> DataFrame:
    """Predicted against observed rate per right-closed score bin, lowest edge included.

    Scores outside the edges fall in no bin; empty bins give no row.
    """
    p = finite_or_null(F.col(score).cast("double"))
    bin_no = F.when(p < edges[0], F.lit(None))
    name = F.when(p < edges[0], F.lit(None))
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        # The first bin prints a left edge just below the lowest one, as it is closed there.
        left = f"{low - 0.001:.3f}" if i == 0 else f"{low}"
        bin_no = bin_no.when(p <= high, F.lit(i))
        name = name.when(p <= high, F.lit(f"({left}, {high}]"))
    y = F.col(label).cast("double")
    return (
        df.select(*keys, p.alias("_p"), y.alias("_y"), bin_no.alias("bin"), name.alias("prob_bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "bin", "prob_bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("_p").alias("avg_pred_prob"),
            F.avg("_y").alias("empirical_fire_rate"),
        )
        .withColumn(
            "gap_pred_minus_actual", F.col("avg_pred_prob") - F.col("empirical_fire_rate")
        )
    )


def metrics_delta(
    df: DataFrame,
    old_score: str,
    new_score: str,
    threshold: float = 0.5,
    label: str = LABEL,
) -> DataFrame:
    """Old and new model on the same rows, and new minus old, in long form."""
    names = (
        "roc_auc", "pr_auc", "brier", "log_loss", "accuracy",
        "precision", "recall", "f1", "positive_rate",
    )
    both = df.select(
        label,
        F.explode(
            F.array(
                F.struct(F.lit("old").alias("model"), F.col(old_score).alias("p")),
                F.struct(F.lit("new").alias("model"), F.col(new_score).alias("p")),
            )
        ).alias("s"),
    ).select(label, "s.model", F.col("s.p").alias(SCORE))
    per_model = classification_metrics(both, ["model"], threshold, label=label)
    wide = per_model.agg(
        *[
            F.max(F.when(F.col("model") == side, F.col(m))).alias(f"{side}_{m}")
            for side in ("old", "new")
            for m in names
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"old_{m}").alias("old"),
                F.col(f"new_{m}").alias("new"),
                (F.col(f"new_{m}") - F.col(f"old_{m}")).alias("delta"),
            )
            for m in names
        ]
    )
    return wide.select(F.inline(rows))
