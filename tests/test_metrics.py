import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberday.functions.risk import alert_flag, operating_threshold, risk_level
from emberday.operators.metrics import (
    brier_logloss,
    calibration_bins,
    classification_metrics,
    confusion_by_group,
    metrics_delta,
    recommended_thresholds,
    threshold_curve,
    threshold_curve_thinned,
)
from emberday.operators.prefix import dense_index, exact_quantiles, running_totals
from emberday.operators.selection import (
    pooled_predictions,
    station_model_metrics,
    station_winners,
)


def brute(ys, ps, threshold=0.5, min_precision=0.3, max_far=0.05):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    out = {
        "roc_auc": sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)),
        "brier": sum((p - y) ** 2 for y, p in zip(ys, ps)) / len(ys),
    }
    points, last, ap = [], 0.0, 0.0
    for t in sorted(set(ps), reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        points.append((t, tp / (tp + fp), tp / len(pos), fp / len(neg)))
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    out["pr_auc"] = ap
    exact = [q for q in points if q[1] >= min_precision]
    best = max(exact, key=lambda q: (q[2], -q[0])) if exact else None
    out["recall_at_precision"] = best and best[2]
    out["recall_at_precision_threshold"] = best and best[0]
    quiet = [q for q in points if q[3] <= max_far]
    best = max(quiet, key=lambda q: (q[2], q[0])) if quiet else None
    out["recall_at_far"] = best and best[2]
    out["recall_at_far_threshold"] = best and best[0]
    out["recall_at_far_far"] = best and best[3]
    tp, fp = sum(p >= threshold for p in pos), sum(p >= threshold for p in neg)
    out.update(tp=tp, fp=fp, fn=len(pos) - tp, tn=len(neg) - fp)
    return out


def scored(rng, n, distinct):
    ys = [1, 0] + [int(rng.random() < 0.3) for _ in range(n - 2)]
    ps = [rng.choice([0.0, 1.0, 0.1, rng.randrange(distinct) / distinct]) for _ in ys]
    return ys, ps


@pytest.mark.parametrize("limits", [{}, {"min_precision": 0.6, "max_far": 0.2}, {"min_precision": 0.99, "max_far": 0.0}])
def test_metrics_match_brute_force_with_ties(spark, limits):
    rng = random.Random(5)
    groups = {f"g{i}": scored(rng, n, d) for i, (n, d) in enumerate([(2, 2), (30, 3), (60, 1000), (200, 7), (150, 10**6)])}
    data = [(g, y, p) for g, (ys, ps) in groups.items() for y, p in zip(ys, ps)]
    df = spark.createDataFrame(data, "g string, fire_label int, pred_prob double")
    got = {r.g: r for r in classification_metrics(df, ["g"], **limits).collect()}
    for g, (ys, ps) in groups.items():
        for name, value in brute(ys, ps, **limits).items():
            if value is None:
                assert got[g][name] is None, (g, name)
            else:
                assert got[g][name] == pytest.approx(value, abs=1e-12), (g, name)


def test_global_metrics_and_unusable_rows(spark):
    rows = [(1, 0.9), (0, 0.2), (1, None), (None, 0.4), (0, float("nan"))]
    df = spark.createDataFrame(rows, "fire_label int, pred_prob double")
    r = classification_metrics(df).first()
    assert (r.rows, r.positive, r.roc_auc, r.pr_auc, r.tp, r.tn) == (2, 1, 1.0, 1.0, 1, 1)
    assert brier_logloss(df, []).first().log_loss == pytest.approx(r.log_loss)
    assert confusion_by_group(df, []).select("tp", "fp", "fn", "tn").first() == (1, 0, 0, 1)


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "fire_label int, pred_prob double")
    assert classification_metrics(df).first().log_loss == pytest.approx(-math.log(2.220446049250313e-16) / 2, rel=1e-6)


def test_one_class_groups(spark):
    rows = [(1, "a", 1, 0.3), (1, "a", 1, 0.7), (2, "a", 1, 0.9), (2, "a", 0, 0.1), (2, "b", 1, 0.1), (2, "b", 0, 0.9), (1, "b", 1, 0.2)]
    df = spark.createDataFrame(rows, "station_id int, model_name string, fire_label int, pred_prob double")
    metrics = station_model_metrics(df)
    single = metrics.filter("station_id = 1 and model_name = 'a'").first()
    assert (single.rows, single.positive, single.roc_auc, single.precision, single.recall_at_far) == (2, 2, None, None, None)
    assert {(r.station_id, r.model_name) for r in station_winners(metrics).collect()} == {(1, "a"), (2, "a")}


def test_threshold_curve_keeps_unrounded_comparison(spark):
    df = spark.createDataFrame([(1, 0.1234564), (0, 0.1234566), (1, 0.5)], "fire_label int, pred_prob double")
    got = {r.threshold: (r.tp, r.fp) for r in threshold_curve(df).collect()}
    # 0.1234564 lies above its own rounded value, 0.1234566 below its own.
    assert got == {0.123456: (2, 1), 0.123457: (1, 0), 0.5: (1, 0)}


def test_thinned_curve_matches_numpy(spark):
    rng = random.Random(3)
    ps = [round(rng.random(), 4) for _ in range(700)]
    ys = [int(rng.random() < p) for p in ps]
    df = spark.createDataFrame(list(zip(ys, ps)), "fire_label int, pred_prob double")
    grid = np.unique(np.quantile(np.unique(np.round(ps, 6)), np.linspace(0, 1, 50)))
    got = {r.threshold: (r.tp, r.fp) for r in threshold_curve_thinned(df, max_points=50).collect()}
    assert sorted(got) == pytest.approx(list(grid), abs=1e-12)
    for t, (tp, fp) in got.items():
        assert tp == sum(y for y, p in zip(ys, ps) if p >= t)
        assert fp == sum(1 - y for y, p in zip(ys, ps) if p >= t)
    assert threshold_curve_thinned(df, max_points=1000).count() == len(set(ps))


def test_recommended_thresholds_are_distinct(spark):
    df = spark.createDataFrame([(1, 0.5), *[(0, 0.1)] * 3], "fire_label int, pred_prob double")
    got = recommended_thresholds(df).collect()
    assert sorted(r.threshold for r in got) == [0.5]


def test_calibration_bins_edges(spark):
    rows = [("m", 0, 0.0), ("m", 1, 0.1), ("m", 1, 0.100001), ("m", 0, 1.0), ("m", 1, 1.2), ("m", 1, -0.1)]
    df = spark.createDataFrame(rows, "method string, fire_label int, pred_prob double")
    got = [(r.prob_bin, r.rows, r.empirical_fire_rate) for r in calibration_bins(df).orderBy("bin").collect()]
    assert got == [("(-0.001, 0.1]", 2, 0.5), ("(0.1, 0.2]", 1, 1.0), ("(0.9, 1.0]", 1, 0.0)]


def test_delta(spark):
    df = spark.createDataFrame([(1, 0.2, 0.9), (0, 0.8, 0.1)], "fire_label int, o double, n double")
    got = {r.metric: (r.old, r.new, r.delta) for r in metrics_delta(df, "o", "n").collect()}
    assert got["roc_auc"] == (0.0, 1.0, 1.0) and got["accuracy"] == (0.0, 1.0, 1.0)


def test_pooled_predictions_on_common_keys(spark):
    schema = "station_id int, date string, fire_label int, pred_prob double, model_name string"
    a = spark.createDataFrame([(1, "d1", 0, 0.1, "a"), (1, "d2", 0, 0.1, "a")], schema)
    b = spark.createDataFrame([(1, "d2", 0, 0.3, "b")], schema)
    assert pooled_predictions([a, b]).count() == 3
    assert {r.date for r in pooled_predictions([a, b], common_keys=True).collect()} == {"d2"}


def test_risk_levels_and_alerts(spark):
    ps = [0.4, 0.40001, 0.6, 0.8, 0.81, None, float("nan")]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = df.select(risk_level(F.col("p")), alert_flag(F.col("p"), F.lit(0.7165))).collect()
    assert [r[0] for r in got] == ["LOW", "MODERATE", "MODERATE", "HIGH", "EXTREME", None, None]
    assert [r[1] for r in got] == [0, 0, 0, 1, 1, 0, 0]


def test_threshold_order(spark):
    rows = [(0.9, 0.8, 0.7), (None, 0.8, 0.7), (None, None, 0.7), (None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r[0] for r in df.select(operating_threshold(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [0.9, 0.8, 0.7, 0.5]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_crowded_cells(spark, descending):
    rng = random.Random(9)
    # Most values share a few cells; one key holds nearly everything.
    values = {("big", 1e-9 * i) for i in range(400)} | {("big", 0.5 + 1e-9 * i) for i in range(400)} | {("small", 0.3)}
    data = [(k, v, rng.randrange(5)) for k, v in values]
    df = spark.createDataFrame(data, "k string, v double, n long")
    out = running_totals(df, ["k"], "v", ["n"], descending).collect()
    for r in out:
        within = [n for k, v, n in data if k == r.k and (v >= r.v if descending else v <= r.v)]
        assert r.cum_n == sum(within)
        assert r.all_n == sum(n for k, _, n in data if k == r.k)
    assert len(out) == len(data)


def test_quantiles_and_dense_index(spark):
    data = [("a", v) for v in (1.0, 2.0, 4.0, 9.0)] + [("b", 5.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.lo, r.mid) for r in exact_quantiles(df, ["k"], "v", {"lo": 0.25, "mid": 0.5}).collect()}
    assert got == {"a": (1.75, 3.0), "b": (5.0, 5.0)}
    whole = exact_quantiles(df, [], "v", {"mid": 0.5}).first()
    assert whole.mid == 4.0
    ids = spark.createDataFrame([(105,), (7,), (104,), (7,)], "station_id int")
    assert {r.station_id: r.i for r in dense_index(ids, "station_id", "i").collect()} == {7: 0, 104: 1, 105: 2}
