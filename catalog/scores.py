"""Queries on scored predictions: curves, metrics, thresholds, selection, output."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import PREDICTIONS_SQL, SCORES, predictions, r, rounded, table
from emberday.functions.risk import clip_probability, logit
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
from emberday.operators.scoring import prediction_table, resolved_thresholds
from emberday.operators.selection import (
    BENCHMARK_COLUMNS,
    model_benchmark,
    pooled_predictions,
    rank_calibrations,
    station_model_metrics,
    station_winners,
)
from emberday.operators.splits import (
    class_weights,
    split_summary,
    three_way_split,
    time_split,
    yearly_folds,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


MODEL = ["model_name"]


def metrics_sql(keys: str, threshold: float = 0.5, min_precision: float = 0.3, max_far: float = 0.05) -> str:
    """CTEs from ``preds`` to ``metrics``, one row per ``keys``, by plain ordered windows."""
    on = " AND ".join(f"c.{k} = t.{k}" for k in keys.split(", "))
    return f"""
counts AS (
  SELECT {keys}, pred_prob AS s, CAST(sum(fire_label) AS BIGINT) AS pos,
         CAST(sum(1 - fire_label) AS BIGINT) AS neg
  FROM preds GROUP BY {keys}, pred_prob
),
totals AS (SELECT {keys}, CAST(sum(pos) AS BIGINT) AS p, CAST(sum(neg) AS BIGINT) AS n FROM counts GROUP BY {keys}),
curve AS (
  SELECT c.*, t.p, t.n,
         sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
  FROM counts c JOIN totals t ON {on}
  WINDOW w AS (PARTITION BY {", ".join("c." + k for k in keys.split(", "))} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)
),
pts AS (
  SELECT *, tp / (tp + fp) AS prec, CASE WHEN n > 0 THEN fp / n ELSE 0 END AS far,
         CASE WHEN p > 0 THEN tp / p ELSE 0 END AS rec
  FROM curve
),
rap AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rec DESC, s) AS o
                 FROM pts WHERE prec >= {min_precision}) WHERE o = 1
),
raf AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rec DESC, s DESC) AS o
                 FROM pts WHERE far <= {max_far}) WHERE o = 1
),
agg AS (
  SELECT {keys}, max(p) AS positive, max(n) AS negative,
         sum(neg * ((tp - pos) + pos / 2.0)) / nullif(max(p) * max(n), 0) AS roc_auc,
         CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * prec) / max(p) END AS pr_auc,
         sum(CASE WHEN s >= {threshold} THEN pos ELSE 0 END) AS tp,
         sum(CASE WHEN s >= {threshold} THEN neg ELSE 0 END) AS fp
  FROM pts GROUP BY {keys}
),
loss AS (
  SELECT {keys}, avg((pred_prob - fire_label) ** 2) AS brier,
         avg(-ln(CASE WHEN fire_label = 1
                      THEN greatest(least(pred_prob, 1 - 2.220446049250313e-16), 2.220446049250313e-16)
                      ELSE 1 - greatest(least(pred_prob, 1 - 2.220446049250313e-16), 2.220446049250313e-16)
                 END)) AS log_loss
  FROM preds GROUP BY {keys}
),
metrics AS (
  SELECT {", ".join("a." + k for k in keys.split(", "))}, positive + negative AS rows, positive, roc_auc, pr_auc, brier, log_loss,
         CASE WHEN a.tp + a.fp > 0 THEN a.tp / (a.tp + a.fp) ELSE 0 END AS precision,
         CASE WHEN positive > 0 THEN a.tp / positive ELSE 0 END AS recall,
         CASE WHEN a.tp + a.fp + positive > 0 THEN 2 * a.tp / (a.tp + a.fp + positive) ELSE 0 END AS f1,
         (a.tp + negative - a.fp) / (positive + negative) AS accuracy,
         (a.tp + a.fp) / (positive + negative) AS positive_rate,
         CASE WHEN negative > 0 THEN a.fp / negative ELSE 0 END AS false_alarm_rate,
         {threshold}::DOUBLE AS threshold,
         CAST(a.tp AS BIGINT) AS tp, CAST(a.fp AS BIGINT) AS fp,
         CAST(positive - a.tp AS BIGINT) AS fn, CAST(negative - a.fp AS BIGINT) AS tn,
         rap.s AS recall_at_precision_threshold, rap.prec AS recall_at_precision_precision,
         rap.rec AS recall_at_precision,
         raf.s AS recall_at_far_threshold,
         CASE WHEN raf.tp + raf.fp > 0 THEN raf.tp / (raf.tp + raf.fp) END AS recall_at_far_precision,
         raf.rec AS recall_at_far, raf.far AS recall_at_far_far
  FROM agg a JOIN loss USING ({keys}) LEFT JOIN rap USING ({keys}) LEFT JOIN raf USING ({keys})
)"""


_COUNT_COLUMNS = {"rows", "positive", "tp", "fp", "fn", "tn"}


def metric_list(*names: str) -> str:
    return ", ".join(
        f"CAST({n} AS BIGINT) AS {n}" if n in _COUNT_COLUMNS else r(n, n) for n in names
    )


_MODEL_METRICS = f"WITH {PREDICTIONS_SQL}, {metrics_sql('model_name')}"


@query(
    "confusion_by_group",
    f"""
WITH {PREDICTIONS_SQL},
c AS (
  SELECT model_name, station_id,
         count(CASE WHEN pred_prob >= 0.6 AND fire_label = 1 THEN 1 END) AS tp,
         count(CASE WHEN pred_prob >= 0.6 AND fire_label = 0 THEN 1 END) AS fp,
         count(CASE WHEN pred_prob < 0.6 AND fire_label = 1 THEN 1 END) AS fn,
         count(CASE WHEN pred_prob < 0.6 AND fire_label = 0 THEN 1 END) AS tn
  FROM preds GROUP BY model_name, station_id
)
SELECT *, {r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "precision")},
       {r("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END", "recall")},
       {r("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END", "f1")},
       {r("(tp + fp) / (tp + fp + fn + tn)", "positive_rate")},
       {r("CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END", "false_alarm_rate")},
       {r("(tp + tn) / (tp + fp + fn + tn)", "accuracy")}, 0.6::DOUBLE AS threshold
FROM c""",
)
def q_confusion_by_group(spark, sf_dir):
    return rounded(confusion_by_group(predictions(spark, sf_dir), ["model_name", "station_id"], 0.6))


@query("auc_by_group", f"{_MODEL_METRICS} SELECT model_name, {metric_list('rows', 'positive', 'roc_auc', 'pr_auc')} FROM metrics")
def auc_by_group(spark, sf_dir):
    metrics = classification_metrics(predictions(spark, sf_dir), MODEL)
    return rounded(metrics.select("model_name", "rows", "positive", "roc_auc", "pr_auc"))


@query(
    "brier_logloss",
    f"{_MODEL_METRICS} SELECT model_name, {metric_list('rows', 'brier', 'log_loss')} FROM metrics",
)
def q_brier_logloss(spark, sf_dir):
    return rounded(brier_logloss(predictions(spark, sf_dir), MODEL))


_RAP = ("recall_at_precision_threshold", "recall_at_precision_precision", "recall_at_precision")
_RAF = ("recall_at_far_threshold", "recall_at_far_precision", "recall_at_far", "recall_at_far_far")


@query(
    "recall_at_precision",
    f"WITH {PREDICTIONS_SQL}, {metrics_sql('model_name', min_precision=0.3345)} "
    f"SELECT model_name, {metric_list(*_RAP)} FROM metrics",
)
def q_recall_at_precision(spark, sf_dir):
    metrics = classification_metrics(predictions(spark, sf_dir), MODEL, min_precision=0.3345)
    return rounded(metrics.select("model_name", *_RAP))


@query("recall_at_far", f"{_MODEL_METRICS} SELECT model_name, {metric_list(*_RAF)} FROM metrics")
def q_recall_at_far(spark, sf_dir):
    return rounded(classification_metrics(predictions(spark, sf_dir), MODEL).select("model_name", *_RAF))


_CURVE_OUT = f"""{r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "precision")},
  {r("CASE WHEN p > 0 THEN tp / p ELSE 0 END", "recall")},
  {r("CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END", "f1")},
  {r("CASE WHEN n > 0 THEN fp / n ELSE 0 END", "false_alarm_rate")},
  {r("(tp + fp) / (p + n)", "positive_rate")},
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn,
  CAST(n - fp AS BIGINT) AS tn"""


def at_thresholds_sql(grid: str) -> str:
    """CTEs from ``preds`` and a ``grid`` query (model_name, threshold) to ``scored_at``."""
    return f"""
totals AS (
  SELECT model_name, CAST(sum(fire_label) AS BIGINT) AS p, CAST(sum(1 - fire_label) AS BIGINT) AS n
  FROM preds GROUP BY model_name
),
cum AS (
  SELECT model_name, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
  FROM (SELECT model_name, pred_prob AS s, sum(fire_label) AS pos, sum(1 - fire_label) AS neg
        FROM preds GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY model_name ORDER BY s DESC ROWS UNBOUNDED PRECEDING)
),
grid AS ({grid}),
scored_at AS (
  SELECT g.model_name, g.threshold, coalesce(c.tp, 0) AS tp, coalesce(c.fp, 0) AS fp, t.p, t.n
  FROM grid g JOIN totals t USING (model_name)
  ASOF LEFT JOIN cum c ON g.model_name = c.model_name AND g.threshold <= c.s
)"""


_GRID = "SELECT DISTINCT model_name, round_even(pred_prob, 6) AS threshold FROM preds"


@query(
    "threshold_curve",
    f"WITH {PREDICTIONS_SQL}, {at_thresholds_sql(_GRID)} "
    f"SELECT model_name, threshold, {_CURVE_OUT} FROM scored_at",
)
def q_threshold_curve(spark, sf_dir):
    return rounded(threshold_curve(predictions(spark, sf_dir), MODEL))


_THIN_GRID = f"""
  WITH g AS ({_GRID}),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY threshold) - 1 AS rk,
           count(*) OVER (PARTITION BY model_name) AS cnt FROM g
  ),
  spots AS (
    SELECT model_name, cnt, i,
           CASE WHEN i = 199 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 199) END * (cnt - 1) AS spot
    FROM (SELECT DISTINCT model_name, cnt FROM ranked WHERE cnt > 200),
         (SELECT unnest(generate_series(0, 199)) AS i)
  )
  SELECT model_name, threshold FROM ranked WHERE cnt <= 200
  UNION
  SELECT s.model_name,
         CASE WHEN s.spot - floor(s.spot) >= 0.5
              THEN b.threshold - (b.threshold - a.threshold) * (1 - (s.spot - floor(s.spot)))
              ELSE a.threshold + (b.threshold - a.threshold) * (s.spot - floor(s.spot)) END
  FROM spots s
  JOIN ranked a ON a.model_name = s.model_name AND a.rk = CAST(floor(s.spot) AS BIGINT)
  JOIN ranked b ON b.model_name = s.model_name AND b.rk = least(CAST(floor(s.spot) AS BIGINT) + 1, s.cnt - 1)
"""


@query(
    "threshold_curve_thinned",
    f"WITH {PREDICTIONS_SQL}, {at_thresholds_sql(_THIN_GRID)} "
    f"SELECT model_name, {r('threshold', 'threshold')}, {_CURVE_OUT} FROM scored_at",
)
def q_threshold_curve_thinned(spark, sf_dir):
    return rounded(threshold_curve_thinned(predictions(spark, sf_dir), MODEL))


@query(
    "recommended_thresholds",
    f"""
WITH {PREDICTIONS_SQL}, {metrics_sql('model_name')},
picked AS (
  SELECT model_name, threshold FROM metrics
  UNION SELECT model_name, recall_at_precision_threshold FROM metrics
  UNION SELECT model_name, recall_at_far_threshold FROM metrics
),
scored_at AS (
  SELECT p.model_name, p.threshold, max(t.p) AS p, max(t.n) AS n,
         sum(CASE WHEN c.s >= p.threshold THEN c.pos ELSE 0 END) AS tp,
         sum(CASE WHEN c.s >= p.threshold THEN c.neg ELSE 0 END) AS fp
  FROM picked p JOIN counts c USING (model_name) JOIN totals t USING (model_name)
  WHERE p.threshold IS NOT NULL GROUP BY 1, 2
)
SELECT model_name, {r('threshold', 'threshold')}, {_CURVE_OUT} FROM scored_at""",
)
def q_recommended_thresholds(spark, sf_dir):
    return rounded(recommended_thresholds(predictions(spark, sf_dir), MODEL))


@query(
    "calibration_bins",
    f"""
WITH {PREDICTIONS_SQL},
b AS (
  SELECT *, CASE WHEN pred_prob < 0 THEN NULL
    {" ".join(f"WHEN pred_prob <= {(i + 1) / 10} THEN {i}" for i in range(10))} END AS bin
  FROM preds
)
SELECT model_name, CAST(bin AS INTEGER) AS bin,
       CASE bin {" ".join(f"WHEN {i} THEN '({'-0.001' if i == 0 else i / 10}, {(i + 1) / 10}]'" for i in range(10))} END AS prob_bin,
       count(*) AS rows, {r("avg(pred_prob)", "avg_pred_prob")},
       {r("avg(fire_label)", "empirical_fire_rate")},
       {r("avg(pred_prob) - avg(fire_label)", "gap_pred_minus_actual")}
FROM b WHERE bin IS NOT NULL GROUP BY model_name, bin""",
)
def q_calibration_bins(spark, sf_dir):
    return rounded(calibration_bins(predictions(spark, sf_dir), MODEL))


@query("model_benchmark", f"{_MODEL_METRICS} SELECT model_name, {metric_list(*BENCHMARK_COLUMNS)} FROM metrics")
def q_model_benchmark(spark, sf_dir):
    return rounded(model_benchmark(predictions(spark, sf_dir)))


_STATION_METRICS = (
    "roc_auc", "pr_auc", "brier", "log_loss", "precision", "recall", "f1", "accuracy",
    "positive_rate", "false_alarm_rate", "tp", "fp", "fn", "tn", *_RAP, *_RAF,
)


def _two_class(name: str) -> str:
    guarded = f"CASE WHEN positive > 0 AND positive < rows THEN {name} END"
    return f"CAST({guarded} AS BIGINT) AS {name}" if name in _COUNT_COLUMNS else f"{guarded} AS {name}"


_STATION_SQL = f"""WITH {PREDICTIONS_SQL}, {metrics_sql('station_id, model_name')},
safe AS (
  SELECT station_id, model_name, rows, positive, positive / rows AS positive_rate_true, threshold,
         {", ".join(_two_class(m) for m in _STATION_METRICS)}
  FROM metrics
)"""
_STATION_OUT = "station_id, model_name, " + metric_list(
    "rows", "positive", "positive_rate_true", "threshold", *_STATION_METRICS
)


@query("station_metrics", f"{_STATION_SQL} SELECT {_STATION_OUT} FROM safe")
def q_station_metrics(spark, sf_dir):
    return rounded(station_model_metrics(predictions(spark, sf_dir)))


@query(
    "group_winners",
    f"""{_STATION_SQL}
SELECT {_STATION_OUT} FROM safe
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY pr_auc DESC NULLS LAST,
  recall_at_precision DESC NULLS LAST, recall_at_far DESC NULLS LAST, brier ASC NULLS LAST, model_name) = 1""",
)
def group_winners(spark, sf_dir):
    return rounded(station_winners(station_model_metrics(predictions(spark, sf_dir))))


_DELTA = ("roc_auc", "pr_auc", "brier", "log_loss", "accuracy", "precision", "recall", "f1", "positive_rate")


@query(
    "model_delta",
    f"{_MODEL_METRICS}, pair AS (SELECT o.*, n.* FROM (SELECT "
    + ", ".join(f"{m} AS o_{m}" for m in _DELTA)
    + " FROM metrics WHERE model_name = 'coarse') o, (SELECT "
    + ", ".join(f"{m} AS n_{m}" for m in _DELTA)
    + " FROM metrics WHERE model_name = 'fine') n) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r(f'o_{m}', 'old')}, {r(f'n_{m}', 'new')}, {r(f'n_{m} - o_{m}', 'delta')} FROM pair"
        for m in _DELTA
    ),
)
def model_delta(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("fire_label"),
        F.expr(SCORES["coarse"]).alias("old_prob"),
        F.expr(SCORES["fine"]).alias("new_prob"),
    )
    return rounded(metrics_delta(items, "old_prob", "new_prob"))


@query(
    "calibration_rank",
    f"""{_MODEL_METRICS}
SELECT CAST(row_number() OVER (ORDER BY brier, log_loss, pr_auc DESC) AS INTEGER) AS place,
       model_name AS method, {metric_list('rows', 'brier', 'log_loss', 'pr_auc')}
FROM metrics""",
)
def calibration_rank(spark, sf_dir):
    from pyspark.sql import Window as W

    scored = predictions(spark, sf_dir).withColumnRenamed("model_name", "method")
    ranked = rank_calibrations(classification_metrics(scored, ["method"]))
    # One row per method, so the unpartitioned window holds a handful of rows.
    place = F.row_number().over(
        W.orderBy(F.asc_nulls_last("brier"), F.asc_nulls_last("log_loss"), F.desc_nulls_last("pr_auc"))
    )
    return rounded(
        ranked.select(place.alias("place"), "method", "rows", "brier", "log_loss", "pr_auc")
    )


@query(
    "pooled_holdout",
    f"""
WITH {PREDICTIONS_SQL},
holdout AS (
  SELECT p.* FROM preds p JOIN (VALUES ('coarse', 240), ('fine', 365), ('mixed', 90)) h(model_name, days)
    USING (model_name)
  WHERE date >= (SELECT max(date) FROM preds) - to_days(h.days)
),
shared AS (
  SELECT station_id, date FROM holdout GROUP BY station_id, date HAVING count(DISTINCT model_name) = 3
)
SELECT model_name, station_id, count(*) AS rows, CAST(sum(fire_label) AS BIGINT) AS positive,
       {r("avg(pred_prob)", "mean_prob")}, min(date) AS first_date
FROM holdout SEMI JOIN shared USING (station_id, date) GROUP BY 1, 2""",
)
def pooled_holdout(spark, sf_dir):
    scored = predictions(spark, sf_dir)
    frames = [
        time_split(scored.filter(F.col("model_name") == name), days)
        .filter(F.col("split") == "test")
        for name, days in (("coarse", 240), ("fine", 365), ("mixed", 90))
    ]
    pooled = pooled_predictions(frames, common_keys=True)
    return rounded(
        pooled.groupBy("model_name", "station_id").agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("fire_label").alias("positive"),
            F.avg("pred_prob").alias("mean_prob"),
            F.min("date").alias("first_date"),
        )
    )


@query(
    "logit_clip",
    f"""
WITH s AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         greatest(least(l_discount * 10, 1 - 1e-6), 1e-6) AS p FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, {r("p", "clipped")}, {r("ln(p / (1 - p))", "logit")} FROM s""",
)
def logit_clip(spark, sf_dir):
    p = F.col("l_discount") * 10
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey",
            clip_probability(p).alias("clipped"), logit(p).alias("logit"),
        )
    )


# --- prediction output --------------------------------------------------------------

# Fixed values: (model, explicit, at false-alarm limit, holdout) thresholds.
_THRESHOLDS = [
    ("coarse", 0.7164, 0.61, 0.5),
    ("fine", None, 0.83, 0.5),
    ("mixed", None, None, 0.45),
]


def _sql_value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"


@query(
    "score_output",
    f"""
WITH {PREDICTIONS_SQL},
meta(model_name, a, b, c) AS (
  VALUES {", ".join("(" + ", ".join(map(_sql_value, t)) + ")" for t in _THRESHOLDS)}
),
stations AS (SELECT CAST(s_suppkey AS INTEGER) AS station_id, 33.0::DOUBLE + s_nationkey AS stn_lat,
                    124.0::DOUBLE + s_nationkey AS stn_lon FROM supplier)
SELECT p.model_name, CAST(p.station_id AS VARCHAR) AS station_id, p.date, {r("pred_prob", "pred_prob")},
       CASE WHEN pred_prob IS NULL THEN NULL WHEN pred_prob <= 0.4 THEN 'LOW'
            WHEN pred_prob <= 0.6 THEN 'MODERATE' WHEN pred_prob <= 0.8 THEN 'HIGH' ELSE 'EXTREME' END AS risk_level,
       coalesce(a, b, c, 0.5) AS alert_threshold,
       CAST(CASE WHEN pred_prob >= coalesce(a, b, c, 0.5) THEN 1 ELSE 0 END AS INTEGER) AS is_alert,
       stn_lat, stn_lon
FROM (SELECT * REPLACE (CASE WHEN model_name = 'coarse' AND pred_prob = 0 THEN NULL ELSE pred_prob END AS pred_prob)
      FROM preds) p
LEFT JOIN meta USING (model_name) LEFT JOIN stations USING (station_id)""",
)
def score_output(spark, sf_dir):
    meta = spark.createDataFrame(
        _THRESHOLDS,
        "model_name string, operating_threshold double, far_threshold double, holdout_threshold double",
    )
    stations = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("station_id"),
        (F.lit(33.0) + F.col("s_nationkey")).alias("stn_lat"),
        (F.lit(124.0) + F.col("s_nationkey")).alias("stn_lon"),
    )
    # The coarse model's zero scores play the part of NaN output.
    no_score = (F.col("model_name") == "coarse") & (F.col("pred_prob") == 0)
    scores = predictions(spark, sf_dir).withColumn(
        "pred_prob", F.when(no_score, F.lit(float("nan"))).otherwise(F.col("pred_prob"))
    )
    return rounded(prediction_table(scores, resolved_thresholds(meta), stations))


# --- splits -------------------------------------------------------------------------

_SPLIT_OUT = f"""count(*) AS rows, CAST(sum(y) AS BIGINT) AS positive, {r("avg(y)", "positive_rate")},
  min(date) AS start_date, max(date) AS end_date, CAST(CASE WHEN min(y) < max(y) THEN 1 ELSE 0 END AS INTEGER) AS two_classes"""
_ORDERS_Y = """
d AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)"""


def _labelled_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("fire_label"),
    )


@query(
    "time_split_summary",
    f"""
WITH {_ORDERS_Y}, c AS (SELECT max(date) AS m FROM d)
SELECT 'two' AS scheme, CASE WHEN date < m - 240 THEN 'train' ELSE 'test' END AS split, {_SPLIT_OUT}
FROM d, c GROUP BY 1, 2
UNION ALL
SELECT 'three', CASE WHEN date < m - 605 THEN 'train' WHEN date < m - 240 THEN 'calibration' ELSE 'test' END, {_SPLIT_OUT}
FROM d, c GROUP BY 1, 2""",
)
def time_split_summary(spark, sf_dir):
    orders = _labelled_orders(spark, sf_dir)
    two = split_summary(time_split(orders, 240)).select(F.lit("two").alias("scheme"), "*")
    three = split_summary(three_way_split(orders, 240, 365)).select(F.lit("three").alias("scheme"), "*")
    return rounded(two.unionByName(three))


@query(
    "yearly_folds",
    f"""
WITH {_ORDERS_Y}, years AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS test_year FROM d),
f AS (
  SELECT test_year,
         count(CASE WHEN year(date) = test_year THEN 1 END) AS test_rows,
         CAST(sum(CASE WHEN year(date) = test_year THEN y ELSE 0 END) AS BIGINT) AS test_positive,
         min(CASE WHEN year(date) = test_year THEN date END) AS test_start_date,
         max(CASE WHEN year(date) = test_year THEN date END) AS test_end_date,
         count(CASE WHEN year(date) < test_year THEN 1 END) AS train_rows,
         CAST(sum(CASE WHEN year(date) < test_year THEN y ELSE 0 END) AS BIGINT) AS train_positive,
         min(CASE WHEN year(date) < test_year THEN date END) AS train_start_date,
         max(CASE WHEN year(date) < test_year THEN date END) AS train_end_date
  FROM d, years GROUP BY test_year
)
SELECT *, CAST(CASE WHEN train_rows >= 365 AND train_positive > 0 AND train_positive < train_rows
  AND test_positive > 0 AND test_positive < test_rows THEN 1 ELSE 0 END AS INTEGER) AS eligible
FROM f WHERE test_year BETWEEN 1995 AND 2000""",
)
def q_yearly_folds(spark, sf_dir):
    return yearly_folds(_labelled_orders(spark, sf_dir), 1995, 2000)


@query(
    "class_weights",
    f"""
WITH {_ORDERS_Y}, c AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM d)
SELECT n AS rows, p AS positive, n - p AS negative, {r("p / n", "positive_rate")},
       {r("n / (2 * p)", "weight_positive")}, {r("n / (2 * (n - p))", "weight_negative")},
       {r("(n - p) / p", "scale_pos_weight")}
FROM c""",
)
def q_class_weights(spark, sf_dir):
    return rounded(class_weights(_labelled_orders(spark, sf_dir)))
