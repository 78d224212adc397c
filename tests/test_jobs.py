from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberday.models.calibration import apply_isotonic, apply_platt, fit_isotonic, fit_platt
from emberday.models.classifiers import FeatureSet, coefficients, fit_boosted, fit_logistic, score
from emberday.models.preprocess import medians, modes, tree_stages
from emberday.operators.metrics import classification_metrics
from emberday.operators.splits import (
    class_weights,
    require_two_classes,
    split_summary,
    three_way_split,
    time_split,
    year_split,
    yearly_folds,
)
from emberday.plans.datasets import adopt_snapshot, build_datasets
from emberday.plans.prediction import predict_for_date
from emberday.plans.training import (
    calibration_study,
    evaluate_saved,
    evaluate_saved_sequence,
    load_fit,
    rolling_backtest,
    sequence_holdout,
    train_and_save,
    train_and_save_sequence,
)
from emberday.sources.csv_files import header_audit, read_csv_folder, read_hourly_folder
from emberday.sources.sinks import operating_threshold_update, write_csv, write_predictions
from emberday.sources.tables import read_model_meta

NUMERIC = FeatureSet(("a", "b"), ("c",))


@pytest.fixture(scope="module")
def table(spark):
    """Four years of two stations; the label follows ``a``, some inputs are missing."""
    n = F.col("id")
    noise = (F.xxhash64(n) % 1000) / 1000
    return spark.range(0, 2800).select(
        (n % 2 + 104).cast("int").alias("station_id"),
        F.date_add(F.lit(date(2018, 1, 1)), (n / 2).cast("int")).alias("date"),
        F.when(n % 17 != 0, F.sin(n.cast("double") * 0.7) + noise * 0.2).alias("a"),
        noise.alias("b"),
        F.when(n % 5 != 0, F.concat(F.lit("k"), (n % 3).cast("string"))).alias("c"),
        (F.sin(n.cast("double") * 0.7) + noise * 0.5 > 0.8).cast("int").alias("fire_label"),
        F.lit(37.0).alias("stn_lat"),
        F.lit(128.0).alias("stn_lon"),
    )


def test_splits(spark):
    df = spark.createDataFrame(
        [(date(2020, 1, 1) + timedelta(i), i % 2) for i in range(100)], "date date, fire_label int"
    )
    two = {r.split: (r.rows, r.end_date) for r in split_summary(time_split(df, 10)).collect()}
    assert two == {"train": (89, date(2020, 3, 29)), "test": (11, date(2020, 4, 9))}
    three = {r.split: r.rows for r in split_summary(three_way_split(df, 10, 20)).collect()}
    assert three == {"train": 69, "calibration": 20, "test": 11}
    assert split_summary(year_split(df, 2020)).first().split == "test"
    with pytest.raises(ValueError):
        time_split(df, 0)
    with pytest.raises(ValueError):
        require_two_classes(split_summary(time_split(df.withColumn("fire_label", F.lit(0)), 10)))
    w = class_weights(df).first()
    assert (w.rows, w.positive, w.weight_positive, w.scale_pos_weight) == (100, 50, 1.0, 1.0)
    assert class_weights(df.withColumn("fire_label", F.lit(0))).first().scale_pos_weight == 1.0


def test_folds(table):
    folds = {r.test_year: r for r in yearly_folds(table, min_train_rows=365).collect()}
    assert folds[2018].eligible == 0 and folds[2018].train_rows == 0
    assert folds[2019].eligible == 1 and folds[2019].train_rows == 730
    assert folds[2020].train_end_date == date(2019, 12, 31)
    assert [r.test_year for r in yearly_folds(table, 2019, 2019).collect()] == [2019]


def test_medians_and_modes(spark):
    df = spark.createDataFrame(
        [(1.0, None, "x"), (2.0, None, "y"), (4.0, None, "y"), (9.0, None, "x"), (None, None, None)],
        "a double, b double, c string",
    )
    assert medians(df, ["a", "b"]) == {"a": 3.0}
    assert modes(df, ["c"]) == {"c": "x"}


def test_logistic_learns_and_handles_missing_and_unseen(table):
    fit = fit_logistic(time_split(table, 240).filter("split = 'train'"), NUMERIC)
    test = table.withColumn("c", F.when(F.col("c") == "k1", "new").otherwise(F.col("c")))
    r = classification_metrics(score(fit, test, "m", ["fire_label"])).first()
    assert r.rows == 2800 and r.roc_auc > 0.9
    assert coefficients(fit)[0][0] == "a"


def test_logistic_weights_match_a_direct_solution(spark):
    """Two points per class: the penalised optimum is found by scalar search."""
    import math

    df = spark.createDataFrame(
        [(date(2020, 1, 1), y, x) for x, y in ((1.0, 1), (0.0, 1), (0.0, 0), (-1.0, 0))], "date date, fire_label int, x double"
    )
    fit = fit_logistic(df, FeatureSet(("x",)))
    std = math.sqrt(0.5)

    def loss(w):  # symmetric data, so the intercept is 0
        z = [(1 / std, 1), (0.0, 1), (0.0, -1), (-1 / std, -1)]
        return sum(math.log1p(math.exp(-s * w * v)) for v, s in z) + w * w / 2

    best = min((i / 10000 for i in range(30000)), key=loss)
    assert coefficients(fit)[0][1] == pytest.approx(best, abs=2e-3)


def test_boosted_with_round_selection_and_many_categories(table):
    train = table.withColumn("c", F.concat(F.lit("v"), (F.xxhash64("date") % 40).cast("string")))
    fit = fit_boosted(train, NUMERIC, rounds=4, depth=3, rate=0.3, validation_days=200)
    assert 1 <= fit.params["rounds"] <= 4
    assert len(fit.model.stages[-1].trees) == fit.params["rounds"]
    assert classification_metrics(score(fit, train, "m", ["fire_label"])).first().roc_auc > 0.9
    typed = train.withColumn("fire_label", F.col("fire_label").cast("double"))
    stages, bins = tree_stages(typed, ["a"], ["c"], "fire_label", target_encoded=["c"])
    assert bins == 32 and stages.transform(typed).select("features").first().features.size == 2


def test_calibration(spark):
    rows = [(int(i % 10 < i // 100), (i // 100) / 10 * 0.5 + 0.01) for i in range(1000)]
    df = spark.createDataFrame([*rows, (0, None)], "fire_label int, pred_prob double")
    for out in (apply_platt(fit_platt(df), df), apply_isotonic(fit_isotonic(df), df)):
        pairs = sorted({(a.pred_prob, b.pred_prob) for a, b in zip(df.collect(), out.collect()) if a.pred_prob is not None})
        assert all(x[1] <= y[1] for x, y in zip(pairs, pairs[1:]))
        assert all(0 <= p <= 1 for _, p in pairs)
        assert out.filter("pred_prob is null").count() == 1
    exact = {round(r.pred_prob, 6) for r in apply_isotonic(fit_isotonic(df), df).dropna().collect()}
    assert exact == {i / 10 for i in range(10)}


def test_train_store_score_and_update_threshold(spark, table, tmp_path):
    folder = str(tmp_path / "models")
    train_and_save(spark, table, "logistic", "lr", folder, NUMERIC, 200)
    train_and_save(spark, table, "boosted", "gbt", folder, NUMERIC, 200, rounds=2, depth=2)
    fit, meta = load_fit(spark, folder, "gbt")
    assert fit.features == NUMERIC and meta.first().holdout_days == 200
    assert evaluate_saved(spark, folder, "lr", table).first().rows == 402
    assert evaluate_saved(spark, folder, "lr", table, holdout_days=10).first().rows == 22

    pred = predict_for_date(spark, table, "2021-06-01", folder, ["lr", "gbt"])
    got = pred.collect()
    assert {(r.model_name, r.station_id) for r in got} == {(m, s) for m in ("lr", "gbt") for s in ("104", "105")}
    assert all(r.is_alert == int(r.pred_prob >= r.alert_threshold) for r in got)
    assert got[0].alert_threshold == pytest.approx(
        meta.sparkSession.read.json(f"{folder}/{got[0].model_name}/meta").first().far_threshold
    )
    with pytest.raises(ValueError):
        predict_for_date(spark, table, "1999-01-01", folder, ["lr"])

    out = write_predictions(pred, str(tmp_path / "out"))
    assert spark.read.parquet(out).count() == 4
    write_predictions(pred.filter("model_name = 'lr'"), str(tmp_path / "out"))
    assert spark.read.parquet(out).count() == 4
    assert spark.read.option("header", True).csv(write_predictions(pred, str(tmp_path / "out"), "csv")).count() == 4
    with pytest.raises(ValueError):
        write_predictions(pred, str(tmp_path / "out"), "xlsx")

    limits = spark.createDataFrame([("lr", 0.77), ("gbt", None)], "model_name string, recall_at_far_threshold double")
    lr_meta = read_model_meta(spark, f"{folder}/lr/meta")
    updated = operating_threshold_update(lr_meta, limits, 0.05).first()
    assert (updated.operating_threshold, updated.operating_threshold_policy) == (0.77, "recall_at_far")
    same = operating_threshold_update(meta, limits, 0.05).first()
    assert same.operating_threshold is None and same.operating_threshold_policy is None


def test_study_and_backtest(table):
    metrics, bins, predictions = calibration_study(table, "logistic", NUMERIC, 200, 300)
    ranked = metrics.collect()
    assert {r.method for r in ranked} == {"base", "platt", "isotonic"}
    assert [r.brier for r in ranked] == sorted(r.brier for r in ranked)
    assert predictions.count() == 3 * 402 and bins.agg(F.sum("rows")).first()[0] == 3 * 402
    folds, stations, pooled = rolling_backtest(table, "logistic", NUMERIC, 2019, 2020)
    assert {r.test_year: r.rows for r in folds.select("test_year", F.col("test_rows").alias("rows")).collect()} == {2019: 730, 2020: 732}
    assert stations.count() == 4 and pooled.count() == 1462
    with pytest.raises(ValueError):
        rolling_backtest(table, "logistic", NUMERIC, 2030, 2031)


HEADER = "STN,TM,TA,POP,is_precip,WD_sin,WD_cos,SKY"


def weather_lines(station, days, start=date(2020, 1, 1)):
    for d in range(days):
        day = (start + timedelta(d)).strftime("%Y%m%d")
        for hour in ("0000", "1200"):
            yield f"{station},{day}{hour},{d % 7}.5,{d % 100},{int(d % 6 == 0)},0.5,{d % 3}.25,DB0{d % 4 + 1}"


def test_csv_folder_to_datasets(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text("\n".join([HEADER, *weather_lines(104, 40)]) + "\n", encoding="utf-8")
    korean = HEADER.replace("STN", "지점").replace("TM", "일시") + ",비고"
    lines = [f"{x},맑음" for x in weather_lines(105, 40)]
    (raw / "b.csv").write_text("\n".join([korean, *lines]) + "\n", encoding="cp949")
    (raw / "note.txt").write_text("no table")

    loaded = read_csv_folder(spark, str(raw))
    assert loaded.count() == 160
    assert {r[0] for r in loaded.select("__source_file").distinct().collect()} == {"a.csv", "b.csv"}
    assert {r[0] for r in loaded.select("비고").distinct().collect()} == {None, "맑음"}
    audit = {r.file: (r.stn_col, r.lat_col, r.encoding) for r in header_audit(spark, str(raw)).collect()}
    assert audit == {"a.csv": ("STN", None, "UTF-8"), "b.csv": ("지점", None, "cp949")}
    with pytest.raises(FileNotFoundError):
        read_csv_folder(spark, str(raw), "*.tsv")

    events = spark.createDataFrame([(104, date(2020, 1, 20)), (105, date(2020, 2, 5))], "station_id int, fire_date date")
    events.write.parquet(str(tmp_path / "events"))
    summary = build_datasets(spark, str(raw), str(tmp_path / "events"), str(tmp_path / "out"))
    got = {r.table: (r.rows, r.positive) for r in summary.collect()}
    assert got["station_day_base"] == (80, 2) and got["wide_features"] == (80, 2)
    # The second file names its station and time columns in Korean; its rows are all there.
    assert got["sequence_samples"] == (52, 2)

    again = adopt_snapshot(spark, str(tmp_path / "out" / "station_day_base"), str(tmp_path / "v"), "2")
    assert {r.table: r.rows for r in again.collect()}["station_day_base"] == 80
    with pytest.raises(Exception):
        adopt_snapshot(spark, str(tmp_path / "out" / "station_day_base"), str(tmp_path / "v"), "2")

    samples = spark.read.parquet(str(tmp_path / "out" / "sequence_samples"))
    labelled = samples.withColumn("fire_label", (F.dayofmonth("date") % 2).cast("int"))
    folder = str(tmp_path / "models")
    record = train_and_save_sequence(spark, labelled, folder, holdout_days=10, max_iter=20).first()
    assert (record.model_type, record.test_rows, len(record.features)) == ("sequence", 22, 16)
    _, scored, _ = sequence_holdout(labelled, 10, max_iter=20)
    assert scored.count() == 22 and scored.filter("pred_prob between 0 and 1").count() == 22
    direct = classification_metrics(scored).first()
    stored = evaluate_saved_sequence(spark, folder, labelled).first()
    assert (stored.rows, stored.brier) == (22, pytest.approx(direct.brier))
    wide = spark.read.parquet(str(tmp_path / "out" / "wide_features"))
    day = predict_for_date(spark, wide, "2020-02-09", folder, [], labelled).collect()
    assert {(r.model_name, r.station_id, r.alert_threshold) for r in day} == {
        ("sequence", "104", 0.5), ("sequence", "105", 0.5),
    }
    write_csv(scored, str(tmp_path / "scored"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scored")).count() == 22


def test_raw_files_with_quotes_breaks_repeats_and_late_encoding(spark, tmp_path):
    raw = tmp_path / "odd"
    raw.mkdir()
    # cp949 shows only in the body, far behind an ASCII header
    late = "STN,TM,SKY\n" + "104,202001010000,A\n" * 200_000 + "105,202001010000,맑음\n"
    (raw / "late.csv").write_bytes(late.encode("cp949"))
    (raw / "quoted.csv").write_text('"STN","TM","SKY"\n104,202001010000,"line\nbreak ""x"""\n', encoding="utf-8")
    (raw / "twice.csv").write_text("STN,TM,TA,ta\n104,202001010000,1.5,2.5\n", encoding="utf-8")
    rows = {r["__source_file"]: r for r in read_csv_folder(spark, str(raw)).where("STN <> '104' or __source_file <> 'late.csv'").collect()}
    assert rows["late.csv"].SKY == "맑음"
    assert rows["quoted.csv"].SKY == 'line\nbreak "x"'
    hourly = read_hourly_folder(spark, str(raw))
    assert [r.TA for r in hourly.where("TA is not null").collect()] == [2.5]
    audit = {r.file: r.stn_col for r in header_audit(spark, str(raw)).collect()}
    assert audit["quoted.csv"] == "STN"
