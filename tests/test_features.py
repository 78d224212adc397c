import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberday.operators.features import (
    CURRENT_DAY,
    categorical_names,
    feature_names,
    past_n_days,
    wide_features,
)
from emberday.operators.sequences import (
    CHANNELS,
    channel_stats,
    fit_scale,
    flattened,
    sequence_samples,
    standardised,
)

START = date(2020, 2, 1)
BASE_SCHEMA = (
    "station_id int, date date, stn_lat double, stn_lon double, TA_day double, TA_dtr_day double, "
    "POP_day double, is_precip_day int, WD_sin_day double, WD_cos_day double, SKY_day string, "
    "obs_cnt_sel int, has_00_obs int, has_12_obs int, fire_label int"
)


def series(stations=(7, 3), days=60, holes=0.2, seed=1):
    rng = random.Random(seed)

    def maybe(v):
        return None if rng.random() < holes else v

    return [
        (
            s, START + timedelta(d), 37.0 + s, 128.0 + s,
            maybe(round(rng.uniform(-5, 30), 1)), maybe(round(rng.uniform(0, 15), 1)),
            maybe(float(rng.randrange(0, 100, 10))), maybe(rng.choice([0, 0, 0, 1])),
            maybe(rng.uniform(-1, 1)), maybe(rng.uniform(-1, 1)),
            maybe(rng.choice(["DB01", "DB02", "DB03", "DB04"])),
            maybe(rng.choice([1, 2])), maybe(1), maybe(rng.choice([0, 1])), rng.choice([0, 1]),
        )
        for s in stations
        for d in range(days)
    ]


@pytest.fixture(scope="module")
def base_rows():
    return series()


@pytest.fixture(scope="module")
def wide(spark, base_rows):
    frame = wide_features(spark.createDataFrame(base_rows, BASE_SCHEMA)).toPandas()
    return frame.sort_values(["station_id", "date"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def plain(base_rows):
    names = [f.split()[0] for f in BASE_SCHEMA.split(", ")]
    frame = pd.DataFrame(base_rows, columns=names)
    return frame.sort_values(["station_id", "date"]).reset_index(drop=True)


def same(a, b):
    for x, y in zip(a, b):
        if pd.isna(x) or pd.isna(y):
            assert pd.isna(x) and pd.isna(y)
        elif isinstance(x, str) or isinstance(y, str):
            assert x == y
        else:
            assert x == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("lag", [1, 3, 7, 14])
@pytest.mark.parametrize("column", CURRENT_DAY)
def test_lags(wide, plain, column, lag):
    same(wide[f"{column}_lag{lag}"], plain.groupby("station_id")[column].shift(lag))


@pytest.mark.parametrize("window", [3, 7, 14])
def test_trailing_windows(wide, plain, window):
    for column, how in (("TA_day", "mean"), ("obs_cnt_sel", "mean"), ("is_precip_day", "sum")):
        expected = []
        for _, part in plain.groupby("station_id"):
            rolled = part[column].astype(float).shift(1).rolling(window, min_periods=1)
            expected += list(getattr(rolled, how)())
        same(wide[f"{column}_roll{how}_{window}"], expected)


@pytest.mark.parametrize("window", [3, 7, 14])
def test_trailing_mode(wide, plain, window):
    expected = []
    for _, part in plain.groupby("station_id"):
        sky = list(part["SKY_day"])
        for i in range(len(sky)):
            seen = [v for v in sky[max(0, i - window) : i] if isinstance(v, str)]
            expected.append(min(seen, key=lambda v: (-seen.count(v), v)) if seen else None)
    same(wide[f"SKY_day_mode_{window}"], expected)


def test_dry_spell(wide, plain):
    expected = []
    for _, part in plain.groupby("station_id"):
        run = 0
        for yesterday in [None, *list(part["is_precip_day"])[:-1]]:
            if yesterday is None or pd.isna(yesterday):
                run = 0
                expected.append(None)
                continue
            run = run + 1 if int(yesterday) == 0 else 0
            expected.append(float(run))
    same(wide["dry_spell_days"], expected)


def test_feature_list_matches_the_table(wide):
    assert len(feature_names()) == 78 and len(categorical_names()) == 9
    assert set(feature_names()) <= set(wide.columns)
    assert not set(feature_names()) & set(CURRENT_DAY)


def test_nothing_leaks_from_the_day_itself_or_later(spark, base_rows, wide):
    day = START + timedelta(30)
    changed = [
        (*r[:4], 99.0, 99.0, 99.0, 1, 0.9, 0.9, "DB04", 9, 0, 0, 1 - r[14])
        if r[1] >= day else r
        for r in base_rows
    ]
    other = wide_features(spark.createDataFrame(changed, BASE_SCHEMA)).toPandas()
    other = other.sort_values(["station_id", "date"]).reset_index(drop=True)
    until = wide["date"] <= day
    for name in feature_names():
        same(wide.loc[until, name], other.loc[until, name])


def test_past_days_go_by_date_not_by_row(spark):
    df = spark.createDataFrame(
        [(1, date(2021, 1, 1), 1.0, "a"), (1, date(2021, 1, 3), 3.0, "b"), (1, date(2021, 1, 4), 4.0, None)],
        "station_id int, date date, x double, s string",
    )
    got = past_n_days(df, 2).orderBy("date").collect()
    assert [(r.x_minus1d, r.x_minus2d, r.s_minus1d, r.s_minus2d) for r in got] == [
        (None, None, None, None), (None, 1.0, None, "a"), (3.0, None, "b", None),
    ]


def test_past_days_equal_lags_on_dense_data(spark, base_rows, wide):
    frame = spark.createDataFrame(base_rows, BASE_SCHEMA)
    got = past_n_days(frame, 3, ["TA_day"]).orderBy("station_id", "date").toPandas()
    same(got["TA_day_minus1d"], wide["TA_day_lag1"])
    same(got["TA_day_minus3d"], wide["TA_day_lag3"])


def test_sequences(spark):
    rows = series(days=20, holes=0.0)
    rows[16] = (*rows[16][:14], None)  # no label on day 16 of the first station
    rows[20 + 2] = (*rows[20 + 2][:10], None, *rows[20 + 2][11:])  # no sky on day 2 of the second
    samples = sequence_samples(spark.createDataFrame(rows, BASE_SCHEMA)).collect()
    found = {(r.station_id, (r.date - START).days) for r in samples}
    assert found == {(7, 14), (7, 15), (7, 17), (7, 18), (7, 19), (3, 17), (3, 18), (3, 19)}
    one = next(r for r in samples if r.station_id == 7 and (r.date - START).days == 15)
    assert len(one.x_dyn) == 14 and all(len(step) == len(CHANNELS) for step in one.x_dyn)
    assert one.x_dyn[0][0] == pytest.approx(rows[1][4], abs=1e-5)
    assert one.x_dyn[13][0] == pytest.approx(rows[14][4], abs=1e-5)
    assert list(one.x_static) == [1.0, 44.0, 135.0]  # station 7 comes after station 3
    hot = one.x_dyn[0][6:10]
    assert sum(hot) == 1 and hot[int(rows[1][10][-1]) - 1] == 1


def test_channel_stats_and_standardising(spark):
    samples = sequence_samples(spark.createDataFrame(series(days=25, holes=0.0), BASE_SCHEMA)).cache()
    stacked = [step for r in samples.collect() for step in r.x_dyn]
    stats = {r.channel: r for r in channel_stats(samples).collect()}
    frame = pd.DataFrame(stacked, columns=CHANNELS)
    assert stats["TA_day"].mean == pytest.approx(frame["TA_day"].mean())
    assert stats["TA_day"].std == pytest.approx(frame["TA_day"].std(ddof=0))
    assert stats["has_00_obs"].std == 1.0  # constant channel
    scale = fit_scale(samples).first().asDict()
    assert [len(v) for v in scale.values()] == [13, 13, 3, 3]
    scaled = standardised(samples, scale)
    flat = flattened(scaled).select("x_flat").collect()
    assert all(len(r.x_flat) == 14 * 13 + 3 for r in flat)
    assert sum(r.x_flat[0] for r in flat) / len(flat) == pytest.approx(0, abs=1.0)
    again = channel_stats(scaled).filter(F.col("channel") == "TA_day").first()
    assert (again["mean"], again["std"]) == (pytest.approx(0, abs=1e-5), pytest.approx(1, abs=1e-5))
