from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from emberday.operators.base import (
    events_with_weather,
    fire_labels,
    station_day_base,
    station_day_calendar,
    with_labels,
)
from emberday.operators.daily import daily_base, daily_compact
from emberday.operators.forecast import before_target_day, daily_forecast, normalise_forecast
from emberday.plans.datasets import contract_base

D = date(2021, 3, 25)
SCHEMA = (
    "station_id int, obs_ts timestamp_ntz, date date, hour int, TA double, POP double, "
    "is_precip double, WD_sin double, WD_cos double, SKY string"
)


def hourly(spark, *observations):
    """(station, hour, TA, is_precip, SKY) on one day."""
    return spark.createDataFrame(
        [(s, datetime(2021, 3, 25, h), D, h, ta, 10.0, p, 0.0, 1.0, sky) for s, h, ta, p, sky in observations],
        SCHEMA,
    )


def only(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def test_preferred_hours_and_range(spark):
    r = only(daily_base(hourly(spark, (1, 0, 12.3, 0.0, "DB02"), (1, 12, 18.7, None, "DB02"), (1, 15, 99.0, 1.0, "DB01"))))
    assert r.TA_day == pytest.approx(15.5) and r.TA_dtr_day == pytest.approx(6.4)
    assert (r.obs_cnt_sel, r.has_00_obs, r.has_12_obs, r.is_precip_day, r.SKY_day) == (2, 1, 1, 0, "DB02")


def test_fallback_is_per_station_day(spark):
    days = daily_base(
        hourly(spark, (1, 3, 1.0, 1.0, "B"), (1, 4, 3.0, None, "A"), (2, 0, 5.0, None, None), (2, 4, 9.0, 1.0, "A"))
    )
    first, second = days.orderBy("station_id").collect()
    assert (first.TA_day, first.TA_dtr_day, first.obs_cnt_sel, first.has_00_obs) == (2.0, None, 2, 0)
    assert (first.SKY_day, first.is_precip_day) == ("A", 1)  # tie to the smallest code
    assert (second.TA_day, second.SKY_day, second.is_precip_day, second.obs_cnt_sel) == (5.0, None, 0, 1)
    assert second.TA_dtr_day is None


def test_missing_temperature_at_noon_gives_no_range_but_counts(spark):
    r = only(daily_base(hourly(spark, (1, 0, 2.0, None, None), (1, 12, None, None, None))))
    assert (r.TA_day, r.TA_dtr_day, r.obs_cnt_sel, r.has_12_obs) == (2.0, None, 2, 1)


def test_compact_table_uses_one_fallback_for_the_whole_input(spark):
    mixed = hourly(spark, (1, 0, 1.0, None, "DB03"), (2, 5, 9.0, None, "DB01"))
    r = only(daily_compact(mixed))
    assert (r.station_id, r.TA, r.TA_dtr, r.SKY, r.is_precip) == (1, 1.0, None, 3, 0)
    no_preferred = hourly(spark, (1, 5, 1.0, 1.0, "7"), (1, 6, 4.0, None, "7"), (2, 7, 1.0, None, "fog"))
    first, second = daily_compact(no_preferred).orderBy("station_id").collect()
    assert (first.TA, first.TA_dtr, first.SKY, first.is_precip) == (2.5, 3.0, 7, 1)
    assert second.SKY is None


def test_calendar_spans_all_stations_and_labels_default_to_zero(spark):
    stations = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)], "station_id int, stn_lat double, stn_lon double")
    daily = spark.createDataFrame(
        [(1, date(2021, 1, 1), 5.0), (2, date(2021, 1, 3), 7.0)], "station_id int, date date, TA_day double"
    )
    assert station_day_calendar(stations, daily).count() == 9
    events = spark.createDataFrame(
        [("2", datetime(2021, 1, 3, 4)), ("2", datetime(2021, 1, 3, 9)), (None, datetime(2021, 1, 3)), ("2", None)],
        "station_id string, fire_date timestamp_ntz",
    )
    labels = fire_labels(events)
    assert labels.count() == 1
    base = station_day_base(daily, stations, labels)
    assert base.count() == 9
    assert base.filter("fire_label = 1").select("station_id", "TA_day").collect() == [(2, 7.0)]
    assert base.filter("station_id = 3 and TA_day is null and fire_label = 0").count() == 3
    assert base.filter("date = '2021-01-03'").select("dayofyear", "month").first() == (3, 1)
    assert with_labels(daily, labels).agg(F.sum("fire_label")).first()[0] == 1


def test_labels_need_their_columns(spark):
    with pytest.raises(KeyError):
        fire_labels(spark.createDataFrame([(1,)], "station_id int"))


def test_events_meet_weather_and_clashes_are_renamed(spark):
    events = spark.createDataFrame([(1, D, "a"), (None, D, "b")], "station_id int, fire_date date, TA string")
    weather = spark.createDataFrame([(1, D, 4.0)], "station_id int, date date, TA double")
    got = {r.TA: r.TA_w for r in events_with_weather(events, weather).collect()}
    assert got == {"a": 4.0, "b": None}


FORECAST = "REG_ID string, TM_FC string, TM_EF string, ST string, SKY string, PREP string"


def test_newest_issue_and_cutoff(spark):
    raw = spark.createDataFrame(
        [
            ("R", "202103241800", "202103250000", "20", "DB02", "0"),
            ("R", "202103241800", "202103251200", "10", "DB01", "0"),
            ("R", "202103240600", "202103251200", "90", "DB04", "1"),
            ("R", "202103250600", "202103251200", "70", "DB03", "1"),
        ],
        FORECAST,
    )
    forecast = normalise_forecast(raw)
    trained = only(daily_forecast(forecast, before_target_day()))
    assert (trained.POP_day, trained.SKY_forecast, trained.forecast_precip_code) == (15.0, "DB01", 0)
    assert only(daily_forecast(forecast)).POP_day == 70.0


def test_contract_tables_to_base(spark):
    meta = spark.createDataFrame(
        [(104, 128.85535, 37.80456, "11D20501"), (105, 128.89098, 37.75146, "11D20501")],
        "STN_ID int, LON double, LAT double, FCT_ID string",
    )
    obs = spark.createDataFrame(
        [("104", "202103250000", "12.3", "18", "0.0"), ("104", "202103251200", "18.7", "20", "0.0"), ("999", "202103251200", "1", "1", "1")],
        "STN string, TM string, TA string, WD string, RN string",
    )
    forecast = spark.createDataFrame(
        [("11D20501", "202103241800", "202103250000", "20", "DB02", "0"), ("11D20501", "202103241800", "202103251200", "10", "DB02", "0")],
        FORECAST,
    )
    labels = spark.createDataFrame([(104, D)], "station_id int, fire_date date")
    first, second = contract_base(meta, obs, forecast, labels).orderBy("station_id").collect()
    assert (first.station_id, first.TA_day, first.POP_day, first.SKY_day) == (104, 15.5, 15.0, "DB02")
    assert first.TA_dtr_day == pytest.approx(6.4)
    assert (first.fire_label, first.is_precip_day, first.obs_cnt_sel) == (1, 0, 2)
    assert first.WD_sin_day == pytest.approx((0.0 + -0.3420201433) / 2)
    assert (second.station_id, second.TA_day, second.fire_label) == (105, None, 0)


def test_bad_ids_and_dates_leave_the_job_running(spark):
    events = spark.createDataFrame(
        [("104", "2021-03-25"), ("999999999999", "2021-03-25"), ("104.5", "2021-03-25"), ("0x10", "2021-03-25"), ("105", "n/a")],
        "station_id string, fire_date string",
    )
    assert [(r.station_id, r.date) for r in fire_labels(events).collect()] == [(104, D)]


def test_a_station_at_two_places_or_a_repeated_day_fails(spark):
    from emberday.operators.base import station_day_base

    labels = spark.createDataFrame([(1, D, 1)], "station_id int, date date, fire_label int")
    daily = spark.createDataFrame([(1, D, 5.0)], "station_id int, date date, TA_day double")
    two = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0)], "station_id int, stn_lat double, stn_lon double")
    one = two.limit(1)
    assert station_day_base(daily, one.union(one), labels).count() == 1
    with pytest.raises(Exception, match="more than one station"):
        station_day_base(daily, two, labels).collect()
    with pytest.raises(Exception, match="more than one daily"):
        station_day_base(daily.union(daily), one, labels).collect()
