from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from emberday.functions.parsing import (
    clean_code,
    clean_measure,
    parse_daily_date,
    parse_event_timestamp,
    parse_obs_timestamp,
    pick_column,
)
from emberday.operators.hourly import hourly_observations


def column(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_pick_column_ignores_case_and_blanks_and_prefers_the_last_duplicate():
    assert pick_column([" tm ", "STN"], ["TM"]) == " tm "
    assert pick_column(["ta", "TA"], ["Ta"]) == "TA"
    assert pick_column(["a"], ["b"]) is None
    assert pick_column(["date", "TM"], ["TM", "date"]) == "TM"


def test_numbers(spark):
    given = ["1.5", " -2 ", "1e3", "5d", "abc", "", None, "-99", "-999", "-9999.0", "nan", ".5"]
    expected = [1.5, -2.0, 1000.0, None, None, None, None, None, None, None, None, 0.5]
    assert column(spark, given, clean_measure) == expected


def test_codes(spark):
    assert column(spark, [" db01 ", None], clean_code) == ["DB01", None]


def test_observation_times(spark):
    cases = {
        "202103251230": datetime(2021, 3, 25, 12, 30),
        " 202103251230 ": datetime(2021, 3, 25, 12, 30),
        "20210325123045": datetime(2021, 3, 25, 12, 30, 45),
        "2021-03-25 12:30": datetime(2021, 3, 25, 12, 30),
        "20211125": datetime(2021, 11, 25),
        "202113251230": None,
        "202103252530": None,
        "2021032512": None,
        "soon": None,
        None: None,
    }
    assert column(spark, list(cases), parse_obs_timestamp) == list(cases.values())


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Seoul"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(spark, ["202103140230"], lambda c: parse_obs_timestamp(c).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2021-03-14 02:30:00"]


def test_event_times_and_daily_dates(spark):
    assert column(spark, ["20210325123099", "2021"], parse_event_timestamp) == [
        datetime(2021, 3, 25, 12, 30), None,
    ]
    assert column(spark, ["2021032599", "2021-03-25", "20211399", "x"], parse_daily_date) == [
        date(2021, 3, 25), date(2021, 3, 25), None, None,
    ]


def test_hourly_resolves_aliases_and_fills_absent_columns(spark):
    raw = spark.createDataFrame(
        [("104", "202103250000", "-99", "db01"), ("x", "202103250000", "1", ""), ("105", "?", "1", "")],
        "`지점` string, `일시` string, `평균기온(°C)` string, sky string",
    )
    got = hourly_observations(raw).collect()
    assert [(r.station_id, r.hour, r.TA, r.POP, r.SKY) for r in got] == [(104, 0, None, None, "DB01")]
    assert hourly_observations(raw, stations=[105]).count() == 0
    with pytest.raises(ValueError):
        hourly_observations(raw.drop("지점"))
