"""Expensive raw columns are made once, however often parsing and aggregation name them."""

import datetime as dt

from emberday.operators.daily import daily_base, daily_compact
from emberday.operators.hourly import hourly_observations


def _raw(spark):
    raw = spark.createDataFrame(
        [("1", "202401010000", "4,5", "x"), ("1", "202401010500", "9,5", "y"), ("2", "202401010500", "n/a", None)],
        "stn string, TM string, number string, SKY string",
    )
    return raw.selectExpr("stn", "TM", "regexp_replace(number, ',', '.') AS TA", "SKY")


def test_raw_columns_are_not_repeated_in_the_plan(spark):
    plan = daily_base(hourly_observations(_raw(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_compact_table_parses_its_input_once(spark, rows):
    compact = daily_compact(hourly_observations(_raw(spark)))
    assert "regexp_replace(" not in compact._jdf.queryExecution().optimizedPlan().toString()
    day = dt.date(2024, 1, 1)
    # only the station with a row at hour 00 or 12 remains
    assert rows(compact.select("station_id", "date", "TA"), "station_id") == [(1, day, 4.5)]


def test_compact_table_takes_all_hours_when_none_is_preferred(spark, rows):
    late = _raw(spark).filter("TM like '%0500'")
    compact = daily_compact(hourly_observations(late))
    assert rows(compact.select("station_id", "TA"), "station_id") == [(1, 9.5), (2, None)]
