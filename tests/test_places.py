import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from emberday.functions.geo import project, unproject
from emberday.operators.events import event_day, in_years, normalise_events
from emberday.operators.nearest import nearest_planar, nearest_station
from emberday.operators.quality import (
    date_gap_counts,
    number_summary,
    quality_report,
    require_valid_base,
    row_count_check,
    table_overview,
    top_values,
)
from emberday.sources.tables import default_stations


def brute(points, stations):
    out = set()
    for i, x, y in points:
        if x is None or y is None:
            out.add((i, None))
            continue
        d = {s: math.hypot(x - a, y - b) for s, a, b in stations}
        out |= {(i, s) for s, v in d.items() if v == min(d.values())}
    return out


def frames(spark, points, stations):
    return (
        spark.createDataFrame(points, "id int, x double, y double"),
        spark.createDataFrame(stations, "station_id int, x double, y double"),
    )


@pytest.mark.parametrize("small", [1000, 0])
def test_nearest_matches_brute_force(spark, small):
    rng = random.Random(4)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(300)] + [(900, None, 1.0), (901, 5.0, None)]
    # A third of the points share one spot; stations crowd one corner, some lie far outside.
    points += [(1000 + i, 1.5, 1.5) for i in range(150)]
    stations = [(i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(60)]
    stations += [(100 + i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(60)]
    p, s = frames(spark, points, stations)
    got = nearest_planar(p, s, small_registry=small).collect()
    assert {(r.id, r.station_id) for r in got} == brute(points, stations)
    assert len(got) == len(points)


@pytest.mark.parametrize("small", [1000, 0])
def test_equal_distances_give_a_row_each_or_the_lowest_id(spark, small):
    points = [(1, 0.0, 0.0), (2, 5.0, 0.0)]
    stations = [(20, 1.0, 0.0), (10, -1.0, 0.0), (30, 5.0, 0.0), (31, 5.0, 0.0)]
    p, s = frames(spark, points, stations)
    got = {(r.id, r.station_id, r.dist_m) for r in nearest_planar(p, s, small_registry=small).collect()}
    assert got == {(1, 20, 1.0), (1, 10, 1.0), (2, 30, 0.0), (2, 31, 0.0)}
    one = nearest_planar(p, s, one_per_point=True, small_registry=small).collect()
    assert {(r.id, r.station_id) for r in one} == {(1, 10), (2, 30)}


def test_empty_inputs(spark):
    p, s = frames(spark, [(1, 0.0, 0.0)], [(1, 1.0, 1.0)])
    assert [(r.id, r.station_id) for r in nearest_planar(p, s.limit(0)).collect()] == [(1, None)]
    assert nearest_planar(p.limit(0), s, small_registry=0).count() == 0


def test_projection(spark):
    stations = default_stations(spark)
    xy = stations.select("station_id", project(F.col("stn_lon"), F.col("stn_lat")).alias("p")).orderBy("station_id").collect()
    gap = math.hypot(xy[0].p.x - xy[1].p.x, xy[0].p.y - xy[1].p.y)
    assert gap == pytest.approx(6675.968, abs=1e-3)
    origin = stations.select(project(F.lit(127.5), F.lit(38.0)).alias("p")).first().p
    assert (origin.x, origin.y) == (pytest.approx(1e6, abs=1e-6), pytest.approx(2e6, abs=1e-6))
    back = stations.select(
        "stn_lon", "stn_lat", unproject(project(F.col("stn_lon"), F.col("stn_lat"))["x"], project(F.col("stn_lon"), F.col("stn_lat"))["y"]).alias("d")
    ).collect()
    for r in back:
        assert (r.d.lon, r.d.lat) == (pytest.approx(r.stn_lon, abs=1e-10), pytest.approx(r.stn_lat, abs=1e-10))


def test_nearest_station_in_degrees_keeps_the_point(spark):
    points = spark.createDataFrame([(1, 128.85, 37.81), (2, 128.9, 37.74)], "id int, lon double, lat double")
    got = nearest_station(points, default_stations(spark)).orderBy("id").collect()
    assert [(r.id, r.lon, r.station_id) for r in got] == [(1, 128.85, 104), (2, 128.9, 105)]
    assert got[0].dist_m == pytest.approx(765.8, abs=2)


def test_event_table(spark):
    points = spark.createDataFrame(
        [("202003251230", "A", 1.0, 2.0), ("202003251230", "A", 1.0, 2.0), ("2020032x", "B", 3.0, 4.0), ("201903251230", "C", 0.0, 0.0)],
        "OCCRR_DTM string, CTPRV_NM string, lon double, lat double",
    )
    kept = in_years(points)
    assert kept.count() == 3
    events = normalise_events(kept, sequential=True).orderBy("fire_id").collect()
    assert [r.fire_id for r in events] == [0, 1, 2]
    assert events[0].fire_datetime == datetime(2020, 3, 25, 12, 30) and events[2].fire_datetime is None
    assert normalise_events(kept, deduplicate=True).count() == 2
    assert events[0].fire_date == date(2020, 3, 25) and (events[0].year, events[0].month) == (2020, 3)
    days = {r[0] for r in kept.select(event_day(kept.columns)).collect()}
    assert days == {date(2020, 3, 25), None}
    with pytest.raises(ValueError):
        normalise_events(points.drop("OCCRR_DTM"))


BASE = "station_id int, date date, stn_lat double, stn_lon double, POP_day double, is_precip_day int, SKY_day string, fire_label int"


def test_quality_rules(spark):
    d = date(2021, 1, 1)
    good = [(1, d, 1.0, 1.0, 1.0, 0, "DB01", 0), (1, date(2021, 1, 2), 1.0, 1.0, None, None, None, 1)]
    clean = spark.createDataFrame(good, BASE)
    assert {r.violations for r in quality_report(clean).collect()} == {0}
    require_valid_base(clean)
    bad = spark.createDataFrame([*good, (1, d, 2.0, 1.0, 1.0, 3, "DB09", 2)], BASE)
    found = {r.rule: r.violations for r in quality_report(bad, F.lit(d)).collect()}
    assert found == {
        "label_is_binary": 1, "pop_is_number": 0, "precip_is_binary": 1, "sky_is_known": 1, "position_is_known": 0,
        "date_is_known": 0, "no_future_rows": 1, "key_is_unique": 1, "station_is_one_place": 1,
    }
    with pytest.raises(ValueError):
        require_valid_base(bad)


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (4.0, None), (9.0, "b")], "v double, s string")
    r = number_summary(df, "v").first()
    assert (r["count"], r["mean"], r["p50"], r["max"]) == (4, 4.0, 3.0, 9.0)
    assert [(x.value, x.n) for x in top_values(df, "s", 2).collect()] == [(None, 2), ("a", 1)]
    assert row_count_check(df, df.union(df)).first() == (4, 8, 0)
    assert [(x.column, x.type, x.rows) for x in table_overview(df).collect()] == [("v", "double", 4), ("s", "string", 4)]
    gaps = spark.createDataFrame([(date(2021, 1, 2), date(2021, 1, 1))], "date date, fire_date date")
    assert date_gap_counts(gaps).collect() == [(1, 1)]


def test_sequential_ids_number_crowded_moments_and_copies(spark):
    from emberday.operators.prefix import sequential_ids

    t = datetime(2021, 1, 1, 0, 0, 0, 5)
    rows = [(t, 1.0, 2.0)] * 300 + [(t, float(i), None) for i in range(200)]
    rows += [(datetime(2020, 1, 1), 9.0, 9.0), (None, 0.0, 0.0), (datetime(2021, 1, 1), 50.0, 1.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, lon double, lat double").repartition(5)
    got = sequential_ids(df, "id", "t", ["lon", "lat"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(len(rows)))
    assert got[0].t == datetime(2020, 1, 1) and got[1].lon == 50.0 and got[-1].t is None
    middle = [(r.lon, -1.0 if r.lat is None else r.lat) for r in got[2:-1]]
    assert middle == sorted(middle)


def _fold_by_hand(points, stations):
    def finite(*v):
        return all(x is not None and math.isfinite(x) for x in v)

    out = set()
    for i, x, y in points:
        usable = [(math.hypot(x - a, y - b), s) for s, a, b in stations if finite(a, b)] if finite(x, y) else []
        least = min(usable, default=(None,))[0]
        out |= {(i, s) for d, s in usable if d == least} or {(i, None)}
    return out


@pytest.mark.parametrize("small", [256, 0])
def test_nearest_with_dirty_coordinates(spark, small):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)]
    points += [(100, math.nan, 1.0), (101, math.inf, 1.0), (102, None, 1.0), (103, 1e9, -1e9), (104, 50.0, 50.0)]
    # a cluster far denser than the extent, stations at one place, ties around point 104
    stations = [(f"c{i}", 10 + rng.random() * 1e-3, 10 + rng.random() * 1e-3) for i in range(120)]
    stations += [("s1", 70.0, 70.0), ("s2", 70.0, 70.0), ("t1", 49.0, 50.0), ("t2", 51.0, 50.0), ("bad", math.nan, 3.0), ("null", None, 3.0)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    s = spark.createDataFrame(stations, "station_id string, x double, y double")
    got = nearest_planar(p, s, small_registry=small)
    assert {(r.id, r.station_id) for r in got.collect()} == _fold_by_hand(points, stations)
    # a level is written before the next begins: the plan does not grow with the levels
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 8
