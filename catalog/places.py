"""Queries on positions, forecasts, validation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import (
    EVENTS_K_SQL,
    HOURLY_EVENTS_SQL,
    hourly_events,
    r,
    rounded,
    table,
)
from emberday.functions.geo import METRIC_GRID, project, unproject
from emberday.operators.events import normalise_events
from emberday.operators.forecast import (
    before_target_day,
    daily_forecast,
    latest_issue_rows,
    normalise_forecast,
)
from emberday.operators.nearest import nearest_planar, nearest_station
from emberday.operators.prefix import exact_quantiles
from emberday.operators.quality import (
    date_gap_counts,
    distinct_values,
    extent,
    most_missing,
    null_profile,
    number_summary,
    quality_report,
    raw_text_profile,
    row_count_check,
    top_values,
    value_counts,
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


# --- nearest station ----------------------------------------------------------------

# Station registry: the mean position of each label. Points: every vector.


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"),
    )


def _label_stations(spark, sf_dir):
    return (
        _points(spark, sf_dir)
        .groupBy(F.col("label").cast("int").alias("station_id"))
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    )


_POINTS_SQL = """
points AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
registry AS (SELECT CAST(label AS INTEGER) AS station_id, avg(x) AS x, avg(y) AS y FROM points GROUP BY 1)"""


def _nearest_sql(px: str, py: str, sx: str, sy: str) -> str:
    return f"""
pairs AS (
  SELECT p.*, s.station_id, sqrt(({px} - {sx}) ** 2 + ({py} - {sy}) ** 2) AS d
  FROM points p, registry s
),
hits AS (SELECT * FROM pairs QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY d) = 1)"""


@query(
    "nearest_station",
    f"WITH {_POINTS_SQL}, {_nearest_sql('p.x', 'p.y', 's.x', 's.y')} "
    f"SELECT vec_id, station_id, {r('d', 'dist_m')} FROM hits",
)
def q_nearest_station(spark, sf_dir):
    joined = nearest_planar(_points(spark, sf_dir), _label_stations(spark, sf_dir))
    return rounded(joined.select("vec_id", "station_id", "dist_m"))


@query(
    "nearest_station_grid",
    f"""
WITH {_POINTS_SQL.replace("registry AS (SELECT CAST(label AS INTEGER) AS station_id, avg(x) AS x, avg(y) AS y FROM points GROUP BY 1)",
"registry AS (SELECT CAST(vec_id AS INTEGER) AS station_id, CAST(embedding[3] AS DOUBLE) AS x, CAST(embedding[4] AS DOUBLE) AS y FROM embeddings)")},
{_nearest_sql('p.x', 'p.y', 's.x', 's.y')}
SELECT vec_id, station_id, {r('d', 'dist_m')} FROM hits""",
)
def nearest_station_grid(spark, sf_dir):
    """As many stations as points, through the grid."""
    stations = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("station_id"),
        F.get("embedding", F.lit(2)).cast("double").alias("x"),
        F.get("embedding", F.lit(3)).cast("double").alias("y"),
    )
    joined = nearest_planar(_points(spark, sf_dir), stations, small_registry=0)
    return rounded(joined.select("vec_id", "station_id", "dist_m"))


def _mercator_sql(lon: str, lat: str) -> tuple[str, str]:
    """The projection of ``functions.geo`` spelled out in SQL."""
    g = METRIC_GRID
    c = repr(g.conformal_factor)
    sin_lat = f"sin(radians({lat}))"
    t = f"sinh(atanh({sin_lat}) - {c} * atanh({c} * {sin_lat}))"
    d_lon = f"radians({lon} - {g.lon0})"
    xi, eta = f"atan2({t}, cos({d_lon}))", f"atanh(sin({d_lon}) / sqrt(1 + ({t}) * ({t})))"
    radius = repr(g.scale * g.rectifying_radius)
    north = " + ".join(
        [xi, *[f"({a!r}) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(g.alpha, 1)]]
    )
    east = " + ".join(
        [eta, *[f"({a!r}) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(g.alpha, 1)]]
    )
    return (
        f"({g.false_easting!r} + {radius} * ({east}))",
        f"({g.false_northing!r} + {radius} * ({north} - {g.origin_arc!r}))",
    )


_GEO_POINTS_SQL = _POINTS_SQL.replace(
    "CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y",
    "127.5::DOUBLE + 5 * CAST(embedding[1] AS DOUBLE) AS x, 36::DOUBLE + 5 * CAST(embedding[2] AS DOUBLE) AS y",
)


def _dirty(spark, sf_dir):
    """Points and stations with missing, NaN and infinite coordinates, an outlier, a dense cluster, shared places."""
    e = table(spark, sf_dir, "embeddings")
    x, y, u, v = (F.get("embedding", F.lit(k)).cast("double") for k in range(4))
    spoiled = F.expr("CASE vec_id % 50 WHEN 7 THEN double('NaN') WHEN 8 THEN double('Infinity') ELSE CAST(NULL AS DOUBLE) END")
    points = e.select(
        "vec_id",
        F.when(F.col("vec_id") % 50 < 7, x).when(F.col("vec_id") % 50 > 9, x * F.when(F.col("vec_id") == 11, 1e6).otherwise(1.0))
        .otherwise(spoiled).alias("x"),
        y.alias("y"),
    )
    near = F.when(F.col("vec_id") % 3 == 0, 1e-6).otherwise(1.0)
    stations = e.select(
        F.col("vec_id").cast("int").alias("station_id"),
        F.when(F.col("vec_id") % 40 == 3, F.expr("double('NaN')")).otherwise(u * near).alias("x"),
        (v * near).alias("y"),
    )
    twins = stations.where(F.col("station_id") % 20 == 1).withColumn("station_id", F.col("station_id") + 1_000_000)
    return points, stations.unionByName(twins)


@query(
    "nearest_station_dirty",
    f"""
WITH points AS (
  SELECT vec_id, CASE vec_id % 50 WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL
    ELSE CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id = 11 THEN 1e6 ELSE 1.0 END END AS x,
    CAST(embedding[2] AS DOUBLE) AS y FROM embeddings
), plain AS (
  SELECT CAST(vec_id AS INTEGER) AS station_id,
    CAST(embedding[3] AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN 1e-6 ELSE 1.0 END AS x,
    CAST(embedding[4] AS DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN 1e-6 ELSE 1.0 END AS y
  FROM embeddings WHERE vec_id % 40 <> 3
), registry AS (
  SELECT * FROM plain UNION ALL SELECT station_id + 1000000, x, y FROM plain WHERE station_id % 20 = 1
),
{_nearest_sql('p.x', 'p.y', 's.x', 's.y').strip()}
SELECT p.vec_id, h.station_id, {r('h.d', 'dist_m')}
FROM points p LEFT JOIN (SELECT * FROM hits WHERE x IS NOT NULL) h USING (vec_id)""",
)
def nearest_station_dirty(spark, sf_dir):
    points, stations = _dirty(spark, sf_dir)
    return rounded(nearest_planar(points, stations, small_registry=0).select("vec_id", "station_id", "dist_m"))


@query(
    "nearest_station_geo",
    "WITH {}, projected AS (SELECT vec_id, {} AS x, {} AS y FROM points), "
    "registry_m AS (SELECT station_id, {} AS x, {} AS y FROM registry), {} SELECT vec_id, station_id, {} FROM hits".format(
        _GEO_POINTS_SQL,
        *_mercator_sql("x", "y"),
        *_mercator_sql("x", "y"),
        _nearest_sql("p.x", "p.y", "s.x", "s.y").replace("FROM points p, registry s", "FROM projected p, registry_m s"),
        r("d", "dist_m", 3),
    ),
)
def nearest_station_geo(spark, sf_dir):
    points = _points(spark, sf_dir).select(
        "vec_id", "label",
        (F.lit(127.5) + 5 * F.col("x")).alias("lon"), (F.lit(36.0) + 5 * F.col("y")).alias("lat"),
    )
    stations = points.groupBy(F.col("label").cast("int").alias("station_id")).agg(
        F.avg("lon").alias("stn_lon"), F.avg("lat").alias("stn_lat")
    )
    joined = nearest_station(points.drop("label"), stations)
    return rounded(joined.select("vec_id", "station_id", "dist_m"), 3)


@query(
    "project_roundtrip",
    "WITH {}, p AS (SELECT vec_id, x, y, {} AS e, {} AS n FROM points) "
    "SELECT vec_id, {}, {}, {}, {} FROM p".format(
        _GEO_POINTS_SQL.split(",\nregistry")[0],
        *_mercator_sql("x", "y"),
        r("e", "easting", 3), r("n", "northing", 3), r("x", "lon", 7), r("y", "lat", 7),
    ),
)
def project_roundtrip(spark, sf_dir):
    points = _points(spark, sf_dir).select(
        "vec_id", (F.lit(127.5) + 5 * F.col("x")).alias("lon"), (F.lit(36.0) + 5 * F.col("y")).alias("lat")
    )
    metric = points.select("vec_id", project(F.col("lon"), F.col("lat")).alias("m"))
    back = metric.select("vec_id", "m", unproject(F.col("m.x"), F.col("m.y")).alias("d"))
    return back.select(
        "vec_id",
        F.round("m.x", 3).alias("easting"),
        F.round("m.y", 3).alias("northing"),
        F.round("d.lon", 7).alias("lon"),
        F.round("d.lat", 7).alias("lat"),
    )


@query("extent", f"WITH {_POINTS_SQL} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM points")
def q_extent(spark, sf_dir):
    return extent(_points(spark, sf_dir))


# --- forecasts ----------------------------------------------------------------------


def _forecast(spark, sf_dir):
    """Orders as forecasts: issued on the order date, for a day up to three days later."""
    ahead = (F.col("o_orderkey") % 4).cast("int")
    issue = F.date_format(F.to_date("o_orderdate"), "yyyyMMdd")
    target = F.date_format(F.date_add(F.to_date("o_orderdate"), ahead), "yyyyMMdd")
    noon = F.when(F.col("o_orderkey") % 2 == 0, F.lit("0000")).otherwise(F.lit("1200"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("R"), (F.col("o_custkey") % 20).cast("string")).alias("REG_ID"),
        F.concat(issue, F.lit("1800")).alias("TM_FC"),
        F.concat(target, noon).alias("TM_EF"),
        (F.col("o_custkey") % 100).cast("string").alias("ST"),
        F.concat(F.lit("db0"), (F.col("o_orderkey") % 4 + 1).cast("string")).alias("SKY"),
        F.substring("o_orderpriority", 1, 1).alias("PREP"),
        "o_orderkey",
    )


_FORECAST_SQL = """
fc AS (
  SELECT 'R' || CAST(o_custkey % 20 AS VARCHAR) AS forecast_region_id,
         CAST(o_orderdate AS DATE) + INTERVAL 18 HOUR AS issue,
         CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS DATE) AS date,
         CAST(o_custkey % 100 AS DOUBLE) AS pop, 'DB0' || CAST(o_orderkey % 4 + 1 AS VARCHAR) AS sky,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prep
  FROM orders
),
usable AS (SELECT * FROM fc WHERE issue <= CAST(date AS TIMESTAMP)),
newest AS (SELECT *, rank() OVER (PARTITION BY forecast_region_id, date ORDER BY issue DESC) AS rk FROM usable)"""


@query(
    "latest_forecast",
    f"""
WITH {_FORECAST_SQL}, chosen AS (SELECT * FROM newest WHERE rk = 1),
m AS (
  SELECT forecast_region_id, date, sky FROM chosen GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY forecast_region_id, date ORDER BY count(*) DESC, sky) = 1
)
SELECT c.forecast_region_id, c.date, max(c.issue) AS forecast_issue_ts, count(*) AS forecast_rows,
       {r("avg(c.pop)", "POP_day")}, any_value(m.sky) AS SKY_forecast, max(c.prep) AS forecast_precip_code
FROM chosen c JOIN m USING (forecast_region_id, date) GROUP BY 1, 2""",
)
def latest_forecast(spark, sf_dir):
    forecast = normalise_forecast(_forecast(spark, sf_dir))
    return rounded(daily_forecast(forecast, before_target_day()))


@query(
    "latest_forecast_rows",
    f"""
WITH {_FORECAST_SQL.replace("usable AS (SELECT * FROM fc WHERE issue <= CAST(date AS TIMESTAMP))", "usable AS (SELECT * FROM fc)")}
SELECT forecast_region_id, date, issue AS forecast_issue_ts, pop AS POP, sky AS SKY,
       prep AS forecast_precip_code
FROM newest WHERE rk = 1""",
)
def q_latest_forecast_rows(spark, sf_dir):
    rows = latest_issue_rows(normalise_forecast(_forecast(spark, sf_dir)))
    return rows.select(
        "forecast_region_id", "date", "forecast_issue_ts", "POP", "SKY", "forecast_precip_code"
    )


# --- events -------------------------------------------------------------------------


def _event_points(spark, sf_dir):
    """Purchases as points; those of even users are listed twice."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    digits = F.regexp_replace(F.substring(F.col("ts").cast("string"), 1, 16), r"[^0-9]", "")
    copies = F.when(F.col("user_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return e.select(
        digits.alias("OCCRR_DTM"),
        F.concat(F.lit("P"), (F.col("user_id") % 7).cast("string")).alias("CTPRV_NM"),
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("SGNG_NM"),
        (F.lit(124.0) + F.col("user_id") / 50).alias("lon"),
        (F.lit(33.0) + F.col("user_id") / 100).alias("lat"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


@query(
    "dedup_events",
    f"""
WITH once AS (
  SELECT DISTINCT date_trunc('minute', ts) AS fire_datetime, 'P' || CAST(user_id % 7 AS VARCHAR) AS CTPRV_NM,
         'S' || CAST(user_id AS VARCHAR) AS SGNG_NM, 124.0::DOUBLE + CAST(user_id AS DOUBLE) / 50 AS lon,
         33.0::DOUBLE + CAST(user_id AS DOUBLE) / 100 AS lat
  FROM events WHERE event_type = 'purchase'
)
SELECT row_number() OVER (ORDER BY fire_datetime, lon, lat) - 1 AS fire_id, fire_datetime,
       CAST(fire_datetime AS DATE) AS fire_date, CAST(year(fire_datetime) AS INTEGER) AS year,
       CAST(month(fire_datetime) AS INTEGER) AS month, CTPRV_NM, SGNG_NM, {r("lon", "lon")}, {r("lat", "lat")}
FROM once""",
)
def dedup_events(spark, sf_dir):
    events = normalise_events(_event_points(spark, sf_dir), sequential=True, deduplicate=True)
    return rounded(events)


# --- validation and profiles --------------------------------------------------------


def _dirty_base(spark, sf_dir):
    """Hourly rows wearing the base table's columns, so that every rule is broken somewhere."""
    h = hourly_events(spark, sf_dir)
    return h.select(
        "station_id",
        F.when(F.col("hour") == 5, F.lit(None)).otherwise(F.col("date")).alias("date"),
        F.when(F.col("hour") == 6, F.lit(None)).otherwise(F.col("station_id") / 100).alias("stn_lat"),
        (F.col("station_id") / 50).alias("stn_lon"),
        F.when(F.col("POP") == 50, F.lit("much")).otherwise(F.col("POP").cast("string")).alias("POP_day"),
        F.when(F.col("hour") == 7, F.lit(2)).otherwise(F.col("is_precip").cast("int")).alias("is_precip_day"),
        F.when(F.col("SKY").isin("VIEW", "CLICK"), F.lit("DB01")).otherwise(F.col("SKY")).alias("SKY_day"),
        F.when(F.col("hour") == 8, F.lit(3)).otherwise(F.lit(0)).alias("fire_label"),
    )


@query(
    "quality_report",
    f"""
WITH {HOURLY_EVENTS_SQL},
d AS (
  SELECT station_id, CASE WHEN hour = 5 THEN NULL ELSE date END AS date,
         CASE WHEN hour = 6 THEN NULL ELSE station_id / 100 END AS stn_lat, hour, POP, SKY
  FROM hourly
)
SELECT 'label_is_binary' AS rule, count(CASE WHEN hour = 8 THEN 1 END) AS violations FROM d
UNION ALL SELECT 'pop_is_number', count(CASE WHEN POP = 50 THEN 1 END) FROM d
UNION ALL SELECT 'precip_is_binary', count(CASE WHEN hour = 7 THEN 1 END) FROM d
UNION ALL SELECT 'sky_is_known', count(CASE WHEN SKY NOT IN ('VIEW', 'CLICK') THEN 1 END) FROM d
UNION ALL SELECT 'position_is_known', count(CASE WHEN hour = 6 THEN 1 END) FROM d
UNION ALL SELECT 'date_is_known', count(CASE WHEN date IS NULL THEN 1 END) FROM d
UNION ALL SELECT 'no_future_rows', count(CASE WHEN date > DATE '2024-01-20' THEN 1 END) FROM d
UNION ALL SELECT 'key_is_unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY station_id, date)
UNION ALL SELECT 'station_is_one_place', count(*) FROM (
  SELECT station_id FROM d GROUP BY station_id HAVING count(stn_lat) > 0 AND count(stn_lat) < count(*))""",
)
def q_quality_report(spark, sf_dir):
    return quality_report(_dirty_base(spark, sf_dir), F.lit("2024-01-20").cast("date"))


@query(
    "row_count_check",
    """
SELECT (SELECT count(*) FROM documents) AS left_rows,
       (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id)) AS joined_rows,
       CAST((SELECT count(*) FROM documents) = (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id)) AS INTEGER) AS preserved""",
)
def q_row_count_check(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return row_count_check(documents, documents.join(table(spark, sf_dir, "labels"), "doc_id", "left"))


_DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


@query(
    "profile_nulls",
    "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)', 'null_ratio')}, "
        f"{r(f'100 * avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)', 'null_percent', 2)} FROM d"
        for c in _DOC_COLUMNS
    ),
)
def profile_nulls(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(null_profile(documents, _DOC_COLUMNS))


@query(
    "most_missing",
    "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS v FROM d"
        for c in _DOC_COLUMNS
    )
    + f') SELECT "column", {r("v", "null_ratio")}, {r("100 * v", "null_percent", 2)} FROM m WHERE v > 0',
)
def q_most_missing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(most_missing(documents))


@query("profile_values", "SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value NULLS FIRST LIMIT 10")
def profile_values(spark, sf_dir):
    return top_values(table(spark, sf_dir, "documents"), "source", 10)


@query("value_counts", "SELECT user_id AS value, count(*) AS n FROM events GROUP BY user_id")
def q_value_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "events"), "user_id")


@query("distinct_values", "SELECT DISTINCT source AS value FROM documents ORDER BY value LIMIT 30")
def q_distinct_values(spark, sf_dir):
    return distinct_values(table(spark, sf_dir, "documents"), "source", 30)


@query(
    "raw_text_profile",
    f"""
WITH {EVENTS_K_SQL}
SELECT {r("avg(CASE WHEN k = 9 THEN 1 ELSE 0 END)", "null_ratio")},
       count(CASE WHEN k <> 9 AND event_type = 'view' THEN 1 END) AS blank_rows, count(*) AS rows
FROM events_k""",
)
def q_raw_text_profile(spark, sf_dir):
    from catalog.standins import raw_events

    cells = raw_events(spark, sf_dir).withColumn(
        "SKY", F.when(F.col("SKY") == " view", F.lit("  ")).otherwise(F.col("SKY"))
    )
    return rounded(raw_text_profile(cells, "SKY"))


@query(
    "date_gaps",
    """
SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS date_diff, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def date_gaps(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("fire_date"))
    return date_gap_counts(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


@query(
    "profile_distance",
    f"""
WITH {_POINTS_SQL}, {_nearest_sql('p.x', 'p.y', 's.x', 's.y')}
SELECT count(d) AS count, {r("avg(d)", "mean")}, {r("stddev_samp(d)", "std")}, {r("min(d)", "min")},
       {r("quantile_cont(d, 0.25)", "p25")}, {r("quantile_cont(d, 0.5)", "p50")},
       {r("quantile_cont(d, 0.75)", "p75")}, {r("max(d)", "max")}
FROM hits""",
)
def profile_distance(spark, sf_dir):
    joined = nearest_planar(_points(spark, sf_dir), _label_stations(spark, sf_dir))
    return rounded(number_summary(joined, "dist_m"))


@query(
    "exact_quantiles",
    f"""
SELECT l_returnflag, {r("quantile_cont(l_extendedprice, 0.01)", "p01")},
       {r("quantile_cont(l_extendedprice, 0.5)", "p50")}, {r("quantile_cont(l_extendedprice, 0.999)", "p999")}
FROM lineitem GROUP BY l_returnflag""",
)
def q_exact_quantiles(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    wanted = {"p01": 0.01, "p50": 0.5, "p999": 0.999}
    return rounded(exact_quantiles(items, ["l_returnflag"], "l_extendedprice", wanted))
