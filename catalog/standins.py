"""The driver tables read as the logical inputs of the engine, in Spark and in SQL.

There is no weather in the driver tables, so each logical input is derived from one of
them. ``*_SQL`` are the same derivations as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberday.functions.weather import wind_cos, wind_sin
from emberday.operators.base import station_day_base
from emberday.operators.daily import daily_base
from emberday.operators.hourly import HOURLY_COLUMNS, computed_once, hourly_observations


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; summation order differs between engines."""
    return df.withColumns(
        {n: F.round(n, digits) for n, t in df.dtypes if t in ("double", "float")}
    )


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL twin of ``rounded``; adding zero turns a negative zero into zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


# --- events as raw hourly text with dirty cells ------------------------------------


def _k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text observations: four time formats, unreadable times, sentinels, bad numbers."""
    e = computed_once(
        table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", _k().alias("k"))
    )
    whole = F.regexp_replace(F.substring(F.col("ts").cast("string"), 1, 19), r"[^0-9]", "")
    return e.select(
        F.col("user_id").cast("string").alias("stn"),
        F.when(F.col("k") == 99, F.lit("unknown"))
        .when(F.col("k") % 10 == 3, whole)
        .when(F.col("k") == 7, F.substring(F.col("ts").cast("string"), 1, 19))
        .when(F.col("k") == 8, F.substring(whole, 1, 8))
        .otherwise(F.concat(F.lit(" "), F.substring(whole, 1, 12)))
        .alias("TM"),
        F.when(F.col("k") == 4, F.lit("-99"))
        .when(F.col("k") == 5, F.lit("n/a"))
        .otherwise(F.col("value").cast("string"))
        .alias("TA"),
        F.when(F.col("k") == 6, F.lit("-9999")).otherwise(F.col("k").cast("string")).alias("POP"),
        (F.col("event_type") == "error").cast("int").cast("string").alias("IS_PRECIP"),
        wind_sin(F.col("k"), 100).cast("string").alias("WD_sin"),
        wind_cos(F.col("k"), 100).cast("string").alias("WD_cos"),
        F.when(F.col("k") == 9, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("event_type")))
        .alias("SKY"),
        "event_id",
        F.col("event_type").alias("kind"),
        F.to_date("ts").alias("day"),
    )


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_observations(raw_events(spark, sf_dir))


EVENTS_K_SQL = """
events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
)"""

HOURLY_EVENTS_SQL = f"""{EVENTS_K_SQL},
hourly AS (
  SELECT CAST(user_id AS INTEGER) AS station_id, obs_ts,
         CAST(obs_ts AS DATE) AS date, CAST(hour(obs_ts) AS INTEGER) AS hour,
         CASE WHEN k IN (4, 5) THEN NULL ELSE value END AS TA,
         CASE WHEN k = 6 THEN NULL ELSE CAST(k AS DOUBLE) END AS POP,
         CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS is_precip,
         sin(radians(k * 360.0 / 100)) AS WD_sin, cos(radians(k * 360.0 / 100)) AS WD_cos,
         CASE WHEN k = 9 THEN NULL ELSE upper(event_type) END AS SKY
  FROM (SELECT *, CASE WHEN k = 99 THEN NULL
                       WHEN k % 10 = 3 OR k = 7 THEN date_trunc('second', ts)
                       WHEN k = 8 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
                       ELSE date_trunc('minute', ts) END AS obs_ts
        FROM events_k)
  WHERE obs_ts IS NOT NULL
)"""


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as events: station and timestamp, not yet distinct."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("station_id"), F.col("ts").alias("fire_date"), "event_id", "value"
        )
    )


EVENT_LABELS_SQL = """
labels_d AS (
  SELECT DISTINCT CAST(user_id AS INTEGER) AS station_id, CAST(ts AS DATE) AS date, 1 AS fire_label
  FROM events WHERE event_type = 'purchase'
)"""


def event_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per user; the position is arithmetic on the id."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("station_id"))
    return ids.distinct().select(
        "station_id",
        (F.lit(33.0) + F.col("station_id") / 100).alias("stn_lat"),
        (F.lit(124.0) + F.col("station_id") / 50).alias("stn_lon"),
    )


EVENT_STATIONS_SQL = """
stations AS (
  SELECT DISTINCT CAST(user_id AS INTEGER) AS station_id,
         33.0::DOUBLE + CAST(user_id AS DOUBLE) / 100 AS stn_lat,
         124.0::DOUBLE + CAST(user_id AS DOUBLE) / 50 AS stn_lon
  FROM events
)"""

DAILY_BASE_SQL = """
flagged AS (
  SELECT *, max(CASE WHEN hour IN (0, 12) THEN 1 ELSE 0 END)
              OVER (PARTITION BY station_id, date) AS has_pref
  FROM hourly
),
sel AS (SELECT * FROM flagged WHERE has_pref = 0 OR hour IN (0, 12)),
sky_mode AS (
  SELECT station_id, date, SKY AS SKY_day FROM (
    SELECT station_id, date, SKY,
           row_number() OVER (PARTITION BY station_id, date ORDER BY count(*) DESC, SKY) AS rn
    FROM sel WHERE SKY IS NOT NULL GROUP BY station_id, date, SKY)
  WHERE rn = 1
),
sel_agg AS (
  SELECT station_id, date, avg(TA) AS TA_day, avg(POP) AS POP_day,
         avg(WD_sin) AS WD_sin_day, avg(WD_cos) AS WD_cos_day,
         CAST(coalesce(max(is_precip), 0) AS INTEGER) AS is_precip_day,
         CAST(count(*) AS INTEGER) AS obs_cnt_sel
  FROM sel GROUP BY station_id, date
),
day_agg AS (
  SELECT station_id, date,
         abs(avg(CASE WHEN hour = 12 THEN TA END) - avg(CASE WHEN hour = 0 THEN TA END)) AS TA_dtr_day,
         CAST(max(CASE WHEN hour = 0 THEN 1 ELSE 0 END) AS INTEGER) AS has_00_obs,
         CAST(max(CASE WHEN hour = 12 THEN 1 ELSE 0 END) AS INTEGER) AS has_12_obs
  FROM hourly GROUP BY station_id, date
),
daily AS (
  SELECT a.station_id, a.date, a.TA_day, d.TA_dtr_day, a.POP_day, a.is_precip_day, a.WD_sin_day,
         a.WD_cos_day, m.SKY_day, a.obs_cnt_sel, d.has_00_obs, d.has_12_obs
  FROM sel_agg a JOIN day_agg d USING (station_id, date)
  LEFT JOIN sky_mode m USING (station_id, date)
)"""

BASE_SQL = """
bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
calendar AS (
  SELECT station_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM stations, bounds
),
base AS (
  SELECT c.station_id, c.date, s.stn_lat, s.stn_lon, d.TA_day, d.TA_dtr_day, d.POP_day,
         d.is_precip_day, d.WD_sin_day, d.WD_cos_day, d.SKY_day, d.obs_cnt_sel, d.has_00_obs,
         d.has_12_obs, coalesce(l.fire_label, 0) AS fire_label,
         CAST(month(c.date) AS INTEGER) AS month, CAST(dayofyear(c.date) AS INTEGER) AS dayofyear,
         sin(2 * pi() * dayofyear(c.date) / 365) AS doy_sin,
         cos(2 * pi() * dayofyear(c.date) / 365) AS doy_cos
  FROM calendar c JOIN stations s USING (station_id)
  LEFT JOIN daily d USING (station_id, date) LEFT JOIN labels_d l USING (station_id, date)
)"""


# --- orders per region: a daily series with real gaps ------------------------------


def _orders_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


# Order status read as sky code.
_STATUS_SKY = {"F": "DB01", "O": "DB02", "P": "DB03"}


def hourly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations: region is the station, odd order keys are at noon."""
    hour = (F.col("o_orderkey") % 2 * 12).cast("int")
    sky = F.create_map(*[F.lit(x) for kv in _STATUS_SKY.items() for x in kv])
    return _orders_by_region(spark, sf_dir).select(
        F.col("n_regionkey").cast("int").alias("station_id"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=hour)).alias("obs_ts"),
        F.to_date("o_orderdate").alias("date"),
        hour.alias("hour"),
        (F.col("o_totalprice") / 997).alias("TA"),
        (F.col("o_custkey") % 100).cast("double").alias("POP"),
        F.when(F.col("o_totalprice") > 400000, 1.0).otherwise(0.0).alias("is_precip"),
        wind_sin(F.col("o_custkey") % 36).alias("WD_sin"),
        wind_cos(F.col("o_custkey") % 36).alias("WD_cos"),
        F.try_element_at(sky, F.col("o_orderstatus")).alias("SKY"),
    ).select(*HOURLY_COLUMNS)


def region_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("int").alias("station_id"),
        (F.lit(33.0) + F.col("r_regionkey")).alias("stn_lat"),
        (F.lit(124.0) + F.col("r_regionkey")).alias("stn_lon"),
    )


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return (
        _orders_by_region(spark, sf_dir)
        .filter(urgent)
        .select(
            F.col("n_regionkey").cast("int").alias("station_id"),
            F.to_date("o_orderdate").alias("date"),
        )
        .distinct()
        .withColumn("fire_label", F.lit(1))
    )


def region_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_day_base(
        daily_base(hourly_orders(spark, sf_dir)),
        region_stations(spark, sf_dir),
        region_labels(spark, sf_dir),
    )


REGION_HOURLY_SQL = """
region_orders AS (
  SELECT o.*, CAST(n.n_regionkey AS INTEGER) AS station_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
hourly AS (
  SELECT station_id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 2 * 12 AS INTEGER) AS hour,
         o_totalprice / 997 AS TA, CAST(o_custkey % 100 AS DOUBLE) AS POP,
         CASE WHEN o_totalprice > 400000 THEN 1.0 ELSE 0.0 END AS is_precip,
         sin(radians((o_custkey % 36) * 10.0)) AS WD_sin, cos(radians((o_custkey % 36) * 10.0)) AS WD_cos,
         CASE o_orderstatus WHEN 'F' THEN 'DB01' WHEN 'O' THEN 'DB02' WHEN 'P' THEN 'DB03' END AS SKY
  FROM region_orders
)"""
REGION_STATIONS_SQL = """
stations AS (
  SELECT CAST(r_regionkey AS INTEGER) AS station_id, 33.0::DOUBLE + r_regionkey AS stn_lat,
         124.0::DOUBLE + r_regionkey AS stn_lon
  FROM region
)"""
REGION_LABELS_SQL = """
labels_d AS (
  SELECT DISTINCT station_id, CAST(o_orderdate AS DATE) AS date, 1 AS fire_label
  FROM region_orders WHERE o_orderpriority = '1-URGENT'
)"""
REGION_BASE_SQL = ",".join(
    [REGION_HOURLY_SQL, REGION_STATIONS_SQL, REGION_LABELS_SQL, DAILY_BASE_SQL, BASE_SQL]
)


# --- lineitem per return flag: a daily series that is nearly complete --------------


def hourly_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: the return flag is the station."""
    hour = (F.col("l_linenumber") % 2 * 12).cast("int")
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.ascii("l_returnflag").alias("station_id"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=hour)).alias("obs_ts"),
        day.alias("date"),
        hour.alias("hour"),
        (F.col("l_extendedprice") / 997).alias("TA"),
        (F.col("l_discount") * 100).alias("POP"),
        F.when(F.col("l_tax") >= 0.07, 1.0).otherwise(0.0).alias("is_precip"),
        wind_sin(F.col("l_quantity"), 50).alias("WD_sin"),
        wind_cos(F.col("l_quantity"), 50).alias("WD_cos"),
        F.concat(F.lit("DB0"), (F.col("l_suppkey") % 4 + 1).cast("string")).alias("SKY"),
    )


def flag_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").alias("station_id"))
    return ids.distinct().select(
        "station_id",
        (F.lit(30.0) + F.col("station_id") / 10).alias("stn_lat"),
        (F.lit(120.0) + F.col("station_id") / 10).alias("stn_lon"),
    )


def flag_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_quantity") >= 45) & (F.col("l_discount") >= 0.09))
        .select(F.ascii("l_returnflag").alias("station_id"), F.to_date("l_shipdate").alias("date"))
        .distinct()
        .withColumn("fire_label", F.lit(1))
    )


def flag_share_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with more than the usual share of large discounted items.

    ``flag_labels`` asks for one such item a day, which every day of a large table has; a share
    leaves both classes at any size. Below some forty items a day the two agree.
    """
    wanted = (F.col("l_quantity") >= 45) & (F.col("l_discount") >= 0.09)
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.ascii("l_returnflag").alias("station_id"), F.to_date("l_shipdate").alias("date"))
        .agg(F.count(F.when(wanted, 1)).alias("_hits"), F.count(F.lit(1)).alias("_rows"))
    )
    usual = days.select(F.sum("_hits") / F.sum("_rows")).scalar()
    return days.filter(F.col("_hits") / F.col("_rows") > usual).select(
        "station_id", "date", F.lit(1).alias("fire_label")
    )


def flag_base(spark: SparkSession, sf_dir: str, labels=flag_labels) -> DataFrame:
    return station_day_base(
        daily_base(hourly_lineitem(spark, sf_dir)),
        flag_stations(spark, sf_dir),
        labels(spark, sf_dir),
    )


FLAG_BASE_SQL = ",".join(
    [
        """
hourly AS (
  SELECT CAST(ascii(l_returnflag) AS INTEGER) AS station_id, CAST(l_shipdate AS DATE) AS date,
         CAST(l_linenumber % 2 * 12 AS INTEGER) AS hour, l_extendedprice / 997 AS TA,
         l_discount * 100 AS POP, CASE WHEN l_tax >= 0.07 THEN 1.0 ELSE 0.0 END AS is_precip,
         sin(radians(l_quantity * 360.0 / 50)) AS WD_sin, cos(radians(l_quantity * 360.0 / 50)) AS WD_cos,
         'DB0' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS SKY
  FROM lineitem
),
stations AS (
  SELECT DISTINCT CAST(ascii(l_returnflag) AS INTEGER) AS station_id,
         30.0::DOUBLE + CAST(ascii(l_returnflag) AS DOUBLE) / 10 AS stn_lat,
         120.0::DOUBLE + CAST(ascii(l_returnflag) AS DOUBLE) / 10 AS stn_lon
  FROM lineitem
),
labels_d AS (
  SELECT DISTINCT CAST(ascii(l_returnflag) AS INTEGER) AS station_id,
         CAST(l_shipdate AS DATE) AS date, 1 AS fire_label
  FROM lineitem WHERE l_quantity >= 45 AND l_discount >= 0.09
)""",
        DAILY_BASE_SQL,
        BASE_SQL,
    ]
)


# --- lineitem as scored predictions ------------------------------------------------

# Model name to the score it gives a line item. The odd factors keep sums
# away from exact halves in the last compared digit. The first has 11 distinct
# scores, the second nearly as many as there are rows, the third a few hundred.
SCORES = {
    "coarse": "l_discount * 10 / 1.003D",
    "fine": "l_extendedprice / 105011D",
    "mixed": "(l_quantity + l_tax * 100) / 60.7D",
}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models scoring every line item; the label is the return flag R."""
    items = table(spark, sf_dir, "lineitem")
    scored = F.array(
        *[F.struct(F.lit(m).alias("model_name"), F.expr(e).alias("pred_prob")) for m, e in SCORES.items()]
    )
    return items.select(
        F.col("l_suppkey").cast("int").alias("station_id"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_returnflag") == "R").cast("int").alias("fire_label"),
        F.inline(scored),
    )


PREDICTIONS_SQL = """
preds AS (
  {}
)""".format(
    "\n  UNION ALL\n  ".join(
        f"SELECT CAST(l_suppkey AS INTEGER) AS station_id, CAST(l_shipdate AS DATE) AS date, "
        f"CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS fire_label, "
        f"'{m}' AS model_name, {e.replace('D', '::DOUBLE')} AS pred_prob FROM lineitem"
        for m, e in SCORES.items()
    )
)
