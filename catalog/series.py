"""Queries on observations, the daily tables and the features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.standins import (
    BASE_SQL,
    DAILY_BASE_SQL,
    EVENT_LABELS_SQL,
    EVENT_STATIONS_SQL,
    EVENTS_K_SQL,
    FLAG_BASE_SQL,
    HOURLY_EVENTS_SQL,
    REGION_BASE_SQL,
    event_labels,
    event_stations,
    flag_base,
    hourly_events,
    hourly_orders,
    r,
    raw_events,
    region_base,
    rounded,
    table,
)
from emberday.functions.calendar import with_calendar_columns
from emberday.functions.parsing import (
    clean_measure,
    parse_daily_date,
    parse_event_timestamp,
    parse_obs_timestamp,
    to_number,
)
from emberday.functions.risk import fill_category
from emberday.functions.weather import precip_flag, sky_code, wind_cos, wind_sin
from emberday.operators.base import (
    events_with_weather,
    fire_labels,
    station_day_base,
    with_labels,
)
from emberday.operators.daily import daily_base, daily_compact, daily_file_means
from emberday.operators.features import (
    BINARY,
    CONTINUOUS,
    CURRENT_DAY,
    LAGS,
    QUALITY,
    WINDOWS,
    lag_columns,
    past_n_days,
    rolling_mean_columns,
    rolling_mode_columns,
    rolling_sum_columns,
    wide_features,
    with_dry_spell,
)
from emberday.operators.hourly import daily_file_rows
from emberday.operators.sequences import CHANNELS, channel_stats, sequence_samples

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- cleaning -----------------------------------------------------------------------


@query(
    "parse_timestamps",
    f"""
WITH {EVENTS_K_SQL}
SELECT event_id,
       CASE WHEN k = 99 THEN NULL
            WHEN k % 10 = 3 OR k = 7 THEN date_trunc('second', ts)
            WHEN k = 8 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
            ELSE date_trunc('minute', ts) END AS obs_ts,
       CASE WHEN k = 99 OR k = 7 OR k = 8 THEN NULL
            ELSE date_trunc('minute', ts) END AS event_ts,
       CASE WHEN k = 99 THEN NULL ELSE CAST(ts AS DATE) END AS day
FROM events_k""",
)
def parse_timestamps(spark, sf_dir):
    text = F.trim("TM")
    return raw_events(spark, sf_dir).select(
        "event_id",
        parse_obs_timestamp(F.col("TM")).alias("obs_ts"),
        parse_event_timestamp(text).alias("event_ts"),
        parse_daily_date(text).alias("day"),
    )


@query(
    "clean_numeric",
    f"""
WITH {EVENTS_K_SQL}
SELECT event_id, CAST(user_id AS DOUBLE) AS station_id,
       CASE WHEN k IN (4, 5) THEN NULL ELSE value END AS TA,
       CASE WHEN k = 6 THEN NULL ELSE CAST(k AS DOUBLE) END AS POP,
       CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_precip
FROM events_k WHERE event_type IN ('error', 'view', 'click')""",
)
def clean_numeric(spark, sf_dir):
    raw = raw_events(spark, sf_dir)
    return raw.filter(F.col("kind").isin("error", "view", "click")).select(
        "event_id",
        clean_measure(F.col("stn")).alias("station_id"),
        *[clean_measure(F.col(c)).alias(c) for c in ("TA", "POP")],
        clean_measure(F.col("IS_PRECIP")).alias("is_precip"),
    )


@query(
    "category_fill",
    f"""
WITH {EVENTS_K_SQL}
SELECT event_id, CASE WHEN k = 9 THEN '__MISSING__' ELSE ' ' || event_type END AS sky_filled,
       CASE WHEN k = 4 THEN -99.0::DOUBLE WHEN k = 5 THEN NULL ELSE value END AS TA
FROM events_k
WHERE k <> 6 AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""",
)
def category_fill(spark, sf_dir):
    last_day = table(spark, sf_dir, "events").select(F.max(F.to_date("ts"))).scalar()
    return (
        raw_events(spark, sf_dir)
        .withColumn("POP", clean_measure(F.col("POP")))
        .na.drop(subset=["POP"])
        .filter(F.col("day") == last_day)
        .select(
            "event_id",
            fill_category(F.col("SKY")).alias("sky_filled"),
            to_number(F.col("TA")).alias("TA"),
        )
    )


@query(
    "wind_precip_sky",
    f"""
WITH {EVENTS_K_SQL}
SELECT event_id,
       {r("sin(radians(CASE WHEN k < 36 THEN k END * 360.0 / 36))", "wd_sin")},
       {r("cos(radians(CASE WHEN k < 36 THEN k END * 360.0 / 36))", "wd_cos")},
       {r("sin(radians((k % 16) * 360.0 / 16))", "wd_sin_16")},
       CAST(CASE WHEN value > 100 THEN 1 WHEN k % 6 IN (1, 2, 3, 4) THEN 1
                 WHEN event_type IN ('error') THEN 1 ELSE 0 END AS INTEGER) AS is_precip,
       CASE WHEN event_type = 'view' THEN 'DB02'
            WHEN k % 12 <= 2 THEN 'DB01' WHEN k % 12 <= 5 THEN 'DB02'
            WHEN k % 12 <= 8 THEN 'DB03' WHEN k % 12 <= 10 THEN 'DB04' END AS sky
FROM events_k""",
)
def wind_precip_sky(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").try_cast("int")
    )
    k, index = F.col("k"), F.when(F.col("k") < 36, F.col("k"))
    return rounded(
        e.select(
            "event_id",
            wind_sin(index, 36).alias("wd_sin"),
            wind_cos(index, 36).alias("wd_cos"),
            wind_sin(k % 16, 16).alias("wd_sin_16"),
            precip_flag(
                F.col("value") - 100,
                k % 6,
                [(F.col("event_type"), ("error",))],
            ).alias("is_precip"),
            sky_code(F.when(F.col("event_type") == "view", F.lit("DB02")), k % 12).alias("sky"),
        )
    )


# --- daily tables -------------------------------------------------------------------

_DAILY_OUT = f"""station_id, date, {r("TA_day", "TA_day")}, {r("TA_dtr_day", "TA_dtr_day")},
  {r("POP_day", "POP_day")}, {r("WD_sin_day", "WD_sin_day")}, {r("WD_cos_day", "WD_cos_day")},
  is_precip_day, SKY_day, obs_cnt_sel, has_00_obs, has_12_obs"""


@query("daily_base", f"WITH {HOURLY_EVENTS_SQL}, {DAILY_BASE_SQL} SELECT {_DAILY_OUT} FROM daily")
def q_daily_base(spark, sf_dir):
    return rounded(daily_base(hourly_events(spark, sf_dir)))


@query(
    "daily_compact",
    f"""
WITH {HOURLY_EVENTS_SQL},
sel AS (
  SELECT * FROM hourly
  WHERE hour IN (0, 12) OR (SELECT count(*) FROM hourly WHERE hour IN (0, 12)) = 0
),
sky_mode AS (
  SELECT station_id, date, SKY FROM (
    SELECT station_id, date, SKY,
           row_number() OVER (PARTITION BY station_id, date ORDER BY count(*) DESC, SKY) AS rn
    FROM sel WHERE SKY IS NOT NULL GROUP BY station_id, date, SKY)
  WHERE rn = 1
),
agg AS (
  SELECT station_id, date, avg(TA) AS TA,
         CASE WHEN count(TA) >= 2 THEN abs(max(TA) - min(TA)) END AS TA_dtr, avg(POP) AS POP,
         CAST(coalesce(max(is_precip), 0) AS INTEGER) AS is_precip,
         avg(WD_sin) AS WD_sin, avg(WD_cos) AS WD_cos
  FROM sel GROUP BY station_id, date
)
SELECT a.station_id, a.date, {r("TA", "TA")}, {r("TA_dtr", "TA_dtr")}, {r("POP", "POP")},
       a.is_precip, {r("WD_sin", "WD_sin")}, {r("WD_cos", "WD_cos")},
       CAST(CASE m.SKY WHEN 'CLICK' THEN 4 WHEN 'ERROR' THEN 1 WHEN 'PURCHASE' THEN 3 WHEN 'SIGNUP' THEN 4 END AS INTEGER) AS SKY
FROM agg a LEFT JOIN sky_mode m USING (station_id, date)""",
)
def q_daily_compact(spark, sf_dir):
    # Event types in alphabetical order become a known code, numeric text or other text,
    # all again in that order, so ties between them fall the same way.
    codes = {"CLICK": "4", "ERROR": "DB01", "PURCHASE": "DB03", "SIGNUP": "DB04", "VIEW": "OTHER"}
    by_type = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    hourly = hourly_events(spark, sf_dir)
    return rounded(daily_compact(hourly.withColumn("SKY", F.try_element_at(by_type, F.col("SKY")))))


@query(
    "label_join",
    f"""
WITH {HOURLY_EVENTS_SQL}, {DAILY_BASE_SQL}, {EVENT_LABELS_SQL}
SELECT d.station_id, d.date, d.obs_cnt_sel, coalesce(l.fire_label, 0) AS fire_label
FROM daily d LEFT JOIN labels_d l USING (station_id, date)""",
)
def label_join(spark, sf_dir):
    daily = daily_base(hourly_events(spark, sf_dir))
    labels = fire_labels(event_labels(spark, sf_dir))
    return with_labels(daily, labels).select("station_id", "date", "obs_cnt_sel", "fire_label")


@query(
    "event_daily_join",
    f"""
WITH {HOURLY_EVENTS_SQL}, {DAILY_BASE_SQL}
SELECT e.event_id, CAST(e.user_id AS INTEGER) AS station_id, CAST(e.ts AS DATE) AS date,
       e.value AS TA_day, {r("d.TA_day", "TA_day_w")}, d.SKY_day
FROM events e LEFT JOIN daily d ON CAST(e.user_id AS INTEGER) = d.station_id AND CAST(e.ts AS DATE) = d.date
WHERE e.event_type = 'purchase'""",
)
def event_daily_join(spark, sf_dir):
    events = event_labels(spark, sf_dir).select(
        "event_id", "station_id", F.to_date("fire_date").alias("fire_date"),
        F.col("value").alias("TA_day"),
    )
    weather = daily_base(hourly_events(spark, sf_dir)).select(
        "station_id", "date", F.round("TA_day", 6).alias("TA_day"), "SKY_day"
    )
    return events_with_weather(events, weather)


@query(
    "daily_file_agg",
    f"""
SELECT CAST(l_suppkey AS INTEGER) AS station_id, CAST(l_shipdate AS DATE) AS date,
       {r("avg(l_extendedprice)", "TA", 4)}, {r("avg(l_discount)", "TMN", 4)},
       {r("avg(l_quantity)", "TMX", 4)}, {r("avg(l_tax)", "RN", 4)},
       {r("avg(l_quantity) - avg(l_discount)", "DTR", 4)}
FROM lineitem GROUP BY 1, 2""",
)
def daily_file_agg(spark, sf_dir):
    day = F.to_date("l_shipdate").cast("string")
    digits = F.regexp_replace(day, "-", "")
    # Odd line numbers write the date as eight digits, even ones in ISO form.
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("지점"),
        F.when(F.col("l_linenumber") % 2 == 1, digits).otherwise(day).alias("일시"),
        F.col("l_extendedprice").cast("string").alias("평균기온"),
        F.col("l_discount").cast("string").alias("최저기온"),
        F.col("l_quantity").cast("string").alias("최고기온"),
        F.col("l_tax").cast("string").alias("일강수량(mm)"),
    )
    return rounded(daily_file_means(daily_file_rows(raw)), 4)


# --- base table ---------------------------------------------------------------------

_BASE_OUT = f"""station_id, date, {r("stn_lat", "stn_lat")}, {r("stn_lon", "stn_lon")},
  {r("TA_day", "TA_day")}, {r("TA_dtr_day", "TA_dtr_day")}, {r("POP_day", "POP_day")},
  is_precip_day, {r("WD_sin_day", "WD_sin_day")}, {r("WD_cos_day", "WD_cos_day")}, SKY_day,
  obs_cnt_sel, has_00_obs, has_12_obs, fire_label, month, dayofyear,
  {r("doy_sin", "doy_sin")}, {r("doy_cos", "doy_cos")}"""


@query("calendar_densify", f"WITH {REGION_BASE_SQL} SELECT {_BASE_OUT} FROM base")
def calendar_densify(spark, sf_dir):
    return rounded(region_base(spark, sf_dir))


@query(
    "station_base",
    f"""WITH {HOURLY_EVENTS_SQL}, {EVENT_STATIONS_SQL}, {EVENT_LABELS_SQL}, {DAILY_BASE_SQL}, {BASE_SQL}
SELECT {_BASE_OUT} FROM base""",
)
def station_base(spark, sf_dir):
    return rounded(
        station_day_base(
            daily_base(hourly_events(spark, sf_dir)),
            event_stations(spark, sf_dir),
            fire_labels(event_labels(spark, sf_dir)),
        )
    )


@query(
    "calendar_features",
    f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(month(o_orderdate) AS INTEGER) AS month, CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear,
       {r("sin(2 * pi() * dayofyear(o_orderdate) / 365)", "doy_sin")},
       {r("cos(2 * pi() * dayofyear(o_orderdate) / 365)", "doy_cos")}
FROM orders""",
)
def calendar_features(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("date"), F.year("o_orderdate").alias("year")
    )
    return rounded(with_calendar_columns(days))


@query(
    "station_obs_join",
    f"""
WITH {HOURLY_EVENTS_SQL}, {EVENT_STATIONS_SQL}
SELECT h.station_id, {r("s.stn_lat", "stn_lat")}, {r("s.stn_lon", "stn_lon")},
       count(*) AS observations, count(h.TA) AS with_ta, max(h.obs_ts) AS last_obs
FROM hourly h JOIN stations s USING (station_id) GROUP BY 1, 2, 3""",
)
def station_obs_join(spark, sf_dir):
    joined = hourly_events(spark, sf_dir).join(event_stations(spark, sf_dir), "station_id")
    return rounded(
        joined.groupBy("station_id", "stn_lat", "stn_lon").agg(
            F.count(F.lit(1)).alias("observations"),
            F.count("TA").alias("with_ta"),
            F.max("obs_ts").alias("last_obs"),
        )
    )


# --- features -----------------------------------------------------------------------

_NUMERIC = (*CONTINUOUS, *BINARY, *QUALITY)
_DOUBLES = set(CONTINUOUS)
_W = "OVER (PARTITION BY station_id ORDER BY date)"


def _lag_sql(c: str, k: int) -> str:
    expr = f"lag({c}, {k}) {_W}"
    return r(expr, f"{c}_lag{k}") if c in _DOUBLES else f"{expr} AS {c}_lag{k}"


_LAG_SQL = ", ".join(_lag_sql(c, k) for k in LAGS for c in CURRENT_DAY)


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY station_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_ROLL_SQL = ", ".join(
    [r(f"avg({c}) {_frame(n)}", f"{c}_rollmean_{n}") for n in WINDOWS for c in (*CONTINUOUS, *QUALITY)]
    + [
        f"CAST(sum({c}) {_frame(n)} AS BIGINT) AS {c}_rollsum_{n}" for n in WINDOWS for c in BINARY
    ]
)


@query("lag_features", f"WITH {REGION_BASE_SQL} SELECT station_id, date, {_LAG_SQL} FROM base")
def lag_features(spark, sf_dir):
    columns = lag_columns(CURRENT_DAY)
    return rounded(
        region_base(spark, sf_dir).select(
            "station_id", "date", *[c.alias(n) for n, c in columns.items()]
        )
    )


@query("rolling_features", f"WITH {REGION_BASE_SQL} SELECT station_id, date, {_ROLL_SQL} FROM base")
def rolling_features(spark, sf_dir):
    columns = {**rolling_mean_columns((*CONTINUOUS, *QUALITY)), **rolling_sum_columns(BINARY)}
    return rounded(
        region_base(spark, sf_dir).select(
            "station_id", "date", *[c.alias(n) for n, c in columns.items()]
        )
    )


def _mode_sql(n: int) -> str:
    levels = ("DB01", "DB02", "DB03")
    counts = [f"count(CASE WHEN SKY_day = '{v}' THEN 1 END) {_frame(n)}" for v in levels]
    best = f"greatest({', '.join(counts)})"
    cases = " ".join(f"WHEN {c} = {best} THEN '{v}'" for c, v in zip(counts, levels))
    return f"CASE WHEN {best} = 0 THEN NULL {cases} END AS SKY_day_mode_{n}"


@query(
    "rolling_mode",
    f"WITH {REGION_BASE_SQL} SELECT station_id, date, {', '.join(_mode_sql(n) for n in WINDOWS)} FROM base",
)
def rolling_mode(spark, sf_dir):
    columns = rolling_mode_columns(["SKY_day"])
    return region_base(spark, sf_dir).select(
        "station_id", "date", *[c.alias(n) for n, c in columns.items()]
    )


_DRY_CTE = """
prev AS (
  SELECT station_id, date, lag(is_precip_day) OVER w AS p, row_number() OVER w AS rn
  FROM base WINDOW w AS (PARTITION BY station_id ORDER BY date)
),
spell AS (
  SELECT station_id, date, CASE WHEN p IS NULL THEN NULL ELSE CAST(rn -
    max(CASE WHEN p IS NULL OR p <> 0 THEN rn END)
      OVER (PARTITION BY station_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) END AS dry_spell_days
  FROM prev
)"""


@query(
    "dry_spell",
    f"WITH {REGION_BASE_SQL}, {_DRY_CTE} SELECT station_id, date, dry_spell_days FROM spell",
)
def dry_spell(spark, sf_dir):
    base = region_base(spark, sf_dir).select("station_id", "date", "is_precip_day")
    return with_dry_spell(base).select("station_id", "date", "dry_spell_days")


@query(
    "wide_features",
    f"""WITH {REGION_BASE_SQL}, {_DRY_CTE},
f AS (SELECT {_BASE_OUT}, {_LAG_SQL}, {_ROLL_SQL}, {', '.join(_mode_sql(n) for n in WINDOWS)} FROM base)
SELECT f.*, s.dry_spell_days FROM f JOIN spell s USING (station_id, date)""",
)
def q_wide_features(spark, sf_dir):
    return rounded(wide_features(region_base(spark, sf_dir)))


@query(
    "past_n_days",
    "WITH {}\nSELECT d.station_id, d.date, {} FROM daily d {}".format(
        REGION_BASE_SQL,
        ", ".join(
            f"{r(f'd{k}.TA_day', f'TA_day_minus{k}d')}, d{k}.SKY_day AS SKY_day_minus{k}d, "
            f"d{k}.obs_cnt_sel AS obs_cnt_sel_minus{k}d"
            for k in (1, 2, 3)
        ),
        " ".join(
            f"LEFT JOIN daily d{k} ON d.station_id = d{k}.station_id "
            f"AND d{k}.date = d.date - INTERVAL {k} DAY"
            for k in (1, 2, 3)
        ),
    ),
)
def q_past_n_days(spark, sf_dir):
    daily = daily_base(hourly_orders(spark, sf_dir))
    return rounded(past_n_days(daily, 3, ["TA_day", "SKY_day", "obs_cnt_sel"]))


_CHANNEL_SQL = [
    f"CASE WHEN SKY_day = '{c[4:]}' THEN 1 ELSE 0 END" if c.startswith("SKY_DB") else c
    for c in CHANNELS
]
_COMPLETE_SQL = " AND ".join(
    f"{c} IS NOT NULL" for c in (*[c for c in CHANNELS if not c.startswith("SKY_DB")], "SKY_day")
)
_SAMPLE_SQL = f"""
chan AS (
  SELECT *, CASE WHEN {_COMPLETE_SQL} THEN 1 ELSE 0 END AS complete,
         dense_rank() OVER (ORDER BY station_id) - 1 AS station_code
  FROM base
),
samples AS (
  SELECT station_id, date, fire_label, station_code, stn_lat, stn_lon,
         sum(complete) OVER h AS n_complete,
         {", ".join(f"list(CAST({e} AS FLOAT)) OVER h AS ch_{i}" for i, e in enumerate(_CHANNEL_SQL))}
  FROM chan
  WINDOW h AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)
  QUALIFY n_complete = 14
)"""


@query(
    "sequence_windows",
    f"""WITH {FLAG_BASE_SQL}, {_SAMPLE_SQL},
steps AS (
  SELECT station_id, date, fire_label, CAST(unnest(generate_series(0, 13)) AS INTEGER) AS step,
         station_code, stn_lat, stn_lon, {", ".join(f"ch_{i}" for i in range(len(CHANNELS)))}
  FROM samples
)
SELECT station_id, date, fire_label, step,
       {", ".join(r(f"ch_{i}[step + 1]", c, 4) for i, c in enumerate(CHANNELS))},
       {r("CAST(station_code AS FLOAT)", "station_id_encoded", 4)},
       {r("CAST(stn_lat AS FLOAT)", "stn_lat", 4)}, {r("CAST(stn_lon AS FLOAT)", "stn_lon", 4)}
FROM steps""",
)
def sequence_windows(spark, sf_dir):
    samples = sequence_samples(flag_base(spark, sf_dir))
    steps = samples.select(
        "station_id", "date", "fire_label", F.posexplode("x_dyn").alias("step", "v"), "x_static"
    )
    values = [F.col("v")[i].cast("double").alias(c) for i, c in enumerate(CHANNELS)]
    static = [
        F.col("x_static")[i].cast("double").alias(c)
        for i, c in enumerate(("station_id_encoded", "stn_lat", "stn_lon"))
    ]
    return rounded(steps.select("station_id", "date", "fire_label", "step", *values, *static), 4)


@query(
    "channel_stats",
    "WITH {}, {},\nsteps AS (SELECT {} FROM samples)\n{}".format(
        FLAG_BASE_SQL,
        _SAMPLE_SQL,
        ", ".join(f"unnest(ch_{i}) AS ch_{i}" for i in range(len(CHANNELS))),
        "\nUNION ALL\n".join(
            f"SELECT {i} AS channel_index, '{c}' AS channel, {r(f'avg(CAST(ch_{i} AS DOUBLE))', 'mean', 4)}, "
            f"round(CASE WHEN stddev_pop(CAST(ch_{i} AS DOUBLE)) < 1e-6 THEN 1.0::DOUBLE "
            f"ELSE stddev_pop(CAST(ch_{i} AS DOUBLE)) END, 4) AS std FROM steps"
            for i, c in enumerate(CHANNELS)
        ),
    ),
)
def q_channel_stats(spark, sf_dir):
    return rounded(channel_stats(sequence_samples(flag_base(spark, sf_dir))), 4)


def flagship(spark, sf_dir):
    """Raw text to the labelled, gap-free base table with trailing windows."""
    base = station_day_base(
        daily_base(hourly_events(spark, sf_dir)),
        event_stations(spark, sf_dir),
        fire_labels(event_labels(spark, sf_dir)),
    )
    return base.withColumns(
        {**rolling_mean_columns((*CONTINUOUS, *QUALITY)), **rolling_sum_columns(BINARY)}
    )
