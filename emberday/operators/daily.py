"""Hourly rows to one row per (station, day).

Both builders aggregate twice: first per (station, day, sky code), which the map side
already shrinks to a handful of rows however many observations a station-day has, then
per (station, day). The first step keeps only numeric buffers, so it stays in the hash
aggregate; the mode of the sky code falls out of its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.weather import sky_ordinal
from emberday.operators.hourly import MEASURES
from emberday.session import written

PREFERRED_HOURS = (0, 12)
KEYS = ("station_id", "date")
_MEANS = tuple(m for m in MEASURES if m != "is_precip")


def most_frequent(value: Column, count: Column) -> Column:
    """Aggregate: the value with the highest count, ties to the smallest value."""
    ranked = F.when(value.isNotNull() & (count > 0), F.struct(-count, value.alias("v")))
    return F.min(ranked).getField("v")


def _mean(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)


def daily_base(hourly: DataFrame) -> DataFrame:
    """Daily rows; hours 00 and 12 are used per station-day when either exists.

    A day without both falls back to all of its rows. The temperature range is the
    distance between the mean at 12 and the mean at 00, null unless both are known.
    """
    hour = F.col("hour")
    by_sky = hourly.groupBy(
        *KEYS, "SKY", hour.isin(*PREFERRED_HOURS).alias("preferred")
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("is_precip").alias("precip"),
        *[F.sum(m).alias(f"{m}_sum") for m in _MEANS],
        *[F.count(m).alias(f"{m}_n") for m in _MEANS],
        *[F.count(F.when(hour == h, 1)).alias(f"h{h}_rows") for h in PREFERRED_HOURS],
        *[F.sum(F.when(hour == h, F.col("TA"))).alias(f"h{h}_sum") for h in PREFERRED_HOURS],
        *[F.count(F.when(hour == h, F.col("TA"))).alias(f"h{h}_n") for h in PREFERRED_HOURS],
    )

    # The fallback is only taken when a day has no preferred row, so the two scopes are
    # the preferred rows and the others.
    scopes = {"pref": F.col("preferred"), "rest": ~F.col("preferred")}
    counters = ["rows", *[f"{m}_{part}" for m in _MEANS for part in ("sum", "n")]]
    by_day = by_sky.groupBy(*KEYS).agg(
        *[
            F.sum(F.when(rows, F.col(c))).alias(f"{scope}_{c}")
            for scope, rows in scopes.items()
            for c in counters
        ],
        *[F.max(F.when(rows, F.col("precip"))).alias(f"{s}_precip") for s, rows in scopes.items()],
        *[
            most_frequent(F.col("SKY"), F.when(rows, F.col("rows"))).alias(f"{scope}_SKY")
            for scope, rows in scopes.items()
        ],
        *[
            F.sum(f"h{h}_{part}").alias(f"h{h}_{part}")
            for h in PREFERRED_HOURS
            for part in ("rows", "sum", "n")
        ],
    )

    def chosen(name: str) -> Column:
        return F.when(F.col("pref_rows") > 0, F.col(f"pref_{name}")).otherwise(
            F.col(f"rest_{name}")
        )

    mean_at = {h: _mean(F.col(f"h{h}_sum"), F.col(f"h{h}_n")) for h in PREFERRED_HOURS}
    return by_day.select(
        *KEYS,
        *[_mean(chosen(f"{m}_sum"), chosen(f"{m}_n")).alias(f"{m}_day") for m in _MEANS],
        F.abs(mean_at[12] - mean_at[0]).alias("TA_dtr_day"),
        F.coalesce(chosen("precip"), F.lit(0)).cast("int").alias("is_precip_day"),
        chosen("SKY").alias("SKY_day"),
        chosen("rows").cast("int").alias("obs_cnt_sel"),
        *[
            (F.col(f"h{h}_rows") > 0).cast("int").alias(f"has_{h:02d}_obs")
            for h in PREFERRED_HOURS
        ],
    )


def daily_compact(hourly: DataFrame) -> DataFrame:
    """The older daily table: sky as ordinal, range as max minus min.

    Hours 00 and 12 are used for the whole input; only when the input has no such row
    anywhere are all hours used. The groups are written, as both questions are put to them;
    the raw input is parsed once.
    """
    preferred = F.coalesce(F.col("hour").isin(*PREFERRED_HOURS), F.lit(False))
    grouped = hourly.groupBy(*KEYS, "SKY", preferred.alias("preferred")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(m).alias(f"{m}_sum") for m in _MEANS],
        *[F.count(m).alias(f"{m}_n") for m in _MEANS],
        F.min("TA").alias("TA_min"),
        F.max("TA").alias("TA_max"),
        F.max("is_precip").alias("precip"),
    )
    grouped = written(grouped, "compact")
    any_preferred = grouped.select(F.coalesce(F.max(F.col("preferred").cast("int")), F.lit(0))).scalar()
    by_sky = grouped.filter(F.col("preferred") | (any_preferred == 0))
    by_day = by_sky.groupBy(*KEYS).agg(
        *[F.sum(f"{m}_{p}").alias(f"{m}_{p}") for m in _MEANS for p in ("sum", "n")],
        F.min("TA_min").alias("TA_min"),
        F.max("TA_max").alias("TA_max"),
        F.max("precip").alias("precip"),
        most_frequent(F.col("SKY"), F.col("rows")).alias("sky"),
    )
    return by_day.select(
        *KEYS,
        *[_mean(F.col(f"{m}_sum"), F.col(f"{m}_n")).alias(m) for m in _MEANS],
        F.when(F.col("TA_n") >= 2, F.abs(F.col("TA_max") - F.col("TA_min"))).alias("TA_dtr"),
        F.coalesce(F.col("precip"), F.lit(0)).cast("int").alias("is_precip"),
        sky_ordinal(F.col("sky")).alias("SKY"),
    )


def daily_file_means(rows: DataFrame) -> DataFrame:
    """Mean of each measure of the daily files per (station, date), plus the range."""
    measures = [c for c in ("TA", "TMN", "TMX", "RN") if c in rows.columns]
    means = rows.groupBy(*KEYS).agg(*[F.avg(m).alias(m) for m in measures])
    if {"TMN", "TMX"} <= set(measures):
        means = means.withColumn("DTR", F.col("TMX") - F.col("TMN"))
    return means
