"""Fixed-length daily histories as array columns, one row per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.weather import SKY_LEVELS, sky_one_hot
from emberday.operators.features import by_station
from emberday.operators.prefix import dense_index
from emberday.session import written

SEQUENCE_DAYS = 14
CHANNELS = (
    "TA_day", "TA_dtr_day", "POP_day", "is_precip_day", "WD_sin_day", "WD_cos_day",
    *(f"SKY_{level}" for level in SKY_LEVELS),
    "obs_cnt_sel", "has_00_obs", "has_12_obs",
)
STATIC_CHANNELS = ("station_id_encoded", "stn_lat", "stn_lon")
_NULLABLE = tuple(c for c in CHANNELS if not c.startswith("SKY_")) + ("SKY_day",)


def sequence_samples(
    base: DataFrame, days: int = SEQUENCE_DAYS, extra: Sequence[str] = ()
) -> DataFrame:
    """Samples (station_id, date, fire_label, x_dyn, x_static) from a dense base table.

    ``x_dyn`` holds the ``days`` previous rows, oldest first, the sample's own day left
    out. A sample needs a full history without any missing value, and a label.
    """
    base = written(base, "sequence-base")
    encoded = base.join(dense_index(base, "station_id", "station_id_encoded"), "station_id")
    encoded = encoded.select("*", *sky_one_hot(F.col("SKY_day")))

    history = by_station().rowsBetween(-days, -1)
    complete = F.lit(True)
    for c in _NULLABLE:
        complete = complete & F.col(c).isNotNull()
    step = F.array(*[F.col(c).cast("float") for c in CHANNELS])
    windowed = encoded.withColumns(
        {
            "_complete": F.sum(complete.cast("int")).over(history),
            "x_dyn": F.collect_list(step).over(history),
        }
    )
    return windowed.filter(
        (F.col("_complete") == days) & F.col("fire_label").isNotNull()
    ).select(
        "station_id",
        "date",
        F.col("fire_label").cast("int").alias("fire_label"),
        "x_dyn",
        F.array(*[F.col(c).cast("float") for c in STATIC_CHANNELS]).alias("x_static"),
        *extra,
    )


def _scale(std: Column) -> Column:
    return F.when(std < 1e-6, F.lit(1.0)).otherwise(std)


def channel_stats(samples: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Mean and population deviation per dynamic channel over samples and steps.

    Steps are unrolled into rows inside the map stage and aggregated there at once; a
    deviation below 1e-6 becomes 1.
    """
    steps = samples.select(F.explode("x_dyn").alias("step"))
    wide = steps.agg(
        *[
            f(F.col("step")[i].cast("double")).alias(f"{name}_{i}")
            for i in range(len(channels))
            for name, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
    return _long_stats(wide, channels)


def static_stats(samples: DataFrame, channels: Sequence[str] = STATIC_CHANNELS) -> DataFrame:
    wide = samples.agg(
        *[
            f(F.col("x_static")[i].cast("double")).alias(f"{name}_{i}")
            for i in range(len(channels))
            for name, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
    return _long_stats(wide, channels)


def _long_stats(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("channel_index"),
                F.lit(c).alias("channel"),
                F.col(f"mean_{i}").alias("mean"),
                _scale(F.col(f"std_{i}")).alias("std"),
            )
            for i, c in enumerate(channels)
        ]
    )
    return wide.select(F.inline(rows))


SCALE_FIELDS = ("dyn_mean", "dyn_std", "static_mean", "static_std")


def fit_scale(train: DataFrame) -> DataFrame:
    """One row of four short arrays: mean and deviation per dynamic and static channel."""

    def listed(stats: DataFrame, mean: str, std: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("channel_index", "mean", "std")))
        return stats.agg(ordered.alias("s")).select(
            F.col("s.mean").alias(mean), F.col("s.std").alias(std)
        )

    dynamic = listed(channel_stats(train), *SCALE_FIELDS[:2])
    static = listed(static_stats(train), *SCALE_FIELDS[2:])
    return dynamic.select("*", *[static.select(f).scalar().alias(f) for f in SCALE_FIELDS[2:]])


def standardised(samples: DataFrame, scale: dict[str, Sequence[float]]) -> DataFrame:
    """Scale both arrays with the values of ``fit_scale``."""

    def constant(field: str) -> Column:
        return F.array(*[F.lit(float(v)) for v in scale[field]])

    def scaled(values: Column, part: str) -> Column:
        centred = F.zip_with(values, constant(f"{part}_mean"), lambda v, m: v - m)
        return F.zip_with(centred, constant(f"{part}_std"), lambda v, s: (v / s).cast("float"))

    return samples.withColumns(
        {
            "x_dyn": F.transform("x_dyn", lambda step: scaled(step, "dyn")),
            "x_static": scaled(F.col("x_static"), "static"),
        }
    )


def flattened(samples: DataFrame, output: str = "x_flat") -> DataFrame:
    """One flat array per sample: all steps in order, then the static values."""
    return samples.withColumn(output, F.concat(F.flatten("x_dyn"), F.col("x_static")))
