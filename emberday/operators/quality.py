"""Validation rules and table profiles. Each answers with a table, never an exception,
except ``require_valid_base``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberday.functions.weather import SKY_LEVELS
from emberday.operators.prefix import exact_quantiles
from emberday.session import written

KEYS = ("station_id", "date")
_REPORTED = ("stn_lat", "stn_lon", "fire_label", "POP_day", "is_precip_day", "SKY_day")


def surplus_rows(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row, one number: rows beyond the first of their key."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    )


def stations_with_two_positions(df: DataFrame) -> DataFrame:
    """One number: stations whose rows disagree on latitude or longitude."""
    spread = df.groupBy("station_id").agg(
        *[
            F.when(
                (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))), 1
            )
            .otherwise(0)
            .alias(c)
            for c in ("stn_lat", "stn_lon")
        ]
    )
    return spread.agg(
        F.count(F.when((F.col("stn_lat") == 1) | (F.col("stn_lon") == 1), 1)).alias("violations")
    )


def quality_report(base: DataFrame, train_until: Column | None = None) -> DataFrame:
    """(rule, violations) for the base table; 0 everywhere means it keeps its contract.

    The columns asked about are written first: three passes read them, and making them may parse
    the whole raw input.
    """
    base = written(base.select(*KEYS, *_REPORTED), "report")
    checks: dict[str, Column] = {
        "label_is_binary": ~F.col("fire_label").isin(0, 1),
        "pop_is_number": F.col("POP_day").isNotNull()
        & F.col("POP_day").cast("string").try_cast("double").isNull(),
        "precip_is_binary": F.col("is_precip_day").isNotNull()
        & ~F.col("is_precip_day").isin(0, 1),
        "sky_is_known": ~F.col("SKY_day").isin(*SKY_LEVELS),
        "position_is_known": F.col("stn_lat").isNull() | F.col("stn_lon").isNull(),
        "date_is_known": F.col("date").isNull(),
    }
    if train_until is not None:
        checks["no_future_rows"] = F.col("date") > train_until
    counted = base.agg(*[F.count(F.when(bad, 1)).alias(rule) for rule, bad in checks.items()])
    rules = F.array(
        *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in checks]
    )
    return (
        counted.select(F.inline(rules))
        .unionByName(surplus_rows(base).select(F.lit("key_is_unique").alias("rule"), "violations"))
        .unionByName(
            stations_with_two_positions(base).select(
                F.lit("station_is_one_place").alias("rule"), "violations"
            )
        )
    )


def require_valid_base(base: DataFrame) -> None:
    """Raise when the key repeats, the label is not 0/1 or a station has two positions."""
    hard = {"key_is_unique", "label_is_binary", "station_is_one_place"}
    broken = [
        f"{r.rule}: {r.violations}"
        for r in quality_report(base).collect()
        if r.rule in hard and r.violations
    ]
    if broken:
        raise ValueError("; ".join(broken))


def row_count_check(left: DataFrame, joined: DataFrame) -> DataFrame:
    """One row: sizes before and after a left join and whether they agree."""
    before = left.agg(F.count(F.lit(1))).scalar()
    return joined.agg(F.count(F.lit(1)).alias("joined_rows")).select(
        before.alias("left_rows"),
        "joined_rows",
        (before == F.col("joined_rows")).cast("int").alias("preserved"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null share and percent per column from one pass over the table."""
    names = list(columns or df.columns)
    wide = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in names])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_ratio")) for c in names]
    )
    return wide.select(F.inline(rows)).withColumn(
        "null_percent", F.round(F.col("null_ratio") * 100, 2)
    )


def most_missing(df: DataFrame, top: int = 30) -> DataFrame:
    return (
        null_profile(df)
        .filter(F.col("null_ratio") > 0)
        .orderBy(F.desc("null_ratio"), "column")
        .limit(top)
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, nulls included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return (
        value_counts(df, column).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)
    )


def date_gap_counts(df: DataFrame, left: str = "date", right: str = "fire_date") -> DataFrame:
    return df.groupBy(F.datediff(left, right).alias("date_diff")).agg(
        F.count(F.lit(1)).alias("n")
    )


def number_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of one column, quartiles exact."""
    df = written(df.select(column), "summary")
    basics = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    quartiles = exact_quantiles(df, [], column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    three = quartiles.select(F.struct("p25", "p50", "p75")).scalar()
    return basics.withColumn("_q", three).select(
        "count", "mean", "std", "min", "_q.p25", "_q.p50", "_q.p75", "max",
    )


def raw_text_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: null share and number of blank cells of a raw text column."""
    text = F.col(column).cast("string")
    return df.agg(
        F.avg(text.isNull().cast("double")).alias("null_ratio"),
        F.count(F.when(F.trim(text) == "", 1)).alias("blank_rows"),
        F.count(F.lit(1)).alias("rows"),
    )


def distinct_values(df: DataFrame, column: str, k: int = 30) -> DataFrame:
    return df.select(F.col(column).alias("value")).distinct().orderBy("value").limit(k)


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"),
        F.max(x).alias("max_x"), F.max(y).alias("max_y"),
    )


def table_overview(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and the table's row count."""
    fields = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(fields), "rows")


def head_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of a table as stored, what a person looks at first; no order is implied."""
    return df.limit(n)
