"""Raw observation rows to typed hourly rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberday.functions.parsing import (
    clean_code,
    drop_sentinels,
    parse_daily_date,
    parse_obs_timestamp,
    pick_column,
    to_code,
    to_number,
)

# Accepted names of each logical column, first match wins.
OBS_ALIASES: dict[str, tuple[str, ...]] = {
    "station_id": ("STN", "stn", "지점", "지점번호"),
    "obs_ts": ("TM", "일시", "datetime", "date"),
    "TA": ("TA", "평균기온", "평균기온(°C)"),
    "POP": ("POP", "강수확률"),
    "is_precip": ("is_precip", "IS_PRECIP"),
    "WD_sin": ("WD_sin", "wd_sin"),
    "WD_cos": ("WD_cos", "wd_cos"),
    "SKY": ("SKY", "sky"),
}
# Accepted names in the older one-row-per-day files.
DAILY_FILE_ALIASES: dict[str, tuple[str, ...]] = {
    "station_id": ("STN", "stn", "stnid", "지점", "지점번호"),
    "date": ("TM", "날짜", "date", "YYYYMMDD", "일시"),
    "TA": ("TA", "TAVG", "평균기온", "avgTa", "평균기온(°C)"),
    "TMN": ("TMN", "최저기온", "최저기온(°C)"),
    "TMX": ("TMX", "최고기온", "최고기온(°C)"),
    "RN": ("RN", "PRCP", "강수량", "일강수량(mm)"),
}

MEASURES = ("TA", "POP", "is_precip", "WD_sin", "WD_cos")
HOURLY_COLUMNS = ("station_id", "obs_ts", "date", "hour", *MEASURES, "SKY")


def resolve_aliases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str]
) -> dict[str, str]:
    """Logical name to actual column name; absent optional columns are left out."""
    found = {name: pick_column(df.columns, names) for name, names in aliases.items()}
    missing = [name for name in required if found[name] is None]
    if missing:
        raise ValueError(f"required columns not found: {missing}")
    return {name: actual for name, actual in found.items() if actual is not None}


def select_aliased(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str]
) -> DataFrame:
    """Keep the resolved columns under their logical names."""
    found = resolve_aliases(df, aliases, required)
    return df.select(*[df[f"`{actual}`"].alias(name) for name, actual in found.items()])


def with_absent_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add all-null columns for the ones ``df`` lacks."""
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    )


def computed_once(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` as rows unrolled from one struct, so that what reads its columns does not repeat their making.

    Spark merges projections and moves filters below them, copying an expression to every place
    that names it; parsing names each text several times. It does neither across an unrolled struct.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]))))


def hourly_observations(
    raw: DataFrame,
    aliases: Mapping[str, Sequence[str]] = OBS_ALIASES,
    stations: Sequence[int] | None = None,
) -> DataFrame:
    """Typed hourly rows with ``date`` and ``hour``; rows without station or time go.

    ``stations`` keeps only the listed ids; None keeps all.
    """
    named = select_aliased(raw, aliases, required=("station_id", "obs_ts"))
    named = with_absent_columns(computed_once(named), {**{m: "double" for m in MEASURES}, "SKY": "string"})
    typed = named.select(
        to_code(F.col("station_id")).alias("station_id"),
        parse_obs_timestamp(F.col("obs_ts")).alias("obs_ts"),
        *[to_number(F.col(m)).alias(m) for m in MEASURES],
        clean_code(F.col("SKY")).alias("SKY"),
    )
    typed = computed_once(typed).filter(F.col("station_id").isNotNull() & F.col("obs_ts").isNotNull())
    if stations is not None:
        typed = typed.filter(F.col("station_id").isin(*stations))
    return typed.withColumns(
        {
            **{m: drop_sentinels(F.col(m)) for m in MEASURES},
            "date": F.to_date("obs_ts"),
            "hour": F.hour("obs_ts"),
        }
    ).select(*HOURLY_COLUMNS)


def daily_file_rows(
    raw: DataFrame,
    aliases: Mapping[str, Sequence[str]] = DAILY_FILE_ALIASES,
    stations: Sequence[int] | None = None,
) -> DataFrame:
    """Rows of the older daily files: station, date and the measures that exist."""
    named = select_aliased(raw, aliases, required=("station_id", "date"))
    measures = [c for c in ("TA", "TMN", "TMX", "RN") if c in named.columns]
    typed = named.select(
        to_code(F.col("station_id")).alias("station_id"),
        parse_daily_date(F.col("date")).alias("date"),
        *[to_number(F.col(m)).alias(m) for m in measures],
    ).filter(F.col("station_id").isNotNull() & F.col("date").isNotNull())
    return typed if stations is None else typed.filter(F.col("station_id").isin(*stations))
