"""Cleaning of raw text columns: aliases, numbers, sentinels, codes, dates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers that stand for "no measurement" in the raw files.
MISSING_SENTINELS = (-99, -999, -9999)

def pick_column(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """First candidate present in ``columns``, ignoring case and outer blanks.

    When two columns share a normalised name the later one is returned.
    """
    by_name = {str(name).strip().lower(): name for name in columns}
    hits = (by_name.get(str(c).strip().lower()) for c in candidates)
    return next((hit for hit in hits if hit is not None), None)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain decimal number becomes null.

    The cast alone would also take "5d", "NaN", "Infinity" or "0x1p3"; a decimal number
    ends with a digit or a point and has no x, which costs less to test than a pattern.
    """
    trimmed = F.trim(text.cast("string"))
    plain = F.substring(trimmed, -1, 1).between(".", "9") & ~F.lower(trimmed).contains("x")
    return F.when(plain, trimmed.try_cast("double"))


def to_code(text: Column) -> Column:
    """Whole number of an id or code column; fractions and numbers beyond 32 bits become null."""
    number = to_number(text)
    return F.when(number % 1 == 0, number.try_cast("int"))


def drop_sentinels(number: Column) -> Column:
    return F.when(~number.isin(*MISSING_SENTINELS), number)


def clean_measure(text: Column) -> Column:
    return drop_sentinels(to_number(text))


def clean_code(text: Column) -> Column:
    return F.upper(F.trim(text.cast("string")))


def _slices_as_iso(text: Column, *lengths: int) -> Column:
    """Text of one of the listed lengths cut up as if it were digits, with ISO separators.

    Anything but a real digit string fails the cast that follows. The ISO text is cast to
    TIMESTAMP_NTZ directly, so the result never passes through a zoned type, whatever the
    session's time zone or default timestamp type is.
    """

    def part(start: int, size: int) -> Column:
        return F.substring(text, start, size)

    day = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    minute = F.concat(day, F.lit("T"), part(9, 2), F.lit(":"), part(11, 2))
    shapes = {8: day, 12: minute, 14: F.concat(minute, F.lit(":"), part(13, 2))}
    size, (first, *others) = F.length(text), lengths
    iso = F.when(size == first, shapes[first])
    for length in others:
        iso = iso.when(size == length, shapes[length])
    return iso


def parse_obs_timestamp(text: Column) -> Column:
    """Minute digits, second digits, day digits, or ISO-like text; else null.

    ISO-like text has a dash and digit strings have none, so one cast serves both.
    """
    trimmed = F.trim(text.cast("string"))
    iso = F.when(F.instr(trimmed, "-") > 0, trimmed).otherwise(
        F.coalesce(_slices_as_iso(trimmed, 12, 14, 8), trimmed)
    )
    return iso.try_cast("timestamp_ntz")


def parse_event_timestamp(text: Column) -> Column:
    """Event time from the first twelve characters of a digit string."""
    return _slices_as_iso(F.substring(text.cast("string"), 1, 12), 12).try_cast("timestamp_ntz")


def parse_day_digits(text: Column) -> Column:
    """Date from eight leading digits, null when they are not a calendar day."""
    day = F.concat_ws(
        "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
    )
    return F.when(text.rlike(r"^\d{8}"), day.try_cast("date"))


def parse_daily_date(text: Column) -> Column:
    """Date of a daily file: eight leading digits, else any ISO-like date."""
    whole = text.cast("string")
    return F.when(whole.rlike(r"^\d{8}"), parse_day_digits(whole)).otherwise(
        F.trim(whole).try_cast("timestamp_ntz").cast("date")
    )
