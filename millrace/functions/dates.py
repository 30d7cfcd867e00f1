"""Calendar parts of a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name endings of generated date parts, in output order.
PART_SUFFIXES = ["_year", "_month", "_day", "_dayofweek", "_quarter", "_is_weekend", "_hour"]


def date_parts(c: Column) -> dict[str, Column]:
    """Suffix -> expression; Monday is 0, a missing date is never a weekend."""
    weekday = F.weekday(c)
    return {
        "_year": F.year(c),
        "_month": F.month(c),
        "_day": F.day(c),
        "_dayofweek": weekday,
        "_quarter": F.quarter(c),
        "_is_weekend": F.coalesce(weekday.isin(5, 6), F.lit(False)).cast("int"),
    }


def is_date_part(name: str) -> bool:
    return name.endswith(tuple(PART_SUFFIXES))


def micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp, free of any time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def from_micros(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", c.cast("bigint"), F.lit("1970-01-01").cast("timestamp_ntz"))
