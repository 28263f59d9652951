"""Text to typed values. Empty text is null; text that doesn't parse is null as well, and counted by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDINATE = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*°\s*([NSEWO])\s*$"


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def number(c: Column, dtype: str) -> Column:
    """1,234.5 -> 1234.5"""
    return F.regexp_replace(filled(c), ",", "").try_cast(dtype)


def coordinate(c: Column) -> Column:
    """99.2° W -> -99.2; S, W and O (oeste) are negative."""
    size = F.regexp_extract(c, COORDINATE, 1).try_cast("double")
    return F.when(F.regexp_extract(c, COORDINATE, 2).isin("S", "W", "O"), -size).otherwise(size)


def date(c: Column) -> Column:
    """January 5, 2024"""
    return F.to_date(F.try_to_timestamp(filled(c), F.lit("MMMM d, yyyy")))


def parsed(c: Column, fmt: str, dtype: str) -> Column:
    if fmt == "number":
        return number(c, dtype)
    return coordinate(c) if fmt == "coordinate" else date(c) if fmt == "date" else filled(c)


def decimals(c: Column) -> Column:
    """Digits behind the point of a number's text, without trailing zeros."""
    return F.length(F.regexp_replace(F.regexp_extract(c, r"\.([0-9]+)", 1), "0+$", ""))
