"""String, number and date helpers (F19 to F23) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"!-/:-@\[-`{-~"


def trim_whitespace(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def trim_punctuation(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def remove_all_but(s: Column, kept: str) -> Column:
    """kept: characters as in a regular expression's brackets."""
    return F.regexp_replace(s, f"[^{kept}]", "")


def remove_all_of(s: Column, dropped: str) -> Column:
    return F.regexp_replace(s, f"[{dropped}]", "")


def item(s: Column, number: int, delimiter: str = ";") -> Column:
    """The item with a 0-based number; null beyond the last."""
    return F.try_element_at(F.split(s, f"[{delimiter}]"), F.lit(number + 1))


def item_count(s: Column, delimiter: str = ";") -> Column:
    return F.size(F.split(s, f"[{delimiter}]"))


def occurrences(s: Column, character: str) -> Column:
    return F.length(s) - F.length(F.translate(s, character, ""))


def pad(s: Column, character: str, length: int, at_end: bool = False) -> Column:
    padded = (F.rpad if at_end else F.lpad)(s, length, character)
    return F.when(F.length(s) >= length, s).otherwise(padded)


def to_integer(s: Column) -> Column:
    """0 where the text is no whole number."""
    return F.coalesce(s.try_cast("bigint"), F.lit(0).cast("long"))


def to_double(s: Column) -> Column:
    """an error where the text is no number."""
    return s.cast("double")


def seconds_of_day(time: Column) -> Column:
    """from `hh mm ss`, with any single separator."""
    part = F.split(time, "[^0-9.]")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def day_of_week(date: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(date) - 1


def seconds_of_week(date: Column, time: Column) -> Column:
    return day_of_week(date) * 86400 + seconds_of_day(time)


def nmea_degrees(field: Column, hemisphere: Column) -> Column:
    """degrees from (d)ddmm.mm; south and west are negative."""
    value = field.cast("double")
    degrees = F.floor(value / 100)
    signed = degrees + (value - degrees * 100) / 60
    return F.when(hemisphere.isin("S", "W"), -signed).otherwise(signed)
