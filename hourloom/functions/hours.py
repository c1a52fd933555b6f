"""Quantities of hours and clock times from dirty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourloom.functions.dates import bound

#: Cells that mean "no value", and unit words in the order in which they go.
BLANKS = ("", "-", "--", "n/a", "na", "off", "none")
UNITS = ("hrs", "hours", "hour", "h")

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CLOCK = r"(?i)^\s*([0-9]{1,2})[:.\s]([0-9]{2})(?:[:.\s]([0-9]{2}))?\s*(am|pm|a\.m\.|p\.m\.)?\s*$"
#: The digits of a clock time.
CLOCK_DIGITS = r"[0-9][0-9:.\s]*[0-9]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def plain_number(c: Column) -> Column:
    """The number that a text is, as a whole; null for anything else (inf, nan, suffixes)."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_hours(c: Column) -> Column:
    """8, '8:30', '8 00', '7,5', '$8', '8 hrs' as hours; null when there is no non-negative quantity."""

    def without_units(s: Column) -> Column:
        for unit in UNITS:
            s = F.replace(s, F.lit(unit), F.lit(""))
        return strip(F.replace(strip(s), F.lit("$"), F.lit("")))

    def value(t: Column) -> Column:
        parts = F.split(t, r"[:\s]")
        whole, minutes = (F.get(parts, F.lit(k)).try_cast("int") for k in (0, 1))
        timed = t.rlike(r"^[0-9]{1,3}[:\s][0-9]{2}$") & (minutes < 60)
        return F.when(timed, whole + minutes / 60).otherwise(plain_number(F.replace(t, F.lit(","), F.lit("."))))

    def read(s: Column) -> Column:
        return F.when(~s.isin(*BLANKS), bound(bound(without_units(s), value), lambda got: F.when(got >= 0, got)))

    # Most cells are plain numbers or missing, and these need no further look.
    text = c.cast("string")
    return F.when(text.rlike(r"^[0-9]+(?:\.[0-9]+)?\z"), text.cast("double")).when(text.isNotNull(), bound(strip(F.lower(text)), read))


def parse_clock(c: Column) -> Column:
    """Seconds of the day of a clock time, with or without am and pm."""

    # Of a clock time the digits and what parts them say all; no cast fails, as failing ones are slow.
    def read(parts: Column) -> Column:
        hour, minute = (F.get(parts, F.lit(k)).cast("int") for k in (0, 1))
        second = F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0))
        hour = F.when(c.rlike("[pP]") & (hour < 12), hour + 12).when(c.rlike("[aA]") & (hour == 12), F.lit(0)).otherwise(hour)
        return F.when((hour <= 23) & (minute <= 59) & (second <= 59), hour * 3600 + minute * 60 + second)

    return F.when(c.rlike(CLOCK), bound(F.split(F.regexp_extract(c, CLOCK_DIGITS, 0), r"[:.\s]"), read))


def lunch_minutes(out_s: Column, in_s: Column) -> Column:
    """Whole minutes between two clock times in seconds of the day; 0 where one is missing or they are reversed."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.floor(in_s / 60) - F.floor(out_s / 60)).cast("double")), F.lit(0.0))


def hours_between(in_s: Column, out_s: Column, lunch: Column) -> Column:
    """Hours between two clock times in seconds less lunch minutes; an end that isn't later moves on by 12 hours, once or twice."""
    a, b = in_s / 3600, out_s / 3600
    end = F.when(b > a, b).when(b + 12 > a, b + 12).otherwise(b + 24)
    worked = end - a - F.greatest(F.coalesce(lunch, F.lit(0.0)), F.lit(0.0)) / 60
    return F.when((a == 0) & (b == 0), F.lit(0.0)).when((worked >= 0) & (worked <= 24), F.round(worked, 2))


def split_hours(total: Column, regular: Column, overtime: Column) -> tuple[Column, Column, Column]:
    """(regular, overtime, total) with what follows from the others filled in; nulls don't become zeros."""
    t = F.coalesce(total, regular + F.coalesce(overtime, F.lit(0.0)))
    r = F.coalesce(regular, t - F.coalesce(overtime, F.lit(0.0)))
    rest = F.round(t - r, 2)
    return r, F.coalesce(overtime, F.when(F.abs(rest) < 1e-6, F.lit(0.0)).otherwise(rest)), t


def number_or_hours(c: Column) -> Column:
    return F.coalesce(plain_number(strip(c)), parse_hours(c))
