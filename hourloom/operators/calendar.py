"""Calendars: US federal holidays and dense months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions.dates import month_days, nth_weekday

#: Holidays on a date (name, month, day), and on the n-th weekday of a month (name, month, weekday, n).
FIXED_HOLIDAYS = (("New Year's Day", 1, 1), ("Juneteenth", 6, 19), ("Independence Day", 7, 4), ("Veterans Day", 11, 11), ("Christmas Day", 12, 25))
MOVING_HOLIDAYS = (
    ("Martin Luther King Jr. Day", 1, "MON", 3), ("Presidents' Day", 2, "MON", 3), ("Memorial Day", 5, "MON", -1),
    ("Labor Day", 9, "MON", 1), ("Columbus Day", 10, "MON", 2), ("Thanksgiving Day", 11, "THU", 4),
)


def us_holidays(years: DataFrame) -> DataFrame:
    """year, date, name for each distinct year of years(year): eleven rows a year, on the actual dates."""
    first = lambda month: F.make_date(F.col("year"), F.lit(month), F.lit(1))
    rows: list[Column] = [F.struct(F.make_date(F.col("year"), F.lit(m), F.lit(d)).alias("date"), F.lit(n).alias("name")) for n, m, d in FIXED_HOLIDAYS]
    rows += [F.struct(nth_weekday(first(m), w, k).alias("date"), F.lit(n).alias("name")) for n, m, w, k in MOVING_HOLIDAYS]
    return years.select(F.col("year").cast("int").alias("year")).distinct().select("year", F.inline(F.array(*rows)))


def calendar_days(periods: DataFrame, holidays: DataFrame, weekend: Sequence[int] = (5, 6)) -> DataFrame:
    """period, date, weekday, is_weekend, is_holiday, holiday_name: all days of the distinct months of periods(period).

    weekend: days of the week, Monday 0. holidays(date, name) has a row a holiday and year, so it is small.
    """
    days = periods.select("period").distinct().select("period", F.explode(month_days(F.col("period"))).alias("date"))
    named = holidays.groupBy("date").agg(F.min("name").alias("holiday_name"))
    return days.join(named, "date", "left").select(
        "period", "date", F.date_format("date", "EEEE").alias("weekday"), F.weekday("date").isin(*weekend).alias("is_weekend"),
        F.col("holiday_name").isNotNull().alias("is_holiday"), "holiday_name",
    )


def month_grid(periods: DataFrame) -> DataFrame:
    """period, days, first_weekday (Sunday 0)."""
    return periods.select("period", F.day(F.last_day("period")).alias("days"), (F.dayofweek("period") - 1).alias("first_weekday"))
