"""Dates from dirty text, and calendar arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names by their first letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: The forms of dates that are read. Digits are ASCII ones, so that all engines agree.
NUMERIC = r"\b([0-9]{1,4})[/\-.]([0-9]{1,2})[/\-.]([0-9]{1,4})\b"
ISO = r"^([0-9]{4})[/\-.]([0-9]{1,2})[/\-.]([0-9]{1,2})"
#: Whole texts that are a date for certain; the last days of February are left to the rules below.
FULL_ISO = (
    r"^(?!0000)[0-9]{4}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)\z"
)
#: Whole texts of two numbers that are days of every month and a plain year: a date if one of them is a month.
FULL_NUMERIC = r"^(?:0?[1-9]|1[0-9]|2[0-8])[/\-.](?:0?[1-9]|1[0-9]|2[0-8])[/\-.][1-9][0-9]{3}\z"
DAY_FIRST = r"([0-9]{1,2})[ \-/]([A-Za-z]{3,9})[ \-/,]+([0-9]{2,4})"
MONTH_FIRST = r"([A-Za-z]{3,9})[ \-/.]+([0-9]{1,2})[ ,]+([0-9]{2,4})"


def month_of_name(c: Column) -> Column:
    """1 to 12 for a full month name or its first three letters."""
    low, named = F.lower(c), F.when(F.lit(False), F.lit(0))
    for k, (short, full) in enumerate(zip(MONTHS, FULL_MONTHS, strict=True), 1):
        named = named.when(low.isin(short, full), F.lit(k))
    return named


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none; checked by arithmetic, as failing casts are slow."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), F.lit(30)).when(month != 2, F.lit(31)).when(leap, F.lit(29)).otherwise(F.lit(28))
    return F.when(year.between(1, 9999) & month.between(1, 12) & day.between(1, last), F.make_date(year, month, day))


def full_year(year: Column, base: Column) -> Column:
    """A year of three or more digits as it is; else the one nearest to base of 1900, 2000 and 2100 plus it, the earlier on ties."""
    near = F.when(base > 2050 + year, 2100 + year).when(base > 1950 + year, 2000 + year).otherwise(1900 + year)
    return F.when(year >= 100, year).otherwise(near)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it: keeps nested rules from growing exponentially."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with more columns, each computed once a row: filters on them stay above instead of computing them again below."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _parts(text: Column, pattern: str, between: str) -> Column:
    """What a pattern matches, cut at its separators; out of range where it doesn't match."""
    return F.split(F.regexp_extract(text, pattern, 0), between)


def parse_date(c: Column, order: Column, base_year: Column) -> Column:
    """ISO, textual and numeric dates; order is DMY or MDY; null when nothing fits.

    Forms are tried in order, each only where those before it give no date; the first that is a date counts.
    """
    # What is cast are digits, or empty where the pattern doesn't match: no cast fails, as failing ones are slow.
    num = lambda p, k: F.nullif(F.get(p, F.lit(k)), F.lit("")).cast("int")
    of = lambda y, m, d: bound(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: date_of(x["y"], x["m"], x["d"]))
    near = lambda p, k: bound(num(p, k), lambda year: full_year(year, base_year))

    def numeric(p: Column) -> Column:
        def either(x: Column) -> Column:
            day_first, month_first = date_of(x["y"], x["b"], x["a"]), date_of(x["y"], x["a"], x["b"])
            return F.coalesce(F.when(order == "DMY", day_first), month_first, day_first)

        parts = F.struct(near(p, 2).alias("y"), num(p, 0).alias("a"), num(p, 1).alias("b"))
        return F.when(num(p, 0) > 31, of(num(p, 0), num(p, 1), num(p, 2))).otherwise(bound(parts, either))

    def read(text: Column) -> Column:
        by_day = bound(_parts(text, DAY_FIRST, r"[ \-/,]+"), lambda p: of(near(p, 2), month_of_name(F.get(p, F.lit(1))), num(p, 0)))
        by_month = bound(_parts(text, MONTH_FIRST, r"[ \-/.,]+"), lambda p: of(near(p, 2), month_of_name(F.get(p, F.lit(0))), num(p, 1)))
        iso = bound(_parts(text, ISO, r"[/\-.]"), lambda p: of(num(p, 0), num(p, 1), num(p, 2)))
        named = F.when(text.rlike("[A-Za-z]{3}"), F.coalesce(by_day, by_month))
        return F.when(text.rlike(ISO), iso).otherwise(F.coalesce(named, bound(_parts(text, NUMERIC, r"[/\-.]"), numeric)))

    def short(p: Column) -> Column:
        a, b, year = (F.get(p, F.lit(k)).cast("int") for k in range(3))
        day_first = F.when(b <= 12, F.make_date(year, b, a))
        return F.coalesce(F.when(order == "DMY", day_first), F.when(a <= 12, F.make_date(year, a, b)), day_first)

    # Most dates are full ISO ones or short numeric ones, and these need no further look.
    plain = F.when(c.isNotNull(), bound(F.regexp_replace(c, r"^\s+|\s+$", ""), read))
    return F.when(c.rlike(FULL_ISO), c.cast("date")).when(c.rlike(FULL_NUMERIC), bound(F.split(c, r"[/\-.]"), short)).otherwise(plain)


def rescue_epoch(d: Column, period: Column) -> Column:
    """A date before 1990 is a spreadsheet's empty epoch: its day of the month in the period, if there is one."""
    return F.when((F.year(d) < 1990) & (F.day(d) <= F.day(F.last_day(period))), F.date_add(period, F.day(d) - 1))


def week_overlap(start: Column, end: Column, period: Column) -> Column:
    """Share of an inclusive interval that lies in the period's month; bounds may come in either order."""
    a, b = F.least(start, end), F.greatest(start, end)
    inside = F.datediff(F.least(b, F.last_day(period)), F.greatest(a, period)) + 1
    return F.greatest(inside, F.lit(0)) / (F.datediff(b, a) + 1)


def month_days(period: Column) -> Column:
    return F.sequence(period, F.last_day(period))


def nth_weekday(first: Column, weekday: str, n: int) -> Column:
    """The n-th weekday (MON, ...) of the month that starts at first; the last one for n = -1."""
    if n < 0:
        return F.date_sub(F.next_day(F.last_day(first), weekday), 7)
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def date_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0))


def default_period(d: Column) -> Column:
    """Up to the 10th the month before, then the month itself."""
    return F.trunc(F.add_months(d, F.when(F.day(d) <= 10, F.lit(-1)).otherwise(F.lit(0))), "MM").cast("date")


def period_label(period: Column) -> Column:
    return F.date_format(period, "MMMM yyyy")
