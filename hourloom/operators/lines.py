"""Rules over the text lines of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.functions import dates, hours

#: A date in a line (ISO, numeric, or with a month's name), labelled hours, a decimal, a number with a pay code. Digits
#: are ASCII ones, so that all engines agree.
DATE = (
    r"\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b|\b[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}\b"
    r"|\b[0-9]{1,2}[ \-/][A-Za-z]{3,9}[ \-/,]+[0-9]{2,4}\b|\b[A-Za-z]{3,9}[ \-/.]+[0-9]{1,2},?\s+[0-9]{2,4}\b"
)
#: What texts that can vote on the order have: numeric dates that don't begin with a year.
VOTE = r"\b0*[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]"
LABEL = r"(?i)([0-9]{1,2}(?:\.[0-9]{1,2})?)\s*(?:hours|hrs|hour)\b"
VALUE = r"(?<![:0-9.])([0-9]{1,2}\.[0-9]{1,2})(?![:0-9])"
PAY_CODE = r"(?i)(?<![:0-9.])([0-9]{1,2})\s+(?:regular|over\s*time|overtime|o\.?t\.?|holiday|vacation|sick|worked|billable|straight)\b"


def date_orders(lines: DataFrame, period: Column) -> DataFrame:
    """file, date_order of lines(file, text), period being a month or a column of months: by parts above 12, else by which order puts more dates into the period's month of any
    year; ties MDY."""
    tokens = lines.where(F.col("text").rlike(VOTE)).select("file", F.month(period).alias("own"), F.explode(dates.date_tokens(F.col("text"))).alias("t"))
    a, b = (F.regexp_extract("t", dates.NUMERIC, k).cast("int") for k in (1, 2))
    parts = tokens.select("file", "own", a.alias("a"), b.alias("b")).where("a <= 31")
    of_month = lambda part: F.count_if(F.col(part) == F.col("own"))
    votes = parts.groupBy("file").agg(
        F.count_if(F.col("a") > 12).alias("a12"), F.count_if(F.col("b") > 12).alias("b12"), of_month("b").alias("dmy"), of_month("a").alias("mdy")
    )
    return votes.select(
        "file", F.expr("CASE WHEN a12 > 0 AND b12 = 0 THEN 'DMY' WHEN b12 > 0 AND a12 = 0 THEN 'MDY' WHEN dmy > mdy THEN 'DMY' ELSE 'MDY' END").alias("date_order"),
    )


def labelled_hours(lines: DataFrame, orders: DataFrame, base_year: Column, most: float = 16.0) -> DataFrame:
    """file, date, regular, overtime, total, distinct_values, unclear of lines(file, line_no, line) that state hours for a day.

    A line with exactly one date and without "period" gives a decimal or a number with a pay code behind the date, else the
    first labelled hours on it or the next three lines. A day with one distinct value has it; with several it is unclear.
    """
    # Cheap looks come first: every label has an h, and "period" a p.
    has = lambda letter: F.col("line").contains(letter) | F.col("line").contains(letter.upper())
    labelled = F.when(has("h") & F.col("line").rlike(LABEL), F.regexp_extract("line", LABEL, 1).try_cast("double"))
    by_line = W.partitionBy("file").orderBy("line_no")
    near = F.coalesce("own", *[F.lead("own", k).over(by_line) for k in (1, 2, 3)])
    rows = lines.withColumn("own", labelled).withColumn("label", near).drop("own").join(orders, "file")
    found = F.regexp_extract_all("line", F.lit(DATE), F.lit(0))
    rows = dates.once(rows, found.alias("found")).where((F.size("found") == 1) & ~(has("p") & F.lower("line").contains("period")))
    rows = dates.once(rows, dates.parse_date(F.col("found")[0], F.col("date_order"), base_year).alias("date")).where("date is not null")
    after = F.expr("substring(line, instr(line, found[0]) + length(found[0]))")
    same = F.coalesce(
        F.when(after.rlike(VALUE), F.regexp_extract(after, VALUE, 1).try_cast("double")),
        F.when(after.rlike(PAY_CODE), F.regexp_extract(after, PAY_CODE, 1).try_cast("double")),
    )
    ok = lambda c: F.when(c.between(0, most), c)
    # Bound before ok() names it three times: else its patterns run as often.
    rows = dates.once(rows, same.alias("same"))
    rows = dates.once(rows, F.coalesce(ok(F.col("same")), ok(F.col("label"))).alias("value")).where("value is not null")
    days = rows.groupBy("file", "date").agg(F.array_sort(F.collect_set(F.round("value", 2))).alias("seen"))
    r, o, t = hours.split_hours(F.when(F.size("seen") == 1, F.col("seen")[0]), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return days.select(
        "file", "date", r.alias("regular"), o.alias("overtime"), t.alias("total"), F.size("seen").alias("distinct_values"), (F.size("seen") > 1).alias("unclear"),
    )
