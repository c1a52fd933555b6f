"""Weekly totals: each calendar day counts once, by daily data first, then by the first week that covers it.

weekly: emp, week_start, week_end, total, seq. daily: emp, d, total (one row a day). Bounds are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.operators.days import MONTH_SLACK


def _bounds() -> list[Column]:
    """The least and the largest total of a group: several totals differ just where these do, and no second shuffle counts them."""
    return [F.min(F.round("total", 2)).alias("least_total"), F.max(F.round("total", 2)).alias("most_total")]


def _code() -> Column:
    return F.when((F.col("n") > 1) & (F.col("least_total") != F.col("most_total")), F.lit("CONFLICT")).when(F.col("n") > 1, F.lit("DUPLICATE"))


def dedupe(weekly: DataFrame) -> DataFrame:
    """One row per emp, week_start and week_end: the largest total (null as 0), the first to arrive among equals."""
    best = F.max_by(F.struct("total", "seq"), F.struct(F.coalesce("total", F.lit(0.0)), -F.col("seq")))
    rows = weekly.groupBy("emp", "week_start", "week_end").agg(
        best.alias("best"), F.count("*").alias("n"), *_bounds(),
    )
    return rows.select("emp", "week_start", "week_end", "best.total", "best.seq", "n", _code().alias("code"))


def owned(weeks: DataFrame, daily: DataFrame, *carried: str) -> DataFrame:
    """What weeks own of months: emp, period, week_start, week_end, total, span, carried, days, a bit for each day of the month, the lowest
    for the first. Weeks that own nothing of a month are left out, and reversed intervals own nothing.

    A week is a row in each month that it meets, never a row a day; bits of daily data and of the weeks before are taken off its own. A week
    with a null total owns its days too.
    """
    known = daily.groupBy("emp", F.trunc("d", "MM").alias("period")).agg(F.bit_or(F.expr("shiftleft(1L, day(d) - 1)")).alias("known"))
    months = F.explode(F.expr("sequence(trunc(week_start, 'MM'), trunc(week_end, 'MM'), interval 1 month)"))
    span = F.datediff("week_end", "week_start") + 1
    rows = weeks.where("week_start <= week_end").select("emp", "week_start", "week_end", "total", "seq", *carried, span.alias("span"), months.alias("period"))
    first, last = "day(greatest(week_start, period))", "day(least(week_end, last_day(period)))"
    rows = rows.withColumn("days", F.expr(f"shiftleft(shiftleft(1L, {last} - {first} + 1) - 1L, {first} - 1)"))
    before = F.bit_or("days").over(W.partitionBy("emp", "period").orderBy("week_start", "seq").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).drop("seq").join(known, ["emp", "period"], "left")
    taken = F.coalesce("before", F.lit(0)).bitwiseOR(F.coalesce("known", F.lit(0)))
    return rows.withColumn("days", F.col("days").bitwiseAND(F.bitwise_not(taken))).where("days <> 0").drop("before", "known")


def coverage(weeks: DataFrame, daily: DataFrame) -> DataFrame:
    """Days that a week owns: emp, d, week_start, week_end, total, span."""
    own = F.explode(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.getbit("days", k) == 1))
    days = owned(weeks, daily).select("*", own.alias("k"))
    return days.select("emp", F.date_add("period", F.col("k")).alias("d"), "week_start", "week_end", "total", "span")


def rollup(weeks: DataFrame, daily: DataFrame) -> DataFrame:
    """emp, period, total, days_worked: daily sums plus each week's share of days that it owns in the month.

    Days of weekly work are estimated at eight hours, rounded half to even for each week.
    """
    part = F.coalesce(F.col("total"), F.lit(0.0)) * F.bit_count("days") / F.col("span")
    by_week = owned(weeks, daily).withColumn("part", part).groupBy("emp", "period").agg(
        F.sum("part").alias("total"), F.sum(F.bround(F.col("part") / 8)).cast("long").alias("days_worked"),
    )
    by_day = daily.groupBy("emp", F.trunc("d", "MM").alias("period")).agg(F.sum("total").alias("total"), F.count_if(F.col("total") > 0).alias("days_worked"))
    both = by_week.unionByName(by_day).groupBy("emp", "period").agg(F.round(F.sum("total"), 2).alias("total"), F.sum("days_worked").alias("days_worked"))
    return both


def dedupe_split(weekly: DataFrame) -> DataFrame:
    """dedupe() of weeks that also have regular and overtime, which the kept row brings along; with the sources of all its rows where weeks
    have a column source."""
    first = F.min_by(F.struct("total", "regular", "overtime", "seq"), F.struct(-F.coalesce("total", F.lit(0.0)), F.col("seq")))
    sources = [F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("sources")] if "source" in weekly.columns else []
    rows = weekly.groupBy("emp", "week_start", "week_end").agg(
        first.alias("best"), F.count("*").alias("n"), *_bounds(), *sources,
    )
    return rows.select("emp", "week_start", "week_end", "best.*", "n", _code().alias("code"), *(["sources"] if sources else []))


def rollup_split(weeks: DataFrame, daily: DataFrame) -> DataFrame:
    """emp, period, regular, overtime, total, days_worked: rollup() with its parts. weeks: of dedupe_split; daily: emp, d, regular,
    overtime, total. A week's total that isn't split counts as regular."""
    parts = weeks.select("emp", "week_start", "week_end", "total", "seq", F.coalesce("regular", "total").alias("regular"), "overtime")
    per = owned(parts, daily, "regular", "overtime").withColumn("share", F.bit_count("days") / F.col("span"))
    part = lambda c: F.coalesce(F.sum(F.col(c) * F.col("share")), F.lit(0.0)).alias(c)
    by_week = per.groupBy("emp", "period").agg(
        part("regular"), part("overtime"), part("total"), F.coalesce(F.sum(F.bround(F.col("total") * F.col("share") / 8)), F.lit(0)).cast("long").alias("days_worked"),
    )
    plain = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    by_day = daily.groupBy("emp", F.trunc("d", "MM").alias("period")).agg(
        plain("regular"), plain("overtime"), plain("total"), F.count_if(F.col("total") > 0).alias("days_worked"),
    )
    two = lambda c: F.round(F.sum(c), 2).alias(c)
    return by_week.unionByName(by_day).groupBy("emp", "period").agg(two("regular"), two("overtime"), two("total"), F.sum("days_worked").alias("days_worked"))


def stated_mismatch(months: DataFrame, stated: DataFrame, slack: float = MONTH_SLACK) -> DataFrame:
    """emp, period, total, stated, and what else stated brings: months whose stated total is off by more than slack."""
    rest = [c for c in stated.columns if c not in ("emp", "period", "stated")]
    return months.select("emp", "period", "total").join(stated, ["emp", "period"]).where(F.abs(F.col("stated") - F.col("total")) > slack).select("emp",
    "period", "total", "stated", *rest)


def stated_only(months_with_data: DataFrame, stated: DataFrame) -> DataFrame:
    """Months known by a stated total alone: it becomes regular and total, with days at eight hours, half to even."""
    rest = [c for c in stated.columns if c not in ("emp", "period", "stated")]
    alone = stated.join(months_with_data.select("emp", "period"), ["emp", "period"], "left_anti")
    return alone.select(
        "emp", "period", F.round("stated", 2).alias("regular"), F.round("stated", 2).alias("total"),
        F.bround(F.col("stated") / 8).cast("long").alias("days_worked"), *rest,
    )


def with_stated(months: DataFrame, stated: DataFrame) -> DataFrame:
    """months (emp, period, regular, overtime, total, days_worked) and, below them, those that only stated(emp, period, stated) knows."""
    alone = stated_only(months, stated.select("emp", "period", "stated"))
    return months.unionByName(alone.select("emp", "period", "regular", F.lit(0.0).alias("overtime"), "total", "days_worked"))
