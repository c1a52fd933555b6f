"""Review of records: latest-wins tables, profile lookups, the review calendar and submission checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version for each key; summed up before the shuffle, without a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """target with updates merged in: the highest version of each key. A repeated batch changes nothing."""
    return latest(target.unionByName(updates), keys, version)


def with_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows with full_name and client of their user, or fallbacks."""
    names = profiles.select("user_id", "full_name", "client")
    return rows.join(names, "user_id", "left").withColumn("full_name", F.coalesce("full_name", F.lit("Unknown"))).withColumn("client", F.coalesce("client", F.lit("—")))


def visible(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """viewer, and what each may see: an admin all rows, an employee their own."""
    own = rows.join(profiles.where("role <> 'admin'").select(F.col("user_id").alias("viewer")), F.col("user_id") == F.col("viewer"))
    admins = profiles.where("role = 'admin'").select(F.col("user_id").alias("viewer")).withColumn("k", F.lit(1))
    totals = rows.groupBy().agg(F.count("*").alias("rows"), F.sum("total").alias("total")).withColumn("k", F.lit(1))
    return own.groupBy("viewer").agg(F.count("*").alias("rows"), F.sum("total").alias("total")).unionByName(admins.join(totals, "k").select("viewer", "rows", "total"))


def rows_visible_to(rows: DataFrame, profiles: DataFrame, viewers: list[int]) -> DataFrame:
    """viewer, and the rows that each of a few viewers may see: an admin all, an employee their own, one without a profile none.

    The viewers' profiles are broadcast: they are as few as the viewers, which no statistic tells, and rows are then neither shuffled
    nor sorted."""
    who = profiles.where(F.col("user_id").isin(viewers)).select(F.col("user_id").alias("viewer"), "role")
    own = rows.where(F.col("user_id").isin(viewers)).join(F.broadcast(who.where("role <> 'admin'").select("viewer")), F.col("user_id") == F.col("viewer"))
    tag = F.explode(F.array(*[F.lit(v).cast("long") for v in viewers]))
    every = rows.withColumn("viewer", tag).join(F.broadcast(who.where("role = 'admin'").select("viewer")), "viewer", "left_semi")
    return own.unionByName(every)


def review_calendar(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """A month grid with its users' days: totals fall back to regular and overtime; filled and worked_on_holiday flags."""
    users = days.select("user_id", F.trunc("d", "MM").alias("period")).distinct()
    grid = users.join(calendar, "period").withColumnRenamed("date", "d")
    rows = grid.join(days, ["user_id", "d"], "left")
    total = F.coalesce(
        "total", F.when(F.col("regular").isNotNull() | F.col("overtime").isNotNull(), F.coalesce("regular", F.lit(0.0)) + F.coalesce("overtime", F.lit(0.0))),
    )
    return rows.select(
        "user_id", "period", "d", "is_weekend", "is_holiday", "regular", "overtime", total.alias("total"), total.isNotNull().alias("filled"),
        (F.col("is_holiday") & (F.coalesce(total, F.lit(0.0)) > 0)).alias("worked_on_holiday"),
    )


def correct(days: DataFrame, corrections: DataFrame) -> DataFrame:
    """Days with manual corrections: total is regular plus overtime, null if both are; the flag is cleared."""
    c = corrections.select("user_id", "d", F.col("regular").alias("r2"), F.col("overtime").alias("o2"), F.lit(True).alias("hit"))
    total = F.when(F.col("r2").isNotNull() | F.col("o2").isNotNull(), F.coalesce("r2", F.lit(0.0)) + F.coalesce("o2", F.lit(0.0)))
    pick = lambda new, old: F.when(F.col("hit"), new).otherwise(F.col(old)).alias(old)
    rows = days.join(c, ["user_id", "d"], "left")
    return rows.select(
        "user_id", "d", pick(F.col("r2"), "regular"), pick(F.col("o2"), "overtime"), pick(total, "total"),
        (F.col("flagged") & F.col("hit").isNull()).alias("flagged"),
    )


def month_sums(calendar: DataFrame) -> DataFrame:
    """Sums of a review calendar by user and month, with the working days left empty."""
    two = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return calendar.groupBy("user_id", "period").agg(
        two("regular").alias("regular"), two("overtime").alias("overtime"), two("total").alias("total"), F.count_if(F.col("total") > 0).alias("days_worked"),
        two(F.when(F.col("is_weekend"), F.col("total"))).alias("weekend"), two(F.when(F.col("is_holiday"), F.col("total"))).alias("holiday"),
        F.count_if(~F.col("is_weekend") & ~F.col("is_holiday") & ~F.col("filled")).alias("empty_days"),
    )


def submission_check(sums: DataFrame, slack: float = 0.5) -> DataFrame:
    """Messages on submissions: sums with full_name, client, stated_regular, stated_overtime, weekends ('yes', 'no'), holidays_taken.

    ok when there is no error; infos and warnings don't block.
    """
    say = lambda cond, text: F.when(cond, F.lit(text))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    errors = [
        say(empty("full_name"), "name is empty"),
        say(F.abs(F.col("stated_regular") - F.col("regular")) > slack, "stated regular hours are off"),
        say(F.abs(F.col("stated_overtime") - F.col("overtime")) > slack, "stated overtime is off"),
        say((F.col("weekends") == "yes") & (F.col("weekend") == 0), "weekend work stated but no hours"),
        say(F.col("holidays_taken") < 0, "holidays taken below 0"),
    ]
    warnings = [
        say(empty("client"), "client is empty"),
        say((F.col("weekends") == "no") & (F.col("weekend") > 0), "weekend hours but none stated"),
        say((F.col("holidays_taken") == 0) & (F.col("holiday") > 0), "holiday hours not marked"),
    ]
    infos = [say(F.col("empty_days") > 0, "working days are empty")]
    pack = lambda tests: F.array_join(F.array_compact(F.array(*tests)), "; ")
    out = sums.select("user_id", "period", pack(errors).alias("errors"), pack(warnings).alias("warnings"), pack(infos).alias("infos"))
    return out.withColumn("ok", F.col("errors") == "")


def holiday_answers(calendar: DataFrame, answers: DataFrame) -> DataFrame:
    """user_id, period, d, severity, message: each answer of answers(user_id, period, worked: map of date to boolean) against the day of a
    review calendar: worked by the answer without hours, or hours that no answer marks."""
    said = answers.select("user_id", F.explode("worked").alias("d", "said"))
    days = calendar.where("is_holiday").select("user_id", "period", "d", F.coalesce("total", F.lit(0.0)).alias("total"))
    rows = days.join(said, ["user_id", "d"], "left").withColumn("said", F.coalesce("said", F.lit(False)))
    wrong = F.when(F.col("said") & (F.col("total") == 0), F.struct(F.lit("error").alias("severity"), F.lit("holiday marked as worked but no hours").alias("message")))
    wrong = wrong.when(~F.col("said") & (F.col("total") > 0), F.struct(F.lit("warning").alias("severity"), F.lit("holiday hours not marked").alias("message")))
    return rows.select("user_id", "period", "d", wrong.alias("w")).where("w is not null").select("user_id", "period", "d", "w.*")


def findings(checked: DataFrame, holidays: DataFrame) -> DataFrame:
    """All findings on submissions as rows: submission_check()'s messages, one each, and holiday_answers()'."""
    tell = lambda severity: F.transform(F.filter(F.split(f"{severity}s", "; "), lambda m: m != ""), lambda m: F.struct(F.lit(severity).alias("severity"), m.alias("message")))
    each = [tell(severity) for severity in ("error", "warning", "info")]
    rows = checked.select("user_id", "period", F.lit(None).cast("date").alias("d"), F.inline(F.concat(*each)))
    return rows.unionByName(holidays)


def prefilled(sums: DataFrame, calendar: DataFrame) -> DataFrame:
    """Answers read off the calendar: stated hours, whether weekends were worked, and which holidays."""
    worked = F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", (F.coalesce("total", F.lit(0.0)) > 0).alias("v")))))
    holidays = calendar.where("is_holiday").groupBy("user_id", "period").agg(worked.alias("holidays_worked"))
    weekends = F.when(F.col("weekend") > 0, F.lit("yes")).otherwise(F.lit("no"))
    rows = sums.join(holidays, ["user_id", "period"], "left")
    none = F.map_from_arrays(F.array().cast("array<date>"), F.array().cast("array<boolean>"))
    return rows.select(
        "user_id", "period", F.col("regular").alias("stated_regular"), F.col("overtime").alias("stated_overtime"), weekends.alias("weekends"),
        F.coalesce("holidays_worked", none).alias("holidays_worked"),
    )


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
