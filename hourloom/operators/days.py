"""Consolidate day entries of many sources into one record per employee and day, and the issues found on the way.

entries: emp, d, seq (arrival order), extractor, trust, regular, overtime, total; any other columns may be carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far each extractor is trusted, and any other.
TRUST = {
    "daily_grid": 3.0, "weekly_totals": 3.0, "excel": 3.0, "csv": 3.0, "pdf_native": 2.8, "llm_text": 2.4,
    "weekday_matrix": 2.0, "llm_vision": 1.9, "pdf_scanned": 1.2, "image": 1.2, "docx_media": 1.2,
}
OTHER_TRUST = 1.5
#: Most hours in a day; most of a difference that is no mismatch, for a month and a day.
MOST, MONTH_SLACK, DAY_SLACK = 16.0, 0.5, 0.05


def trust_of(extractor: Column, method: Column) -> Column:
    """Weight of the extractor, or of the method's part before a colon where there is none."""
    name = F.coalesce(extractor, F.split(method, ":")[0])
    weights = F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, name), F.lit(OTHER_TRUST))


def ident_key(name: Column, emp_id: Column) -> Column:
    """id: and the id's letters and digits, else nm: and the plain name, else nm:unknown."""
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit("unknown"))), "[^a-z0-9 ]", "")), r"\s+", " "))
    by_id = F.concat(F.lit("id:"), F.regexp_replace(F.lower(emp_id), "[^a-z0-9]", ""))
    return F.when(emp_id != "", by_id).otherwise(F.concat(F.lit("nm:"), F.when(plain != "", plain).otherwise(F.lit("unknown"))))


def has_hours() -> Column:
    return F.col("regular").isNotNull() | F.col("overtime").isNotNull() | F.col("total").isNotNull()


def resolve_days(entries: DataFrame, *carried: str) -> DataFrame:
    """One row per emp and d: the readable entry of the most trusted extractor, the first to arrive among equals.

    Adds n (readable entries), distinct_totals and sources (seq, extractor and, where entries have it, source, by arrival). One shuffle on
    (emp, d), after partial aggregation.
    """
    named = ["seq", "extractor", *(["source"] if "source" in entries.columns else [])]
    best = F.min_by(F.struct("seq", "extractor", "regular", "overtime", "total", *carried), F.struct(-F.col("trust"), F.col("seq")))
    days = entries.where(has_hours()).groupBy("emp", "d").agg(
        best.alias("best"), F.count("*").alias("n"), F.count_distinct(F.round("total", 2)).alias("distinct_totals"),
        F.array_sort(F.collect_list(F.struct(*named))).alias("sources"),
    )
    return days.select("emp", "d", "best.*", "n", "distinct_totals", "sources")


def duplicates(days: DataFrame, *carried: str) -> DataFrame:
    """Days with several readable entries: CONFLICT (error) if their totals differ, else DUPLICATE (info)."""
    conflict = F.col("distinct_totals") > 1
    return days.where("n > 1").select(
        "emp", "d", F.when(conflict, F.lit("CONFLICT")).otherwise(F.lit("DUPLICATE")).alias("code"),
        F.when(conflict, F.lit("error")).otherwise(F.lit("info")).alias("severity"), *carried,
    )


def active_calendar(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """All days of the months in which an employee has data: emp and the calendar's columns."""
    active = days.select("emp", F.trunc("d", "MM").alias("period")).distinct()
    return active.join(calendar, "period")


def missing_days(days: DataFrame, calendar: DataFrame, weekly: DataFrame | None = None) -> DataFrame:
    """emp, period, d: working days without data that no weekly interval covers, in months with data."""
    days = days.select("emp", "d")
    open_ = active_calendar(days, calendar).where(~F.col("is_weekend") & ~F.col("is_holiday")).select("emp", "period", F.col("date").alias("d"))
    out = open_.join(days, ["emp", "d"], "left_anti")
    if weekly is not None:
        inside = F.explode(F.sequence("week_start", "week_end"))
        out = out.join(weekly.where("week_start <= week_end").select("emp", inside.alias("d")).distinct(), ["emp", "d"], "left_anti")
    return out.select("emp", "period", "d")


def month_totals(days: DataFrame) -> DataFrame:
    """emp, period, regular, overtime, total, days_worked."""
    two = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return days.groupBy("emp", F.trunc("d", "MM").alias("period")).agg(
        two("regular").alias("regular"), two("overtime").alias("overtime"), two("total").alias("total"),
        F.count_if(F.col("total") > 0).alias("days_worked"),
    )


def client_breakdown(days: DataFrame, client: str, project: str) -> DataFrame:
    """Sums by the day's client (the employee's first client where the day has none) and project; nulls are a group."""
    first = days.where(F.col(client).isNotNull()).groupBy("emp").agg(F.min_by(client, "seq").alias("first_client"))
    rows = days.join(first, "emp", "left").withColumn("client", F.coalesce(client, "first_client")).withColumn("project", F.col(project))
    two = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(c)
    return rows.groupBy("emp", "client", "project").agg(two("regular"), two("overtime"), two("total"), F.count_if(F.col("total") > 0).alias("days_worked"))


def ordered_distinct(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """key, items: distinct non-empty values in order of first arrival; summed up by value before the list is made."""
    firsts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.min(seq).alias("at"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("items"))


def source(file: Column, extractor: Column, sheet: Column | None = None, page: Column | None = None, row: Column | None = None, cell: Column | None = None, region: Column | None = None) -> Column:
    """Where a value was read: a struct of file, sheet, page, row, cell, region, extractor; what isn't known is null."""
    known = {"sheet": (sheet, "string"), "page": (page, "int"), "row": (row, "long"), "cell": (cell, "string"), "region": (region, "string")}
    rest = [(F.lit(None) if c is None else c).cast(kind).alias(name) for name, (c, kind) in known.items()]
    return F.struct(file.cast("string").alias("file"), *rest, extractor.cast("string").alias("extractor"))


SOURCES = "array<struct<file:string,sheet:string,page:int,row:bigint,cell:string,region:string,extractor:string>>"


def source_label(at: Column) -> Column:
    """file, sheet, page, cell or else row, and region, as far as they are known."""
    place = F.coalesce(at["cell"], F.concat(F.lit("row"), at["row"].cast("string")))
    return F.concat_ws(
        " · ", at["file"], F.concat(F.lit("sheet="), at["sheet"]), F.concat(F.lit("p"), at["page"].cast("string")), place, F.concat(F.lit("@"), at["region"]),
    )


def labels(sources: Column) -> Column:
    """The labels of an issue's sources in one text."""
    return F.array_join(F.transform(sources, source_label), "; ")


def files_of(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, sources: the files that rows' sources name, once each; summed up by file before the lists are made."""
    none = lambda kind: F.lit(None).cast(kind)
    names = rows.where("source.file is not null").select(*keys, F.col("source.file").alias("file")).distinct()
    own = F.struct(
        F.col("file"), none("string").alias("sheet"), none("int").alias("page"), none("long").alias("row"), none("string").alias("cell"),
        none("string").alias("region"), none("string").alias("extractor"),
    )
    return names.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("sources"))


def issue(rows: DataFrame, scope: str, code: str | Column, severity: str | Column, message: Column, day: str | None = "d") -> DataFrame:
    """Rows of the issue table: emp, period, scope, date, code, severity, message, and sources if the rows have them."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    period = F.trunc(day, "MM") if day else F.col("period")
    date = F.col(day) if day else F.lit(None).cast("date")
    sources = F.coalesce(F.col("sources"), F.array().cast(SOURCES)) if "sources" in rows.columns else F.array().cast(SOURCES)
    return rows.select(
        "emp", period.alias("period"), F.lit(scope).alias("scope"), date.alias("date"), lit(code).alias("code"), lit(severity).alias("severity"), message.alias("message"), sources.alias("sources"),
    )


def day_issues(entries: DataFrame, days: DataFrame, calendar: DataFrame, most: float = MOST, weekly: DataFrame | None = None) -> DataFrame:
    """The issue table of days: each rule is a filter, all are one union.

    Over-limit totals show twice, for the entry and for the day it won; negative values and r + o against t by day. Where entries have a
    column source, each issue names its sources: the entry's, the day's, and for a missing day the files of its month. weekly: intervals
    whose days aren't missing.
    """
    known = "source" in entries.columns
    if known:
        entries = entries.withColumn("sources", F.array("source"))
        days = days.withColumn("sources", F.transform("sources", lambda s: s["source"]))
    else:
        days = days.drop("sources")
    over = F.concat(F.col("total").cast("string"), F.lit("h exceeds the day's bound"))
    off = days.join(calendar.select(F.col("date").alias("d"), "is_weekend", "is_holiday"), "d").where((F.col("is_weekend") | F.col("is_holiday")) & (F.col("total") > 0))
    values = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in ("regular", "overtime", "total")])
    negative = days.select("emp", "d", *(["sources"] if known else []), F.inline(values)).where("value < 0")
    missing = missing_days(days, calendar, weekly)
    if known:
        missing = missing.join(files_of(entries.withColumn("period", F.trunc("d", "MM")), "emp", "period"), ["emp", "period"], "left")
    parts = [
        issue(entries.where(F.col("total") > most), "entry", "OUT_OF_RANGE", "warning", over),
        issue(days.where(F.col("total") > most), "day", "OUT_OF_RANGE", "warning", over),
        issue(off, "day", "OUT_OF_RANGE", "info", F.when(F.col("is_holiday"), F.lit("hours on a holiday")).otherwise(F.lit("hours on a weekend"))),
        issue(duplicates(days, *(["sources"] if known else [])), "day", F.col("code"), F.col("severity"), F.lit("several sources")),
        issue(days.where(F.abs(F.col("regular") + F.col("overtime") - F.col("total")) > DAY_SLACK), "day", "TOTAL_MISMATCH", "warning", F.lit("regular and overtime are not the total")),
        issue(negative, "day", "INVALID", "error", F.concat(F.lit("negative "), F.col("label"))),
        issue(missing, "day", "MISSING", "info", F.lit("no data for a working day")),
    ]
    return reduce(DataFrame.unionByName, parts)


def severity_rank() -> Column:
    return F.expr("CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END")


def drop_settled(issues: DataFrame, days: DataFrame) -> DataFrame:
    """Issues without the "unreadable" ones of days for which some source gave a value."""
    unreadable = (F.col("code") == "UNCLEAR") & F.col("message").contains("unreadable")
    settled = days.where(has_hours()).select("emp", F.col("d").alias("date"))
    return issues.where(~unreadable).unionByName(issues.where(unreadable).join(settled, ["emp", "date"], "left_anti").select(issues.columns))


def by_name(people: DataFrame, name: str = "employee_name") -> DataFrame:
    """People by name without regard to case; those without a name count as "Unknown"."""
    return people.orderBy(F.lower(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("Unknown"))), name)


def day_status(days: DataFrame, calendar: DataFrame, issues: DataFrame) -> DataFrame:
    """Flags of every calendar day of active months: weekend, holiday, missing, overtime, flagged (an issue above info)."""
    bad = issues.where(F.col("severity") != "info").select("emp", F.col("date").alias("d")).distinct().withColumn("bad", F.lit(True))
    all_days = active_calendar(days, calendar).withColumnRenamed("date", "d")
    rows = all_days.join(days.select("emp", "d", "regular", "overtime", "total"), ["emp", "d"], "left").join(bad, ["emp", "d"], "left")
    return rows.select(
        "emp", "d", "is_weekend", "is_holiday", (~F.col("is_weekend") & ~F.col("is_holiday") & ~has_hours()).alias("missing"),
        (F.coalesce("overtime", F.lit(0.0)) > 0).alias("overtime"), F.coalesce("bad", F.lit(False)).alias("flagged"),
    )


def report_stats(months: DataFrame, days: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: employees, employee_months, worked_days, total_hours, issues, employees_with_errors."""
    a = months.agg(
        F.count_distinct("emp").alias("employees"), F.count("*").alias("employee_months"), F.round(F.sum("total"), 2).alias("total_hours"),
        F.sum("days_worked").alias("worked_days"),
    )
    b = issues.agg(F.count("*").alias("issues"), F.count_distinct(F.when(F.col("severity") == "error", F.col("emp"))).alias("employees_with_errors"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")
