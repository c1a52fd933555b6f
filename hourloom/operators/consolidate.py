"""From cells and texts to records: the cascade of strategies, identities, and the findings about months.

A file has tables (cells with file and table_id), text lines and hints (name, client). Each table takes the strategy that finds most;
a file without any finding falls back to labelled hours in its text, then to a stated month total, and else asks for another read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.operators import days, grids, weekly
from hourloom.operators.days import ident_key, issue
from hourloom.operators.lines import date_orders, labelled_hours
from hourloom.sources.staged import staged

#: Confidence of weekly totals, of a matrix, of labelled hours (all days clear, or not), of a stated total, of nothing.
WEEKLY, MATRIX, TEXT, UNCLEAR_TEXT, SUMMARY, NOTHING = 0.7, 0.6, 0.72, 0.45, 0.6, 0.1
#: Of a weekday matrix without a date.
UNDATED = 0.2
#: A read by vision or a model of fewer hours and days than these is likely incomplete.
LEAST_HOURS, LEAST_DAYS = 80, 10


@dataclass
class Found:
    """results: file, period, method, found, confidence, stated_total, needs_llm. entries: file, extractor, table_id, row_id, d, regular,
    overtime, total, issue. weeks: file, table_id, row_id, week_start, week_end, regular, overtime, total. All read staged tables."""

    results: DataFrame
    entries: DataFrame
    weeks: DataFrame


def table_results(daily: DataFrame, weeks: DataFrame, matrix: DataFrame, undated: DataFrame | None = None) -> DataFrame:
    """table_id, method, found, confidence, needs_llm: what each strategy finds in each table. undated: table_id of weekday matrices for
    which no date is known or which hold nothing."""
    readable = F.count_if(F.coalesce("issue", F.lit("")) != "UNCLEAR")
    by = lambda rows, method, confidence: rows.groupBy("table_id").agg(F.count("*").alias("found"), confidence.alias("confidence")).withColumn("method", F.lit(method))
    parts = [by(daily, "daily_grid", F.round(readable / F.count("*"), 2)), by(weeks, "weekly_totals", F.lit(WEEKLY)), by(matrix, "weekday_matrix", F.lit(MATRIX))]
    if undated is not None:
        parts.append(undated.select("table_id", F.lit(0).cast("long").alias("found"), F.lit(UNDATED).alias("confidence"), F.lit("weekday_matrix").alias("method")))
    rows = reduce(DataFrame.unionByName, [p.select("table_id", "method", "found", F.col("confidence").cast("double").alias("confidence")) for p in parts])
    return rows.withColumn("needs_llm", F.col("found") == 0)


def cascade(files: DataFrame, cells: DataFrame, text: DataFrame, most: float = 16.0) -> Found:
    """All files in one job. files(file, period): period is the month that a file was handed in for, to which stated totals belong;
    cells(file, table_id, row_id, col, value) with table_ids that no two files share; text(file, line_no, line).

    Cells are brought together by row and parsed once: rows with their roles, and what each strategy finds, are staged, and all that
    follows reads these tables.
    """
    files = files.select("file", "period").dropDuplicates(["file"])
    lines = staged(text.select("file", "line_no", "line").join(files, "file"), "file-lines")
    own = staged(grids.grid_rows(cells).join(files, "file"), "grid-rows")
    texts = own.select("file", "period", F.explode(F.col("cells")["value"]).alias("text")).where("text is not null")
    orders = staged(date_orders(texts.unionByName(lines.select("file", "period", F.col("line").alias("text"))), F.col("period")), "date-orders")
    owned = files.join(orders, "file", "left").select("file", "period", F.coalesce("date_order", F.lit("MDY")).alias("date_order"))
    order, base_year = F.col("date_order"), F.year("period")

    rows = staged(grids.role_columns(own.join(owned.select("file", "date_order"), "file")), "role-rows")
    daily = staged(grids.daily_grid(rows, order, base_year, most), "daily-entries")
    # A table with week bounds but no column of hours, or only overtime, has no weekly totals.
    weeks = staged(grids.weekly_totals(rows, order, base_year).where("regular is not null"), "weekly-totals")
    stated = grids.stated_totals(rows, order, base_year, "date", "week_start", "week_end")
    of_file = staged(own.select("table_id", "file", "period").distinct(), "tables")
    anchors = grids.text_anchors(lines.drop("period").join(owned, "file"), order, base_year)
    heads = staged(grids.weekday_heads(own).join(of_file, "table_id").join(anchors, "file", "left"), "matrix-heads")
    matrix = staged(grids.matrix_days(own.select("table_id", "row_id", "cells"), heads.where("anchor is not null")), "matrix-days")
    undated = heads.select("table_id").join(matrix.select("table_id").distinct(), "table_id", "left_anti")
    labelled = staged(labelled_hours(lines.select("file", "line_no", "line"), owned.select("file", "date_order", "period"), base_year, most), "labelled-hours")
    summaries = grids.summary_totals(own, F.col("period"))

    found = table_results(daily, weeks, matrix, undated)
    best = grids.best_strategy(found).join(of_file, "table_id").withColumn("needs_llm", F.col("found") == 0)
    said = F.when(F.col("method") != "weekday_matrix", F.col("stated_total"))
    best = staged(best.join(stated, "table_id", "left").withColumns({"seq": F.col("table_id"), "stated_total": said}), "best-strategies")
    tables = grids.merge_results(best)
    said = labelled.groupBy("file").agg(F.count("*").alias("text_found"), F.bool_or("unclear").alias("unclear"))
    totals = summaries.join(of_file, "table_id").groupBy("file").agg(F.min_by("stated_total", "table_id").alias("summary_total"))
    all_ = files.join(tables, "file", "left").join(said, "file", "left").join(totals, "file", "left")
    kind = F.when(F.col("found") > 0, F.lit(0)).when(F.col("text_found") > 0, F.lit(1)).when(F.col("summary_total").isNotNull(), F.lit(2)).otherwise(F.lit(3))
    pick = lambda *options: F.element_at(F.array(*options), kind + 1)
    weak = F.greatest(F.lit(NOTHING), F.coalesce(F.col("confidence") / 2, F.lit(NOTHING)))
    by_text = F.when(F.col("unclear"), F.lit(UNCLEAR_TEXT)).otherwise(F.lit(TEXT))
    results = staged(all_.select(
        "file", "period", pick(F.col("method"), F.lit("text_hours_labeled"), F.lit("summary_total"), F.lit("deterministic_insufficient")).alias("method"),
        F.coalesce(pick(F.col("found"), F.col("text_found"), F.lit(0).cast("long"), F.lit(0).cast("long")), F.lit(0)).alias("found"),
        pick(F.col("confidence"), by_text, F.lit(SUMMARY), weak).alias("confidence"),
        pick(F.col("stated_total"), F.lit(None).cast("double"), F.col("summary_total"), F.lit(None).cast("double")).alias("stated_total"),
        pick(F.lit(False), F.col("unclear"), F.lit(False), F.lit(True)).alias("needs_llm"),
    ), "results")
    chosen = lambda part, method: part.join(best.where((F.col("method") == method) & (F.col("found") > 0)).select("table_id", "file"), "table_id")
    none = lambda kind: F.lit(None).cast(kind)
    issue_ = F.when(F.col("unclear"), F.lit("SEVERAL"))
    entries = chosen(daily, "daily_grid").select("file", F.lit("daily_grid").alias("extractor"), "table_id", "row_id", "d", "regular", "overtime", "total", "issue")
    by_day = chosen(matrix, "weekday_matrix").select(
        "file", F.lit("weekday_matrix").alias("extractor"), "table_id", none("long").alias("row_id"), "d", none("double").alias("regular"),
        none("double").alias("overtime"), "total", none("string").alias("issue"),
    )
    read = labelled.join(results.where("method = 'text_hours_labeled'").select("file"), "file")
    read = read.select(
        "file", F.lit("text_hours_labeled").alias("extractor"), none("long").alias("table_id"), none("long").alias("row_id"), F.col("date").alias("d"), "regular",
        "overtime", "total", issue_.alias("issue"),
    )
    return Found(results, entries.unionByName(by_day).unionByName(read), chosen(weeks, "weekly_totals"))


def attach_identity(results: DataFrame, hints: DataFrame) -> DataFrame:
    """results with file_seq, employee_name, employee_id, client and ident: what a result says of these, else its file's hints(file,
    file_seq, name_hint, client_hint); ident groups the files of one person."""
    known = [c for c in ("employee_name", "employee_id", "client") if c in results.columns]
    rows = results.join(hints, "file", "left")
    own = lambda c: F.nullif(F.col(c), F.lit("")) if c in known else F.lit(None).cast("string")
    named = rows.withColumns(
        {"employee_name": F.coalesce(own("employee_name"), "name_hint"), "employee_id": own("employee_id"), "client": F.coalesce(own("client"), "client_hint")},
    )
    return named.drop("name_hint", "client_hint").withColumn("ident", ident_key(F.col("employee_name"), F.col("employee_id")))


def people(results: DataFrame) -> DataFrame:
    """One row an ident of attach_identity()'s results: the first name, id and stated total in order of files, mean confidence,
    whether any file needs another read, and clients, files and methods in order of arrival."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("file_seq"))).alias(c)
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("file_seq", c)))), lambda x: x[c]))
    return results.groupBy("ident").agg(
        first("employee_name"), first("employee_id"), first("stated_total"), F.round(F.avg("confidence"), 2).alias("confidence"), F.bool_or("needs_llm").alias("needs_llm"),
        listed("client").alias("clients"), listed("file").alias("files"), listed("method").alias("methods"),
    )


@dataclass
class Records:
    """By person (emp): entries with trust, seq and source, days of resolve_days, weeks of dedupe_split, stated(emp, period, stated, sources),
    reads(emp, period, method, needs_llm, source) and months with data."""

    entries: DataFrame
    days: DataFrame
    weeks: DataFrame
    stated: DataFrame
    reads: DataFrame
    months: DataFrame


def person_records(found: Found, named: DataFrame) -> Records:
    """Everything found, by person: days by trust, each calendar day once, weeks once, the first stated total of a month in order of files."""
    who = named.select("file", F.col("ident").alias("emp"), "file_seq")
    none = F.lit(None)
    trust = days.trust_of(F.col("extractor"), F.col("extractor"))
    at = days.source(F.col("file"), F.col("extractor"), sheet=F.col("table_id"), row=F.col("row_id"))
    seq = F.struct("file_seq", F.coalesce("table_id", F.lit(-1)).alias("t"), F.coalesce("row_id", F.lit(-1)).alias("r"))
    entries = found.entries.join(who, "file").select(
        "emp", "d", seq.alias("seq"), "extractor", trust.alias("trust"), "regular", "overtime", "total", "issue", at.alias("source"),
    )
    resolved = staged(days.resolve_days(entries), "person-days")
    at = days.source(F.col("file"), F.lit("weekly_totals"), sheet=F.col("table_id"), row=F.col("row_id"))
    weeks = found.weeks.join(who, "file").select(
        "emp", "week_start", "week_end", "regular", "overtime", "total", F.struct("file_seq", "table_id", "row_id").alias("seq"), at.alias("source"),
    )
    weeks = staged(weekly.dedupe_split(weeks), "person-weeks")
    reads = named.select(
        F.col("ident").alias("emp"), "period", "method", "needs_llm", "file_seq", "stated_total",
        days.source(F.col("file"), F.col("method"), row=none).alias("source"),
    )
    first = F.min_by(F.struct("stated_total", "source"), "file_seq").alias("first")
    stated = reads.where("stated_total is not null").groupBy("emp", "period").agg(first).select(
        "emp", "period", F.col("first.stated_total").alias("stated"), F.array("first.source").alias("sources"),
    )
    months = staged(weekly.rollup_split(weeks.drop("sources"), resolved), "person-months")
    return Records(entries, resolved, weeks, stated, reads, months)


def records(found: Found, named: DataFrame) -> DataFrame:
    """ident, period, regular, overtime, total, days_worked: months from days and weeks, and those that a stated total alone is known of."""
    got = person_records(found, named)
    return weekly.with_stated(got.months, got.stated).withColumnRenamed("emp", "ident")


def entry_issues(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Findings of single entries: unreadable hours, several hours for one day, and nothing of a day that another source settles."""
    said = F.when(F.col("issue") == "UNCLEAR", F.lit("date present but hours unreadable")).when(F.col("issue") == "SEVERAL", F.lit("several labelled hours for the day"))
    rows = entries.where(F.col("issue").isin("UNCLEAR", "SEVERAL")).withColumn("sources", F.array("source"))
    return days.drop_settled(days.issue(rows, "entry", "UNCLEAR", "warning", said), resolved)


def all_issues(got: Records, calendar: DataFrame) -> DataFrame:
    """The whole issue table of records: entries, days, weeks and months, each row with its sources."""
    entries = staged(got.entries, "person-entries")
    nobody = got.reads.select("emp", "period", F.lit(0).cast("long").alias("cluster"), "source").limit(0)
    parts = [
        entry_issues(entries, got.days),
        days.day_issues(entries, got.days, calendar, weekly=got.weeks),
        month_issues(got.weeks, got.months, got.stated, got.reads, nobody),
    ]
    return reduce(DataFrame.unionByName, parts)


def split_names(clusters: DataFrame, stems: DataFrame, names: DataFrame, hint: Column) -> DataFrame:
    """ident, cluster, employee_name of idents that hold several people: the name and the hint words of the cluster's first file that
    the name lacks. clusters(ident, file_seq, cluster), stems(file_seq, stem), names(ident, employee_name); hint: words of a stem."""
    several = clusters.groupBy("ident").agg(F.count_distinct("cluster").alias("n")).where("n > 1").select("ident")
    first = clusters.join(several, "ident").groupBy("ident", "cluster").agg(F.min("file_seq").alias("file_seq"))
    rows = first.join(stems, "file_seq", "left").join(names, "ident", "left")
    base = F.coalesce("employee_name", F.lit("Unknown"))
    plain = lambda words: F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,\-]+|[.,\-]+$", ""))
    seen = plain(F.split(base, r"[\s\-]+"))
    extra = F.array_join(F.filter(hint, lambda w: ~F.array_contains(seen, F.regexp_replace(F.lower(w), r"^[.,\-]+|[.,\-]+$", ""))), " ")
    return rows.select("ident", "cluster", F.when(extra != "", F.concat(base, F.lit(" — "), extra)).otherwise(base).alias("employee_name"))


def month_issues(weeks: DataFrame, months: DataFrame, stated: DataFrame, read_by: DataFrame, clusters: DataFrame) -> DataFrame:
    """The findings about weeks and months, as rows of the issue table (emp, period, scope, date, code, severity, message, sources).

    weeks: of weekly.dedupe or dedupe_split, so with their code; months: emp, period, total, days_worked from days and weeks; stated: emp,
    period, stated; read_by: emp, period, method, needs_llm, one row a result; clusters: emp, period, cluster, the people that a name was
    split into. weeks and stated may have sources, read_by and clusters a source. A month that is read by a model and has no hours
    counts as one of 0.
    """
    kept = lambda rows: ["sources"] if "sources" in rows.columns else []
    own = weeks.where("code is not null").select("emp", F.trunc("week_start", "MM").alias("period"), "week_start", "code", *kept(weeks))
    months_of = F.expr("sequence(trunc(least(week_start, week_end), 'MM'), trunc(greatest(week_start, week_end), 'MM'), interval 1 month)")
    inside = weeks.select("emp", *kept(weeks), F.explode(months_of).alias("period"))
    lists = [F.array_distinct(F.array_sort(F.flatten(F.collect_list("sources")))).alias("sources")] if kept(weeks) else []
    inside = inside.groupBy("emp", "period").agg(F.count("*").alias("n"), *lists)
    alone, off = weekly.stated_only(months, stated), weekly.stated_mismatch(months, stated)
    model = F.bool_or(F.col("method").rlike("vision|llm"))
    reads = read_by.groupBy("emp", "period").agg(model.alias("by_model"), F.bool_or("needs_llm").alias("needs_llm"))
    if "source" in read_by.columns:
        reads = reads.join(days.files_of(read_by, "emp", "period"), ["emp", "period"], "left")
    nought = lambda c: F.coalesce(c, F.lit(0))
    known = weekly.with_stated(months.select("emp", "period", F.lit(0.0).alias("regular"), F.lit(0.0).alias("overtime"), "total", "days_worked"), stated)
    under = reads.where("by_model").join(known, ["emp", "period"], "left").where((nought("total") < LEAST_HOURS) & (nought("days_worked") < LEAST_DAYS))
    split = clusters
    if "source" in clusters.columns:
        # Each cluster's sources come once and in one row before clusters are counted: no window sorts the single rows.
        split = clusters.select("emp", "period", "cluster", "source").distinct().groupBy("emp", "period", "cluster").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    by_name = W.partitionBy("emp", "period")
    split = split.withColumns({"one": F.min("cluster").over(by_name), "other": F.max("cluster").over(by_name)}).where("one <> other")
    conflict = F.col("code") == "CONFLICT"
    said = F.concat(F.when(conflict, F.lit("conflicting")).otherwise(F.lit("repeated")), F.lit(" totals of the week from "), F.col("week_start").cast("string"))
    parts = [
        issue(own, "week", F.col("code"), F.when(conflict, F.lit("error")).otherwise(F.lit("info")), said, None),
        issue(inside, "month", "WEEK_ONLY", "info", F.concat(F.col("n").cast("string"), F.lit(" weekly totals, shared out to the month")), None),
        issue(alone, "month", "WEEK_ONLY", "info", F.lit("only a stated month total"), None),
        issue(off, "month", "TOTAL_MISMATCH", "warning", F.lit("the stated month total is off"), None),
        issue(under, "month", "NEEDS_LLM", "warning", F.lit("few hours read by a model or from an image"), None),
        issue(reads.where("needs_llm"), "month", "NEEDS_LLM", "warning", F.lit("a source needs another read"), None),
        issue(split, "month", "CONFLICT", "warning", F.lit("several people share a name"), None),
    ]
    return reduce(DataFrame.unionByName, parts)
