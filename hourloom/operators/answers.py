"""Extracted answers as data: lenient JSON, the answer contract, page merges, votes, usage, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions import dates, hours
from hourloom.functions.text import clean

#: The answer contract; numbers may come as texts, so all are read as strings.
CONTRACT = (
    "employee_name string, employee_id string, client string, project string, confidence string, "
    "entries array<struct<date:string,regular_hours:string,overtime_hours:string,total_hours:string,project:string>>, "
    "weekly_totals array<struct<week_start:string,week_end:string,regular_hours:string,overtime_hours:string,total_hours:string>>"
)
DEFAULT_CONFIDENCE, WEAK, EMPTY = 0.65, 0.6, 0.3


def json_part(text: Column) -> Column:
    """The JSON in an answer: the whole text, else a fenced block, else from the first brace to the last, else brackets."""
    tries = [
        F.trim(text), F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1),
        F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*\]", 0),
    ]
    return F.coalesce(*[F.when((t != "") & F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*[\[{]"), t) for t in tries])


def read_contract(answers: DataFrame) -> DataFrame:
    """answers(file, text) with a struct `answer`; null where there is no JSON object."""
    return answers.select("file", F.from_json(json_part(F.col("text")), CONTRACT).alias("answer"))


def contract_entries(answers: DataFrame, order: Column, base_year: Column) -> DataFrame:
    """file, employee_name, d, regular, overtime, total: one row an entry with a date."""
    rows = read_contract(answers).select("file", clean(F.col("answer.employee_name")).alias("employee_name"), F.inline("answer.entries"))
    parsed = dates.once(rows, dates.parse_date(F.col("date"), order, base_year).alias("d")).where("d is not null").select(
        "file", "employee_name", "d", *[hours.number_or_hours(F.col(f"{c}_hours")).alias(c) for c in ("regular", "overtime", "total")],
    )
    r, o, t = hours.split_hours(F.col("total"), F.col("regular"), F.col("overtime"))
    return parsed.select("file", "employee_name", "d", r.alias("regular"), o.alias("overtime"), t.alias("total"))


def contract_weeks(answers: DataFrame, order: Column, base_year: Column) -> DataFrame:
    """file, week_start, week_end, total; a missing bound is six days from the other."""
    rows = read_contract(answers).select("file", F.inline("answer.weekly_totals"))
    bounds = [dates.parse_date(F.col(c), order, base_year).alias(c) for c in ("week_start", "week_end")]
    rows = rows.select("file", *bounds, hours.number_or_hours(F.col("total_hours")).alias("total")).where("week_start is not null or week_end is not null")
    return rows.select(
        "file", F.coalesce("week_start", F.date_sub("week_end", 6)).alias("week_start"), F.coalesce("week_end", F.date_add("week_start", 6)).alias("week_end"),
        "total",
    )


def majority(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The most frequent non-empty value of each key, the first seen among equals."""
    counts = rows.where(F.coalesce(value, F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias(value))


def merge_pages(rows: DataFrame, key: str) -> DataFrame:
    """Per key and d, the page entry with the greatest total (null as 0), the earlier page among equals."""
    best = F.max_by(F.struct("page_seq", "total"), F.struct(F.coalesce("total", F.lit(0.0)), -F.col("page_seq")))
    return rows.groupBy(key, "d").agg(best.alias("b")).select(key, "d", "b.*")


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by model."""
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def result_measures(entries: DataFrame, key: str) -> DataFrame:
    """Worked days, hours and entries of each result."""
    return entries.groupBy(key).agg(F.count("*").alias("entries"), F.count_if(F.col("total") > 0).alias("worked"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("hours"))


def worklist(measures: DataFrame, always: bool = False) -> DataFrame:
    """Results (with confidence and needs_llm) that another read is wanted for, and whether that is a second opinion; always: the policy
    that reads everything again."""
    weak = F.lit(True) if always else F.col("needs_llm") | (F.col("confidence") < WEAK)
    odd = (F.col("worked") > 23) | (F.col("hours") > 240) | ((F.col("entries") > 0) & (F.col("hours") < 40))
    plausible = (F.col("worked") > 0) & (F.col("worked") <= 24) & (F.col("hours") <= 300)
    return measures.where(weak | odd).withColumn("escalate", weak).withColumn("second_opinion", odd).withColumn("plausible", plausible)


def choose_read(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The second read's measures only where it has more usable rows, or the first had none."""
    a, b = first.alias("a"), second.alias("b")
    take = F.col(f"b.{key}").isNotNull() & ((F.col("b.entries") > F.col("a.entries")) | (F.col("a.entries") == 0))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(
        F.col(f"a.{key}").alias(key), take.alias("second"),
        *[F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("entries", "worked", "hours")],
    )


def covers_month(worked: Column, pages: Column) -> Column:
    """Worked days reach 0.6 of what so many pages should hold."""
    expected = F.when(pages == 1, F.greatest(F.least(5 * pages, F.lit(22)), F.lit(8))).otherwise(F.least(5 * pages, F.lit(22)))
    return worked >= 0.6 * expected


def contract_results(answers: DataFrame) -> DataFrame:
    """file, employee_name, client, confidence, needs_llm of each answer: an unreadable confidence is the default, an answer without
    entries and weeks is at most weakly trusted and asks for another read."""
    size = lambda c: F.greatest(F.coalesce(F.size(f"answer.{c}"), F.lit(0)), F.lit(0))
    empty = size("entries") + size("weekly_totals") == 0
    stated = F.coalesce(F.col("answer.confidence").try_cast("double"), F.lit(DEFAULT_CONFIDENCE))
    return read_contract(answers).select(
        "file", clean(F.col("answer.employee_name")).alias("employee_name"), clean(F.col("answer.client")).alias("client"),
        F.when(empty, F.least(stated, F.lit(EMPTY))).otherwise(stated).alias("confidence"), empty.alias("needs_llm"),
    )


def larger_read(reads: DataFrame) -> DataFrame:
    """Per file of reads(file, seq, worked, hours, pages): the first read where it covers its pages, else the one with more hours (the
    earlier among equals)."""
    first = F.min_by(F.struct("seq", "worked", "hours", "pages"), "seq")
    most = F.max_by(F.struct("seq", "worked", "hours", "pages"), F.struct("hours", -F.col("seq")))
    got = reads.groupBy("file").agg(first.alias("a"), most.alias("b"))
    keep = covers_month(F.col("a.worked"), F.col("a.pages"))
    return got.select(
        "file", F.when(keep, F.col("a.seq")).otherwise(F.col("b.seq")).alias("seq"), F.when(keep, F.col("a.hours")).otherwise(F.col("b.hours")).alias("hours"),
        keep.alias("covers"),
    )


def grounding(text: Column, confidence: Column, least: float = 55.0) -> Column:
    """Text of an OCR read that may ground a model's answer; null where the read is too weak."""
    return F.when(confidence >= least, text)


def accepted_pages(reads: DataFrame) -> DataFrame:
    """One attempt a page of reads(file, page, attempt, ok, found, worked, hours): the first that read anything, else the last that gave
    an answer at all; pages without an answer go. found: entries and weeks, or 1 for a stated total."""
    read = F.min_by(F.struct("attempt", "found", "worked", "hours"), F.when(F.col("ok") & (F.col("found") > 0), F.col("attempt")))
    last = F.max_by(F.struct("attempt", "found", "worked", "hours"), F.when(F.col("ok"), F.col("attempt")))
    got = reads.groupBy("file", "page").agg(F.coalesce(read, last).alias("r"), F.max("attempt").alias("attempts"))
    return got.where("r is not null").select("file", "page", "r.*", "attempts")


def chained_reads(reads: DataFrame, stronger: DataFrame, pages: DataFrame) -> DataFrame:
    """What a file's pages give in the end, of reads and stronger (both as accepted_pages takes them) and pages(file, pages).

    In order: pages accept attempts; a file whose worked days don't cover its pages takes the stronger model's pages if these hold
    more hours; and what is then read stays only if it is plausible, else the first read stays. step: first, coverage, or implausible.
    """
    sums = lambda rows: rows.groupBy("file").agg(F.count("*").alias("read"), F.sum("worked").alias("worked"), F.round(F.sum("hours"), 2).alias("hours"))
    a, b = sums(accepted_pages(reads)), sums(accepted_pages(stronger))
    both = pages.join(a, "file", "left").join(b.select("file", *[F.col(c).alias(f"{c}_2") for c in ("read", "worked", "hours")]), "file", "left")
    nought = lambda c: F.coalesce(c, F.lit(0))
    short = ~covers_month(nought("worked"), F.col("pages"))
    more = short & (nought("hours_2") > nought("hours"))
    fine = (nought("worked_2") > 0) & (nought("worked_2") <= 24) & (nought("hours_2") <= 300)
    step = F.when(more & fine, F.lit("coverage")).when(more, F.lit("implausible")).otherwise(F.lit("first"))
    rows = both.withColumn("step", step)
    pick = lambda c: nought(F.when(F.col("step") == "coverage", F.col(f"{c}_2")).otherwise(F.col(c))).alias(c)
    return rows.select("file", "step", pick("read"), pick("worked"), pick("hours"))
