"""Unit cases of the scalar rules and of each layout."""

import datetime as dt
import os
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hourloom import plans
from hourloom.functions import dates, hours, text
from hourloom.operators import calendar, days, files, grids, identity, lines, ocr, weekly

D = dt.date


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [("7.97", 7.97), ("8", 8), ("8 00", 8), ("8:30", 8.5), ("121 00", 121), ("7,5", 7.5), ("8.50", 8.5), ("12.30", 12.3), ("$8", 8), ("8 hrs", 8), ("", None), (None, None), ("N/A", None), ("off", None), ("00:00:00", None), ("8d", None), ("-3", None), ("inf", None), ("nan", None)],
)
def test_parse_hours(spark, value, want):
    got = one(spark, value, hours.parse_hours)
    assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(
    ("a", "b", "lunch", "want"),
    [("22:00", "06:00", 0.0, 8), ("23:30", "07:30", 0.0, 8), ("09:00", "05:00", 0.0, 8), ("7:30 AM", "4:30 PM", 60.0, 8), ("0:00", "0:00", 0.0, 0), (None, "5:00", 0.0, None), ("25:00", "5:00", 0.0, None)],
)
def test_hours_between(spark, a, b, lunch, want):
    row = spark.createDataFrame([(a, b, lunch)], "a string, b string, l double").select(hours.hours_between(hours.parse_clock(F.col("a")), hours.parse_clock(F.col("b")), F.col("l"))).first()
    assert row[0] == want


@pytest.mark.parametrize(("t", "r", "o", "want"), [(None, 8.0, None, (8, 0, 8)), (10.0, 8.0, None, (8, 2, 10)), (8.0, None, None, (8, 0, 8)), (None, None, None, (None,) * 3), (None, None, 2.0, (None, 2, None))])
def test_split_hours(spark, t, r, o, want):
    rows = spark.createDataFrame([(t, r, o)], "t double, r double, o double")
    assert tuple(rows.select(*hours.split_hours(F.col("t"), F.col("r"), F.col("o"))).first()) == want


@pytest.mark.parametrize(
    ("value", "order", "want"),
    [("01/04/2026", "DMY", D(2026, 4, 1)), ("4/16/2026", "MDY", D(2026, 4, 16)), ("4/30/26", "MDY", D(2026, 4, 30)), ("1-Apr-26", "MDY", D(2026, 4, 1)), ("30-Mar-2026", "MDY", D(2026, 3, 30)), ("2026-04-09", "DMY", D(2026, 4, 9)), ("April 3, 2026", "MDY", D(2026, 4, 3)), ("13/04/2026", "MDY", D(2026, 4, 13)), ("2026-13-40", "MDY", None), ("junk", "MDY", None), (" ", "MDY", None), (None, "MDY", None)],
)
def test_parse_date(spark, value, order, want):
    assert one(spark, value, lambda c: dates.parse_date(c, F.lit(order), F.lit(2026))) == want


@pytest.mark.parametrize(
    ("value", "want"), [("1:05", 3900), ("12 30 AM", 1800), (" 1.05.09p.m. ", 47109), ("12:00 pm", 43200), ("24:00", None), ("7", None), ("1:5", None), ("off", None), (None, None)],
)
def test_parse_clock(spark, value, want):
    assert one(spark, value, hours.parse_clock) == want


def test_dates_and_clock_times_are_read_without_failing_casts(spark):
    """Casts that fail raise and catch an exception a cell."""
    texts = spark.createDataFrame([("1/2/1997",)], "t string")
    plan = texts.select(hours.parse_clock(F.col("t")), dates.parse_date(F.col("t"), F.lit("MDY"), F.lit(1997)))._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast" not in plan.lower()


def test_week_overlap(spark):
    rows = spark.createDataFrame([(D(2026, 4, 26), D(2026, 5, 2)), (D(2026, 5, 4), D(2026, 5, 10)), (D(2026, 5, 2), D(2026, 4, 26))], "a date, b date")
    got = [r[0] for r in rows.select(dates.week_overlap(F.col("a"), F.col("b"), F.lit(D(2026, 4, 1)))).collect()]
    assert got == [pytest.approx(5 / 7), 0, pytest.approx(5 / 7)]


def test_date_orders(spark):
    rows = spark.createDataFrame([("a", "13/04/2026"), ("b", "04/13/2026"), ("c", "01/04 01/04/2026 02/04/2026"), ("d", "04/01/2026 04/02/2026")], "file string, text string")
    got = {r.file: r.date_order for r in lines.date_orders(rows, F.lit(D(2026, 4, 1))).collect()}
    assert got == {"a": "DMY", "b": "MDY", "c": "DMY", "d": "MDY"}


def test_calendar(spark):
    years = spark.createDataFrame([(2026,), (2026,)], "year int")
    holidays = calendar.us_holidays(years)
    assert {r.date for r in holidays.collect()} >= {D(2026, 7, 4), D(2026, 1, 1), D(2026, 11, 26), D(2026, 5, 25)} and holidays.count() == 11
    april = calendar.calendar_days(spark.createDataFrame([(D(2026, 4, 1),)], "period date"), holidays)
    assert april.count() == 30 and april.where("date = '2026-04-04'").first().is_weekend


ENTRY = "emp long, seq long, extractor string, trust double, d date, regular double, overtime double, total double"


def test_trust_wins_and_conflicts(spark):
    rows = spark.createDataFrame([(1, 1, "image", 1.2, D(2026, 4, 1), None, None, 5.0), (1, 2, "daily_grid", 3.0, D(2026, 4, 1), None, None, 8.0), (2, 1, "csv", 3.0, D(2026, 4, 1), None, None, 8.0), (2, 2, "csv", 3.0, D(2026, 4, 1), None, None, 8.0), (3, 1, "csv", 3.0, D(2026, 4, 1), None, None, None)], ENTRY)
    found = days.resolve_days(rows)
    assert {(r.emp, r.total, r.n) for r in found.collect()} == {(1, 8.0, 2), (2, 8.0, 2)}
    assert {(r.emp, r.code) for r in days.duplicates(found).collect()} == {(1, "CONFLICT"), (2, "DUPLICATE")}
    assert days.resolve_days(rows.limit(0)).count() == 0


WEEK = "emp long, week_start date, week_end date, total double, seq long"


def test_weeks_are_counted_once(spark):
    none = spark.createDataFrame([], "emp long, d date, total double")
    twice = spark.createDataFrame([(1, D(2026, 4, 6), D(2026, 4, 12), 40.0, 1), (1, D(2026, 4, 13), D(2026, 4, 19), 40.0, 2), (1, D(2026, 4, 6), D(2026, 4, 12), 40.0, 3), (1, D(2026, 4, 13), D(2026, 4, 19), 40.0, 4)], WEEK)
    weeks = weekly.dedupe(twice)
    assert {r.code for r in weeks.collect()} == {"DUPLICATE"}
    assert [r.total for r in weekly.rollup(weeks, none).collect()] == [80.0]
    edge = weekly.dedupe(spark.createDataFrame([(1, D(2026, 4, 26), D(2026, 5, 2), 35.0, 1)], WEEK))
    got = {r.period: (r.total, r.days_worked) for r in weekly.rollup(edge, none).collect()}
    assert got == {D(2026, 4, 1): (25.0, 3), D(2026, 5, 1): (10.0, 1)}
    half = weekly.dedupe(spark.createDataFrame([(1, D(2026, 4, 6), D(2026, 4, 12), 20.0, 1), (2, D(2026, 4, 12), D(2026, 4, 6), 9.0, 1)], WEEK))
    assert [(r.emp, r.days_worked) for r in weekly.rollup(half, none).collect()] == [(1, 2)]


def test_null_week_owns_its_days(spark):
    weeks = weekly.dedupe(spark.createDataFrame([(1, D(2026, 4, 6), D(2026, 4, 12), None, 1), (1, D(2026, 4, 7), D(2026, 4, 13), 14.0, 2)], WEEK))
    daily = spark.createDataFrame([(1, D(2026, 4, 13), 0.0)], "emp long, d date, total double")
    assert [r.total for r in weekly.rollup(weeks, daily).collect()] == [0.0]


CELL = "table_id long, row_id long, col int, value string"


def grid(rows):
    return [(1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]


def test_roles_leave_overtime_alone(spark):
    head = ["Day", "Date", "Time In", "Time Out", "Number of Regular Hours", "Number of Overtime Hours", "Notes"]
    got = {r.role: r.col for r in grids.assign_roles(spark.createDataFrame(grid([head]), CELL)).collect()}
    assert got == {"date": 1, "in": 2, "out": 3, "regular": 4, "overtime": 5, "note": 6}


def test_daily_grid(spark):
    rows = [["Sheet of P. Example"], ["Date", "Time In", "Time Out", "Regular Hours"], ["4/1/2026", "", "", "8"], ["4/2/2026", "", "", "8"], ["4/4/2026", "", "", ""], ["4/6/2026", "10:00", "14:00", ""], ["4/7/2026", "", "", "?"], ["4/8/2026", "", "", "20"]]
    found = grids.daily_grid(grids.role_columns(spark.createDataFrame(grid(rows), CELL)), F.lit("MDY"), F.lit(2026))
    assert {(r.d.day, r.total, r.issue) for r in found.collect()} == {(1, 8.0, None), (2, 8.0, None), (6, 4.0, None), (7, None, "UNCLEAR"), (8, 20.0, "OUT_OF_RANGE")}


def test_weekly_grid(spark):
    rows = [["Week Start", "Week End", "Total Hours"], ["4/12/2026", "4/18/2026", "39"], ["4/26/2026", "", "32"], ["", "", "71"]]
    found = grids.weekly_totals(grids.role_columns(spark.createDataFrame(grid(rows), CELL)), F.lit("MDY"), F.lit(2026))
    assert {(r.week_start, r.week_end, r.total) for r in found.collect()} == {(D(2026, 4, 12), D(2026, 4, 18), 39.0), (D(2026, 4, 26), D(2026, 5, 2), 32.0)}


def test_labelled_hours(spark):
    text_ = ["Period 4/1/2026", "4/1/2026", "8.00 Hours", "4/1/2026", "8.00 hours", "4/2/2026 4.00 Regular", "4/2/2026 8 regular", "4/3/2026", "no", "no", "no", "5 hours"]
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(text_)], "file string, line_no int, line string")
    got = lines.labelled_hours(rows, spark.createDataFrame([("f", "MDY")], "file string, date_order string"), F.lit(2026))
    assert {(r.date.day, r.total, r.unclear) for r in got.collect()} == {(1, 8.0, False), (2, None, True)}


def test_split_without_a_conflicting_pair(spark):
    rows = [(1, 1, D(2026, 4, 1), 8.0), (1, 2, D(2026, 4, 2), 8.0), (1, 3, D(2026, 4, 1), 4.0), (1, 3, D(2026, 4, 2), 4.0), (2, 1, D(2026, 4, 1), 8.0), (2, 2, D(2026, 4, 1), 4.0)]
    table = spark.createDataFrame(rows, "ident long, file_seq long, d date, total double")
    assert identity.conflict_pairs(table).count() == 0
    assert {tuple(r) for r in identity.split_conflicting(table).collect()} == {(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 0)}


def test_names_paths_and_kinds(spark):
    assert one(spark, "Acme TS April -2026/x.csv", text.client_from_path) == "Acme"
    assert one(spark, "x.csv", text.client_from_path) is None
    assert one(spark, "Richard TS-April 2026", text.name_hint) == "Richard"
    assert one(spark, "Company_May_timesheet_2026", text.name_hint) == "Company"
    assert one(spark, "Acme_Time Sheet_Jo_Ann May-2026", lambda c: text.name_hint(c, ("acme",))) == "Jo Ann"
    assert one(spark, "May_timesheet_2026", text.name_hint) == "May timesheet 2026"
    assert one(spark, "a/~$b.xlsx", files.is_document) is False and one(spark, "a/b.xlsx", files.is_document) is True
    assert one(spark, "P. Example", lambda c: days.ident_key(c, F.lit(None).cast("string"))) == "nm:p example"
    assert one(spark, "<p>a &amp; b</p><script>x</script>", text.html_to_text) == "a & b"


def test_box_rows(spark):
    rows = [(1, 1, 5.0, 10.0, 10.0, "a", 0.9), (1, 2, 1.0, 12.0, 10.0, "b", 0.7), (1, 3, 1.0, 30.0, 10.0, "c", 0.5)]
    got = ocr.box_rows(spark.createDataFrame(rows, "file long, seq long, x double, y double, h double, text string, score double"))
    assert {(r.row_no, r.text, r.confidence) for r in got.collect()} == {(0, "b  a", 80.0), (1, "c", 50.0)}


def test_pages_are_split_without_joining_a_file(spark):
    long = "word " * 20
    rows = [("f", 1, long), ("f", 2, "short"), ("f", 3, f"{long}\n--- page 9 ---\n{long}x"), ("f", 4, None), ("f", 5, long + "\n---"), ("f", 6, "page 7 --- " + long), ("g", 1, "")]
    pages = spark.createDataFrame(rows, "file string, page long, text string")
    got = files.split_marked(pages)
    assert sorted((r.file, r.text) for r in got.collect()) == sorted((r.file, r.text) for r in files.split_pages(files.join_pages(pages)).collect())
    plan = plans.queries()["page_split"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_conflicting_files_stream(spark):
    table = spark.createDataFrame([(i, f, D(2024, 1, d), float((f % 3) * 4)) for i in (1, 2, 3) for f in range(60) for d in (1, 2, 3)], "ident long, file_seq long, d date, total double")
    got = identity.split_conflicting(table)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(i, f, f % 3) for i in (1, 2, 3) for f in range(60)}


def test_dates_stand_between_word_boundaries(spark):
    tokens = lambda t: one(spark, t, dates.date_tokens)
    assert tokens("12345/4/2026 x1/2/2026 4/5/2026y") == [] and tokens("on 4/5/2026, 1.2.26") == ["4/5/2026", "1.2.26"]
    read = lambda t: one(spark, t, lambda c: dates.parse_date(c, F.lit("MDY"), F.lit(2026)))
    assert read("12345/4/2026") is None and read("version 1.2.3.4.5x") == D(2003, 1, 2) and read("13/04/2026") == D(2026, 4, 13)
    assert read("31-Feb-26") is None and read("Sept 5, 2026") is None and read("2026-02-30") is None and read("29.2.2024") == D(2024, 2, 29)


def test_order_votes_count_months_of_any_year(spark):
    lines_ = spark.createDataFrame([("a", "1/4/2019"), ("a", "2/4/2020"), ("b", "4/1/2019"), ("c", "5/6/2020")], "file string, text string")
    got = {r.file: r.date_order for r in lines.date_orders(lines_, F.lit("2026-04-01").cast("date")).collect()}
    assert got == {"a": "DMY", "b": "MDY", "c": "MDY"}


def test_delimited_files(spark, tmp_path):
    from hourloom.sources import delimited

    (tmp_path / "a.csv").write_text('Date,"Hours, total",Note\n1/2/2026,8,"two\nlines ""q"""\n1/3/2026,,NULL\n')
    (tmp_path / "b.tsv").write_text("x\ty,z\n")
    got = {(r.file[-5:], r.row_id, r.col): r.value for r in delimited.read_delimited(spark, str(tmp_path)).collect()}
    assert got[("a.csv", 0, 1)] == "Hours, total" and got[("a.csv", 1, 2)] == 'two\nlines "q"' and got[("a.csv", 2, 2)] == "NULL" and ("a.csv", 2, 1) not in got
    assert got[("b.tsv", 0, 1)] == "y,z" and not any(f == "b.tsv" and c > 1 for f, _, c in got)


def random_table(rng, rows, wide):
    value = lambda: rng.choice(["", "8", "a b", "x,y", 'say "hi"', "two\nlines", "\n\n", '"', ",", 'a""b', "é", "end\n", 'mid"dle'])
    table = [[value() for _ in range(rng.choice([1, 3, wide]))] for _ in range(rows)]
    return [r for r in table if r != [""]]


@pytest.mark.parametrize("size", ["40", "173", "100000"])
def test_ranges_of_delimited_files_fit_together(spark, tmp_path, size):
    """Rows are those of the standard library's reader, wherever a file is cut into ranges."""
    import csv
    import random

    from hourloom.sources import delimited

    rng, want = random.Random(7), {}
    for k in range(6):
        table = random_table(rng, 60, 70)
        with open(tmp_path / f"f{k}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"]) if k else "\n").writerows(table)
        want |= {(f"f{k}", i, c): v for i, row in enumerate(table) for c, v in enumerate(row) if v != ""}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        cells = delimited.read_delimited(spark, str(tmp_path))
        got = {(r.file[-6:-4], r.row_id, r.col): r.value for r in cells.collect()}
        assert size != "40" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and max(c for *_, c in got) == 69


@pytest.mark.parametrize("size", ["40", "173", "100000"])
def test_blocks_of_ranges_fit_together(spark, tmp_path, size, monkeypatch):
    from hourloom.sources import delimited

    monkeypatch.setattr(delimited, "BLOCK_LINES", 3)
    test_ranges_of_delimited_files_fit_together(spark, tmp_path, size)


def test_quotes_open_cells_at_their_begin_only(spark, tmp_path):
    from hourloom.sources import delimited

    (tmp_path / "a.csv").write_text('5" pipe,2\n"a"b,"c\nd"\n\n"open')
    got = {(r.row_id, r.col): r.value for r in delimited.read_delimited(spark, str(tmp_path)).collect()}
    assert got[0, 0] == '5" pipe' and got[1, 0] == "ab" and got[1, 1] == "c\nd" and 2 in {r for r, _ in got}


def test_tables_in_texts(spark):
    import csv
    import io
    import random

    from hourloom.sources import delimited

    rng, texts, want = random.Random(3), [(100, None), (101, ""), (102, "\n")], {}
    for k in range(30):
        out, table = io.StringIO(), random_table(rng, 8, 5)
        csv.writer(out, lineterminator="\n").writerows(table)
        texts.append((k, out.getvalue()))
        want |= {(k, i, c): v for i, row in enumerate(table) for c, v in enumerate(row) if v != ""}
    got = {(r.file, r.row_id, r.col): r.value for r in delimited.text_cells(spark.createDataFrame(texts, "file long, text string")).collect()}
    assert got == want


def test_dump_of_a_delimited_file(spark):
    from hourloom.sources import delimited

    cells = spark.createDataFrame([("f", 0, 0, "a"), ("f", 0, 2, "c"), ("f", 1, 1, "x"), ("f", 201, 0, "late"), ("f", 200, 0, "last")], "file string, row_id long, col int, value string")
    assert {r.row_id: r.line for r in delimited.dump(cells).collect()} == {0: "a |  | c", 1: "[r2]  | x | ", 200: "[r201] last |  | "}


def mail(*parts, kind="mixed"):
    from email.message import EmailMessage

    message = EmailMessage()
    message["Subject"], message["From"], message["Date"] = "hours", "p@example.com", "Mon, 3 Feb 1997 10:00:00 +0000"
    message.set_content(parts[0])
    for part in parts[1:]:
        part(message)
    return message.as_bytes()


def test_mail_trees(spark):
    from hourloom.functions.text import html_to_text
    from hourloom.sources import reports

    inner = email_of("inner body")
    table = lambda m: m.add_attachment(b'Date,Hours\r\n1/2/2026,"8\n"\r\n', maintype="application", subtype="octet-stream", filename="T.CSV")
    notes = lambda m: m.add_attachment("plain notes", filename="n.txt")
    html = lambda m: m.add_alternative("<b>bold</b>", subtype="html")
    nested = lambda m: m.add_attachment(inner)
    files = [("a", mail("text body", html, table, nested)), ("b", mail("x", notes)), ("c", b""), ("d", None), ("e", b"Subject: only\n\nbody")]
    parts = reports.mail_parts(spark.createDataFrame(files, "file string, content binary")).cache()
    rows = {(r.file, r.part): (r.ctype, r.content) for r in parts.collect()}
    assert [p for f, p in sorted(rows) if f == "a"] == ["00.00", "00.01", "01", "02"] and rows["a", "02"] == ("message/rfc822", None)
    bodies = {r.file: (r.body, r.attachments) for r in reports.mail_bodies(parts, html_to_text).collect()}
    assert bodies["a"] == ("text body\n", 1) and bodies["b"] == ("x\n", 1) and bodies["e"] == ("body", 0) and bodies["c"][1] == bodies["d"][1] == 0
    cells = {(r.file, r.row_id, r.col): r.value for r in reports.attached_cells(parts).collect()}
    assert cells == {("a", 0, 0): "Date", ("a", 0, 1): "Hours", ("a", 1, 0): "1/2/2026", ("a", 1, 1): "8\n"}
    lines = {(r.file, r.line_no): r.line for r in reports.mail_lines(reports.mail_bodies(parts, html_to_text)).collect()}
    assert lines["a", 0] == "Subject: hours" and lines["a", 3] == "text body"


def email_of(text):
    from email.message import EmailMessage

    message = EmailMessage()
    message["Subject"] = "inner"
    message.set_content(text)
    return message


def test_mails_go_to_python_in_small_batches(spark, monkeypatch):
    from hourloom.sources import reports

    sizes, parse = [], type(spark.range(1)).mapInPandas
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda df, f, schema: (sizes.append(df), parse(df, f, schema))[1])
    files = spark.range(2000, numPartitions=1).selectExpr("CAST(id AS STRING) AS file", "CAST('Subject: x\n\nbody' AS BINARY) AS content")
    assert reports.mail_parts(files).count() == 2000
    held = parse(sizes[0], lambda batches: (b.assign(n=len(b))[["n"]].head(1) for b in batches), "n long")
    assert max(r.n for r in held.collect()) <= int(reports.BATCH_MAILS)


def test_equal_headers_of_mails_are_parsed_once(spark):
    from hourloom.sources import reports

    def ask():
        message = reports.read_mail(mail("a body", lambda m: m.add_attachment(email_of("inner"))))
        return [(p.get_content_type(), p.get_filename(), p.get_content_disposition()) for p in message.walk()], message.get("subject")

    first, parsed = ask(), reports.mail_policy().header_factory.cache_info().misses
    # Only the boundary that a mail is written with differs.
    assert all(ask() == first for _ in range(20)) and reports.mail_policy().header_factory.cache_info().misses <= parsed + 20


def test_upload_batches_rewrite_their_months_only(spark, tmp_path):
    from hourloom.streaming import uploads

    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "user_id long, year int, month int, id long, status string"
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    add([(1, 2026, 1, 1, "a"), (2, 2026, 2, 2, "b")])
    run = lambda: uploads.run_upserts(spark.readStream.schema(schema).parquet(source), target, state, ["user_id", "year", "month"], ["id"])
    run()
    add([(1, 2026, 1, 9, "c"), (3, 2026, 1, 4, "d")])
    run()
    got = {(r.user_id, r.year, r.month): r.status for r in uploads.read_latest(spark, target).collect()}
    assert got == {(1, 2026, 1): "c", (2, 2026, 2): "b", (3, 2026, 1): "d"}
    stored = lambda: sorted({(r.batch, r.month) for r in spark.read.parquet(f"{target}/data").select("batch", "month").collect()})
    assert stored() == [(0, 1), (0, 2), (1, 1)]
    add([(2, 2026, 2, 8, "e")])
    run()
    # What the first batch wrote of January is current of no manifest that a replay reads.
    assert stored() == [(0, 2), (1, 1), (2, 2)] and uploads.manifests(spark, target) == [1, 2]
    assert {(r.user_id, r.month): r.status for r in uploads.read_latest(spark, target).collect()} == {(1, 1): "c", (2, 2): "e", (3, 1): "d"}
    # A batch that failed before its manifest stood is run again and gives the same.
    shutil.rmtree(f"{target}/manifest/{2:012d}")
    assert {r.status for r in uploads.read_latest(spark, target).where("month = 2").collect()} == {"b"}
    forget(state, 2)
    run()
    assert {(r.user_id, r.month): r.status for r in uploads.read_latest(spark, target).collect()} == {(1, 1): "c", (2, 2): "e", (3, 1): "d"}
    # One whose manifest stood but wasn't committed too.
    forget(state, 2)
    run()
    assert stored() == [(0, 2), (1, 1), (2, 2)] and len(uploads.read_latest(spark, target).collect()) == 3


def forget(state, number):
    """As if a batch had failed before it was committed."""
    for name in (f"{number}", f".{number}.crc"):
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")


def brute_first_fit(days):
    """{(ident, file_seq): cluster} of {(ident, file_seq): {d: total}}: each in the first cluster that differs on fewer than two dates."""
    out, clusters = {}, {}
    for ident, file_seq in sorted(days):
        mine, own = days[ident, file_seq], clusters.setdefault(ident, [])
        k = next((k for k, seen in enumerate(own) if sum(abs(seen[d] - t) > 0.5 for d, t in mine.items() if d in seen) < 2), len(own))
        if k == len(own):
            own.append({})
        own[k] = mine | own[k]
        out[ident, file_seq] = k
    return out


def test_copies_of_results_are_compared_once(spark, tmp_path):
    """Pairs against brute force, with copies, totals that aren't finite and missing names; copies don't multiply what is compared."""
    import random

    rng, day, inf = random.Random(3), dt.date(2026, 1, 1), float("inf")
    kinds = [{rng.randrange(8): rng.choice([0.0, 0.4, 8.0, 4.0]) for _ in range(5)} for _ in range(6)] + [{0: inf, 1: float("nan"), 2: 1.0}]
    results = [(rng.choice([1, 2, None]), k, rng.choice(kinds)) for k in range(60)]
    rows = [(i, k, day + dt.timedelta(d), t) for i, k, own in results for d, t in own.items()]
    days = spark.createDataFrame(rows, "ident long, file_seq long, d date, total double")
    want = set()
    for i, a, x in results:
        for j, b, y in results:
            dates = sum(not abs(x[d] - y[d]) <= 0.5 for d in x.keys() & y.keys())
            if i == j and i is not None and a < b and dates >= 2:
                want.add((i, a, b, dates))
    got = list(map(tuple, identity.conflict_pairs(days).collect()))
    assert set(got) == want and len(got) == len(want)
    odd = [k for i, k, own in results if i is not None and own is kinds[-1]]
    compared = identity.result_classes(days).where("days is not null")
    assert compared.count() == len(odd) + len({(i, str(sorted(own.items()))) for i, k, own in results if i is not None and own is not kinds[-1]})


def test_pairs_of_large_classes_come_from_several_tasks(spark, monkeypatch):
    """Two classes of 60 results contradict one another: few bytes become 3,600 pairs, which no single task expands; nor does one compare all blocks."""
    monkeypatch.setattr(identity, "MEMBERS", 8, raising=False)
    monkeypatch.setattr(identity, "BLOCK", 4, raising=False)
    day, two = dt.date(2026, 1, 1), lambda k, t: [(1, k, day + dt.timedelta(d), t) for d in range(2)]
    rows = [r for k in range(120) for r in two(k, 8.0 if k % 2 else 4.0)] + [(1, 200 + k, day + dt.timedelta(d), 8.0 + d * k) for k in range(1, 20) for d in range(3)]
    days = spark.createDataFrame(rows, "ident long, file_seq long, d date, total double")
    got = identity.conflict_pairs(days).withColumn("task", F.spark_partition_id()).collect()
    own: dict = {}
    for _, k, d, t in rows:
        own.setdefault(k, {})[d] = t
    differ = lambda a, b: sum(abs(own[a][d] - own[b][d]) > 0.5 for d in own[a].keys() & own[b].keys())
    want = sorted((1, a, b, differ(a, b)) for a in own for b in own if a < b and differ(a, b) >= 2)
    assert sorted((r.ident, r.a, r.b, r.dates) for r in got) == want
    assert len({r.task for r in got}) > 1 and max(Counter(r.task for r in got).values()) < 0.6 * len(got)


@pytest.mark.parametrize("seed", range(4))
def test_split_by_parts_is_first_fit_over_the_whole(spark, seed):
    import datetime as dt
    import random

    from hourloom.operators import identity

    rng, days = random.Random(seed), {}
    for ident in range(5):
        for file_seq in range(rng.choice([1, 12, 40])):
            dates = rng.sample(range(rng.choice([6, 60])), 5)
            days[ident, file_seq] = {dt.date(2026, 1, 1) + dt.timedelta(d): rng.choice([8.0, 8.0, 8.0, 8.3, 4.0, 9.0]) if ident else 8.0 for d in dates}
    rows = [(i, f, d, t) for (i, f), own in days.items() for d, t in own.items()]
    table = spark.createDataFrame(rows, "ident long, file_seq long, d date, total double").repartition(5)
    got = {(r.ident, r.file_seq): r.cluster for r in identity.split_conflicting(table).collect()}
    assert got == brute_first_fit(days) and len(set(got.values())) > 1


def test_grids_read_cells_twice_at_most(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0, "Date"), (1, 0, 1, "Hours"), (1, 1, 0, "1/2/2026"), (1, 1, 1, "8")], "table_id long, row_id long, col int, value string").write.parquet(str(tmp_path / "c"))
    got = grids.daily_grid(grids.role_columns(spark.read.parquet(str(tmp_path / "c"))), F.lit("MDY"), F.lit(2026))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2 and len(plan) < 60_000 and got.first().total == 8.0


@pytest.mark.parametrize(("name", "width"), [("people", "24"), ("consolidated_months", "3"), ("consolidated_months", "24"), ("consolidated_issues", "9")])
def test_consolidation_reads_small_tables(spark, name, width):
    """Cells are parsed once, whatever the number of partitions: what is left of a plan reads few staged tables."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        got = plans.queries()[name](spark, "/root/testdata/sf0.001")
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        most = 40 if name == "consolidated_issues" else 12
        assert plan.count("Relation") <= most and len(plan) < 50_000 and got.count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_staged_tables_go_with_their_scope(spark):
    from hourloom.sources.staged import scratch, staged

    with scratch(spark):
        kept = staged(spark.range(3).toDF("k"), "x")
        path = kept.inputFiles()[0]
        assert kept.count() == 3 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_odd_days_are_findings_with_their_sources(spark):
    """Negative values, and regular and overtime that are not the total, name the entries they come from."""
    from hourloom.operators import calendar as cal

    rows = [(1, D(2026, 3, 2), 1, "csv", 3.0, -1.0, 0.0, -1.0), (1, D(2026, 3, 3), 2, "csv", 3.0, 8.0, 1.0, 12.0), (1, D(2026, 3, 3), 3, "image", 1.2, 8.0, 0.0, 8.0)]
    entries = spark.createDataFrame(rows, "emp long, d date, seq long, extractor string, trust double, regular double, overtime double, total double")
    entries = entries.withColumn("source", days.source(F.concat(F.lit("f"), F.col("seq").cast("string")), F.col("extractor"), row=F.col("seq"), region=F.lit("left")))
    resolved = days.resolve_days(entries)
    grid = cal.calendar_days(entries.select(F.trunc("d", "MM").alias("period")), cal.us_holidays(entries.select(F.year("d").alias("year"))))
    got = days.day_issues(entries, resolved, grid).withColumn("sources", days.labels(F.col("sources"))).where("code <> 'MISSING'").collect()
    seen = {(r.date.day, r.code, r.severity, r.message): r.sources for r in got}
    assert seen[2, "INVALID", "error", "negative regular"] == seen[2, "INVALID", "error", "negative total"] == "f1 · row1 · @left"
    assert seen[3, "TOTAL_MISMATCH", "warning", "regular and overtime are not the total"] == seen[3, "CONFLICT", "error", "several sources"] == "f2 · row2 · @left; f3 · row3 · @left"
    missing = days.day_issues(entries, resolved, grid).where("code = 'MISSING'").withColumn("sources", days.labels(F.col("sources"))).collect()
    assert {r.sources for r in missing} == {"f1; f2; f3"}


def test_months_of_stated_totals_alone(spark):
    """A stated total is the month of a person without other data, and a read by a model that yields nothing is a finding."""
    from hourloom.operators import consolidate

    period = D(2026, 3, 1)
    months = spark.createDataFrame([(1, period, 100.0, 0.0, 100.0, 12)], "emp long, period date, regular double, overtime double, total double, days_worked long")
    stated = spark.createDataFrame([(1, period, 100.2), (2, period, 20.0), (3, period, 168.0)], "emp long, period date, stated double")
    got = {r.emp: (r.regular, r.overtime, r.total, r.days_worked) for r in weekly.with_stated(months, stated).collect()}
    assert got == {1: (100.0, 0.0, 100.0, 12), 2: (20.0, 0.0, 20.0, 2), 3: (168.0, 0.0, 168.0, 21)}
    weeks = spark.createDataFrame([], "emp long, week_start date, week_end date, total double, code string")
    reads = spark.createDataFrame([(k, period, "llm_vision:x", False) for k in (1, 2, 3, 4)] + [(5, period, "csv", False)], "emp long, period date, method string, needs_llm boolean")
    nobody = spark.createDataFrame([], "emp long, period date, cluster long")
    found = consolidate.month_issues(weeks, months, stated, reads, nobody).collect()
    # 20 hours in 2 days and no hours at all are little; 100 hours and a stated 168 are not.
    assert {r.emp for r in found if r.code == "NEEDS_LLM"} == {2, 4} and {r.emp for r in found if r.code == "WEEK_ONLY"} == {2, 3}


def test_cells_are_brought_together_by_row_once(spark):
    cells = spark.createDataFrame([(1, -1, 0, "Date"), (1, -1, 1, "Hours"), (1, 5, 0, "2024-03-01"), (1, 5, 1, "8")], "table_id long, row_id long, col int, value string")
    plan = grids.role_columns(cells)._jdf.queryExecution().optimizedPlan().toString()
    wholes = re.findall(r"collect_list\((?:named_)?struct\(col, col#[0-9]+, value, value#", plan)
    assert len(wholes) == 1 and plan.count("collect_list(") == 2  # whole rows, and the cells that look like a header's


def test_headers_of_few_likely_cells(spark):
    texts = ["  IN", "out ", "o.t x", "time in", "pto", "priority", "not specified", "cabin", "Lunch Out", "week beginning 3", "in\n", "x ot", "b/reg. y", "# OF HOURS", "İn", None, ""]
    rows = [(k, 0, 0, t) for k, t in enumerate(texts)]
    for k in range(30):
        rows += [(100, k, 0, "Date" if k == 14 else "x"), (101, k, 0, "Date" if k == 15 else "x"), (102, k * 7, 2, "Date" if k in (3, 20) else "4")]
    cells = spark.createDataFrame(rows, "table_id long, row_id long, col int, value string")
    fits = lambda t: any(t == w or t.startswith(w + " ") or t.endswith(" " + w) if len(w) <= 3 else w in t for own in grids.ROLE_KEYWORDS.values() for w in own)
    want = {k for k, t in enumerate(texts) if t and fits(t.strip(" ").lower())}
    for given in (cells, grids.grid_rows(cells)):
        got = {r.table_id: r.header_row for r in grids.header_rows(given).collect()}
        assert {k for k in got if k < 100} == want and len(want) > 8
        assert got[100] == 14 and 101 not in got and got[102] == 21


def test_full_dates_and_plain_numbers(spark):
    said = ["2024-02-29", "2023-02-29", "0000-01-01", "0001-01-01", "9999-12-31", "2024-13-01", " 2024-02-29", "2024-02-29\n", "2024-2-9", "2024-02-29 x", "٢٠٢٤-01-01", None]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, t string")
    got = [str(r.d) for r in rows.select("k", dates.parse_date(F.col("t"), F.lit("MDY"), F.lit(2000)).alias("d")).orderBy("k").collect()]
    assert got == ["2024-02-29", "None", "None", "0001-01-01", "9999-12-31", "None", "2024-02-29", "2024-02-29", "2024-02-09", "2024-02-29", "None", "None"]
    said = ["8", "8.25", "8.", ".5", "007.50", "8.5\n", "1e1", "8,5", " 8.5 hrs", "-1", "", None, "1.2.3", "٨"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, t string")
    got = [r.h for r in rows.select("k", hours.parse_hours(F.col("t")).alias("h")).orderBy("k").collect()]
    assert got == [8.0, 8.25, 8.0, 0.5, 7.5, 8.5, 10.0, 8.5, 8.5, None, None, None, None, None]


def test_matrices_need_no_rows(spark):
    names = list(enumerate(["Job", "Mon", "tue", "Wed", "Thursday", "fri"]))
    rows = [(1, 0, k, n) for k, n in names] + [(1, 1, 1, "8"), (1, 2, 1, "1:30"), (1, 2, 0, "7"), (1, 2, 5, "off"), (2, 0, 0, "Mon"), (2, 1, 0, "8")]
    cells = spark.createDataFrame(rows, "table_id long, row_id long, col int, value string")
    anchors = spark.createDataFrame([(1, dt.date(2024, 3, 4), 0), (2, dt.date(2024, 3, 4), 0)], "table_id long, anchor date, header_row long")
    for given in (cells, grids.grid_rows(cells)):
        assert [tuple(r) for r in grids.weekday_matrix(given, anchors).collect()] == [(1, dt.date(2024, 3, 4), 9.5)]
    plan = grids.weekday_matrix(cells, anchors)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"collect_list\((?:named_)?struct\(", plan)


def test_tables_of_two_rows_need_no_distinct_ids(spark):
    rows = [(1, 5, 0, " a"), (1, 5, 1, "b"), (2, 7, 0, "c "), (2, 9, 0, "d"), (2, 9, 1, "e"), (3, 1, 0, "f"), (3, 2, 0, "g"), (3, 3, 0, "h")]
    cells = spark.createDataFrame(rows, "table_id long, row_id long, col int, value string")
    got = grids.clean_tables(cells)
    assert sorted(map(tuple, got.where("table_id = 2").collect())) == [(2, 7, 0, "c", True), (2, 9, 0, "d", False), (2, 9, 1, "e", False)]
    assert {r.table_id for r in got.collect()} == {2, 3} and {r.table_id for r in grids.clean_tables(cells, 3).collect()} == {3}
    assert "distinct" not in got._jdf.queryExecution().analyzed().toString().lower()


def test_only_dates_that_may_vote_are_cut(spark):
    texts = ["1997-03-05", "13/2/1997", "0031.1.97", "no", "x 1997-03-05 and 4-5-97", "0032/1/97"]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file string, text string")
    voters = lines.date_orders(rows, F.lit("1997-03-01").cast("date"))
    assert {r.file: r.date_order for r in voters.collect()} == {"1": "DMY", "2": "DMY", "4": "MDY"}
    assert {r.file for r in rows.where(F.col("text").rlike(lines.VOTE)).collect()} == {"1", "2", "4", "5"}


def test_split_names_are_found_without_sorting_single_rows(spark):
    """Clusters are counted on one row a cluster, and totals of a week are compared without a shuffle of their own."""
    from hourloom.operators import consolidate

    period = D(2026, 3, 1)
    none = lambda kind: spark.createDataFrame([], kind)
    rows = [(1, period, 0, "a"), (1, period, 0, "a"), (1, period, 1, "b"), (2, period, 0, "a"), (2, period, 0, "c"), (3, period, 0, None), (3, period, None, "a"), (None, period, 0, "a"), (None, period, 5, "a")]
    clusters = spark.createDataFrame(rows, "emp long, period date, cluster long, file string").withColumn("source", days.source(F.col("file"), F.lit("x"))).drop("file")
    weeks = spark.createDataFrame([(1, D(2026, 4, 6), D(2026, 4, 12), t, k) for k, t in enumerate((40.0, 40.001, 40.0))] + [(2, D(2026, 4, 6), D(2026, 4, 12), t, k) for k, t in enumerate((None, 4.0, 5.0))], WEEK)
    found = consolidate.month_issues(
        weekly.dedupe(weeks), none("emp long, period date, regular double, overtime double, total double, days_worked long"), none("emp long, period date, stated double"),
        none("emp long, period date, method string, needs_llm boolean"), clusters,
    )
    got = [(r.emp, r.code, r.scope, r.labels) for r in found.withColumn("labels", days.labels(F.col("sources"))).where("code <> 'WEEK_ONLY'").collect()]
    month = [(1, "CONFLICT", "month", "a"), (1, "CONFLICT", "month", "b"), (None, "CONFLICT", "month", "a"), (None, "CONFLICT", "month", "a")]
    assert sorted(got, key=str) == sorted([*month, (1, "DUPLICATE", "week", ""), (2, "CONFLICT", "week", "")], key=str)
    plan = weekly.dedupe(weeks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    plan = found.where("scope = 'month' and message like '%share a name'")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.index("Window") < plan.index("collect_list")


@pytest.mark.parametrize("seed", range(3))
def test_weeks_own_days_by_months(spark, seed):
    """Weeks of any length own what a day-by-day count says, and no row a day is sent."""
    import random

    r, day = random.Random(seed), lambda: D(2024, 1, 1) + dt.timedelta(r.randrange(70))
    weeks = []
    for k in range(60):
        a = day()
        weeks.append((r.choice([1, 2, None]), a, a + dt.timedelta(r.choice([-1, 0, 3, 6, 6, 45])), r.choice([None, 7.0, 35.0, 40.0]), k))
    daily = {(r.choice([1, 2, 3, None]), day()) for _ in range(12)}
    want, taken = {}, {x for x in daily if x[0] is not None}
    kept = {}
    for emp, a, b, t, k in sorted(weeks, key=lambda w: (-(w[3] or 0), w[4])):
        kept.setdefault((emp, a, b), (t, k))
    for (emp, a, b), (t, k) in sorted(kept.items(), key=lambda x: (x[0][1], x[1][1])):
        for n in range((b - a).days + 1):
            d = a + dt.timedelta(n)
            if (emp, d) not in taken:
                taken.add((emp, d))
                want[emp, d] = (a, b, t, (b - a).days + 1)
    weeks = spark.createDataFrame([(*w[:4], None if w[3] is None else w[3] - 5, 5.0, w[4]) for w in weeks], "emp long, week_start date, week_end date, total double, regular double, overtime double, seq long")
    daily = spark.createDataFrame([(*x, 8.0, 0.0, 8.0) for x in daily], "emp long, d date, regular double, overtime double, total double")
    got = weekly.coverage(weekly.dedupe(weeks), daily).collect()
    assert {(x.emp, x.d): (x.week_start, x.week_end, x.total, x.span) for x in got} == want and len(got) == len(want)
    sums = {}
    for (emp, d), (_, _, t, span) in want.items():
        sums[emp, d.replace(day=1)] = sums.get((emp, d.replace(day=1)), 0) + (t or 0) / span
    months = weekly.rollup_split(weekly.dedupe_split(weeks), daily)
    by_month = {(x.emp, x.period): x.total for x in months.collect()}
    for x in daily.collect():
        key = x.emp, x.d.replace(day=1)
        sums[key] = sums.get(key, 0) + 8
    assert by_month.keys() == sums.keys() and all(abs(by_month[k] - sums[k]) < 0.011 for k in sums)
    plan = months._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence(") == 1 and "interval" in plan.lower().split("generate", 1)[1][:300] and plan.count("Join ") == 1


def test_values_of_lines_are_looked_for_once(spark):
    """Each pattern stands where it needs to and not again for every bound; labels reach three lines back, as before."""
    texts = ["4/3/2026 on site", "none", "", "7.5 HOURS", "04-05-2026  8.25", "4/6/2026 9 Regular", "4/7/2026 Period 8.00", "4/8/2026 17.5 HRS", "29/4/2026 8.5", "x", "x", "x", "8 hrs", None]
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file string, line_no long, line string")
    got = lines.labelled_hours(rows, spark.createDataFrame([("f", "MDY")], "file string, date_order string"), F.lit(2026))
    assert {r.date: r.total for r in got.collect()} == {D(2026, 4, 3): 7.5, D(2026, 4, 5): 8.25, D(2026, 4, 6): 9.0, D(2026, 4, 29): 8.5}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(lines.PAY_CODE) <= 2 and plan.count(lines.LABEL) <= 2


@pytest.mark.parametrize(("value", "order", "want"), [("1/12/2026", "DMY", D(2026, 12, 1)), ("1/12/2026", None, D(2026, 1, 12)), ("13-1-2026", "MDY", D(2026, 1, 13)), ("01.28.1997", "DMY", D(1997, 1, 28)), ("13/13/2026", "DMY", None), ("2/28/0026", "MDY", D(2026, 2, 28)), ("30/2/2026", "DMY", None)])
def test_short_numeric_dates_take_the_short_way(spark, value, order, want):
    assert one(spark, value, lambda c: dates.parse_date(c, F.lit(order), F.lit(2026))) == want
    assert bool(re.fullmatch(dates.FULL_NUMERIC.replace(r"\z", r"\Z"), value)) == (value not in ("2/28/0026", "30/2/2026"))
