"""Queries of what comes in: delimited files, mails with attachments, rejects, reads and attempts, logs, listings, submissions' findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import text
from hourloom.functions.text import html_to_text
from hourloom.operators import answers, consolidate, files, grids, ocr, review, submissions, weekly
from hourloom.plans import consolidated
from hourloom.plans.records import _calendar
from hourloom.plans.review import ORACLE as REVIEW
from hourloom.plans.review import SQL_REVIEW
from hourloom.plans.review import review_calendar as calendar_of
from hourloom.plans.review import submission_check as checked
from hourloom.plans.scalars import ORACLE as SCALARS
from hourloom.plans.views import table, view
from hourloom.sources import delimited, reports
from hourloom.sources.staged import shared_path

ORACLE: dict[str, str] = {}
#: Hours between clock times, in SQL.
IN_OUT = SCALARS["in_out_hours"]
#: Columns of the wide delimited files.
WIDE = 70


def _delimited(spark: SparkSession, sf_dir: str) -> str:
    """Orders as delimited rows of many columns, with quotes, separators and line breaks in cells, and ragged ends; the folder."""
    path = shared_path(spark, "delimited")
    note = "concat('\"', o_orderpriority, ', \"\"', o_custkey, '\"\"', CASE WHEN o_orderkey % 3 = 0 THEN '\n\n\"\"second\"\" line, too' ELSE '' END, '\"')"
    last = f"CASE WHEN o_orderkey % 4 > 0 THEN concat(repeat(',', {WIDE - 4}), 'w', o_orderkey % 11) ELSE '' END"
    rows = table(spark, sf_dir, "orders").selectExpr(f"concat(o_orderkey, ',', {note}, ',5\" pipe,', o_orderkey % 9, {last}) AS value")
    rows.coalesce(2).write.text(path)
    return path


def delimited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of delimited files that are read by ranges: by row, its key, and what its cells say."""
    cells = delimited.read_delimited(spark, _delimited(spark, sf_dir), ",")
    key = F.max(F.when(F.col("col") == 0, F.col("value"))).cast("long")
    at = lambda k: F.max(F.when(F.col("col") == k, F.col("value")))
    got = cells.groupBy("file", "row_id").agg(
        key.alias("o_orderkey"), at(1).alias("note"), at(2).alias("size"), at(3).alias("hours"), at(WIDE - 1).alias("last"), F.count("*").alias("cells"),
    )
    return got.drop("file", "row_id")


ORACLE["delimited_cells"] = """SELECT o_orderkey, concat(o_orderpriority, ', "', o_custkey, '"', CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(10), chr(10),
  '"second" line, too') ELSE '' END) AS note,
'5" pipe' AS size, CAST(o_orderkey % 9 AS VARCHAR) AS hours, CASE WHEN o_orderkey % 4 > 0 THEN concat('w', o_orderkey % 11) END AS last, CASE
  WHEN o_orderkey % 4 > 0 THEN 5 ELSE 4 END AS cells FROM orders"""


def delimited_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as tables: the text dump of each, its header and first rows."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("file"), "o_orderkey", F.concat(F.lit("a,b,c,d\n")).alias("head"),
        F.concat(F.col("o_orderkey"), F.lit(",,\"x "), F.col("o_orderkey") % 7, F.lit('"')).alias("row"),
    )
    texts = rows.groupBy("file").agg(
        F.concat(F.first("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]), "\r\n")).alias("text"),
    )
    return delimited.dump(delimited.text_cells(texts), 12)


ORACLE["delimited_dump"] = """SELECT file, row_id, line FROM (SELECT DISTINCT o_custkey AS file, CAST(0 AS BIGINT) AS row_id, 'a | b | c | d' AS line FROM orders
UNION ALL SELECT o_custkey, k, concat('[r', k + 1, '] ', o_orderkey, ' |  | x ', o_orderkey % 7, ' | ') FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 12)"""


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mail of several parts for each customer: a greeting as text and HTML, its orders as an attached table, and another mail."""
    rows = view(spark, sf_dir, "v_layout_rows").selectExpr("table_id AS k", "row_id", "concat(written, ',', h, '.5,\"a, b\"') AS row")
    tables = rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "row"))), lambda x: x["row"]), "\r\n").alias("body"))
    mail = r"""concat('From: p', k, '@example.com\nSubject: hours of ', k, '\nDate: Mon, 3 Feb 1997 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=XX\n\n--XX\n',
      'Content-Type: multipart/alternative; boundary=YY\n\n--YY\nContent-Type: text/plain\n\nTotal is attached\n--YY\nContent-Type: text/html\n\n<b>Total</b>\n--YY--\n--XX\n',
      'Content-Type: ', CASE WHEN k % 2 = 0 THEN 'text/csv' ELSE 'application/octet-stream' END,
  '; name="hours.csv"\nContent-Disposition: attachment; filename="hours.csv"\nContent-Transfer-Encoding: base64\n\n',
      base64(to_binary(concat('Date,Hours,Note\r\n', body, '\r\n'), 'utf-8')), '\n--XX\nContent-Type: message/rfc822\n\nSubject: inner\n\n1/1/1997 9.0\n--XX--\n')"""
    return tables.selectExpr("concat('mail', k) AS file", f"to_binary({mail}, 'utf-8') AS content")


def mail_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails from their parts to results: what their attached tables hold counts as the mail's own."""
    parts = consolidate.staged(reports.mail_parts(_mails(spark, sf_dir)), "mail-parts")
    bodies = reports.mail_bodies(parts, html_to_text)
    cells = reports.attached_cells(parts).withColumn("table_id", F.xxhash64("file", "part")).drop("part")
    own = bodies.select("file", F.lit("1997-01-01").cast("date").alias("period"))
    found = consolidate.cascade(own, cells, reports.mail_lines(bodies))
    hours = found.entries.groupBy("file").agg(F.round(F.sum("total"), 2).alias("hours"))
    heads = bodies.select("file", "subject", "sender", "body", F.col("attachments").cast("long").alias("attachments"))
    return heads.join(found.results.select("file", "method", "found"), "file").join(hours, "file")


ORACLE["mail_results"] = """SELECT concat('mail', o_custkey) AS file, concat('hours of ', o_custkey) AS subject, concat('p', o_custkey, '@example.com') AS sender,
  'Total is attached' AS body,
CAST(1 AS BIGINT) AS attachments, 'daily_grid' AS method, count(*) AS found, round(sum(o_orderkey % 9 + 0.5), 2) AS hours FROM orders GROUP BY o_custkey"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with what was extracted: text (some of it of invoices), tables, images, notes."""
    said = "CASE file_seq % 13 WHEN 5 THEN 'INVOICE No. 7, Bill To: A' WHEN 6 THEN concat('Balance due: $', file_seq) WHEN 7 THEN '' ELSE CASE WHEN layout IN (2, 6) THEN 'Hours' END END AS text"
    rows = view(spark, sf_dir, "v_files").selectExpr(
        "*", said, "CASE WHEN layout IN (2, 6) OR file_seq % 13 = 7 THEN 0 ELSE 1 END AS tables", "CASE WHEN file_seq % 3 = 0 THEN 1 ELSE 0 END AS images",
        "CASE WHEN file_seq % 26 = 7 THEN array('empty csv', 'no pages') ELSE array() END AS notes", "concat(file, CASE WHEN file_seq % 13 = 6 THEN '-inv-3.pdf' ELSE '.pdf' END) AS path",
    )
    return rows.withColumn("invoice", text.is_invoice(F.coalesce("text", F.lit("")), F.col("path")))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go no further, and why."""
    return files.sort_out(_seen(spark, sf_dir))[1].select("path", "reason")


SQL_REJECTS = """SELECT path, reason FROM (SELECT concat(file, CASE WHEN file_seq % 13 = 6 THEN '-inv-3.pdf' ELSE '.pdf' END) AS path, file,
CASE WHEN file_seq % 13 = 7 AND file_seq % 3 > 0 THEN CASE WHEN file_seq % 26 = 7 THEN 'empty csv; no pages' ELSE 'nothing extractable' END
     WHEN file_seq % 13 IN (5, 6) THEN 'an invoice or bill, not a timesheet' END AS reason FROM v_files) WHERE reason IS NOT NULL"""
ORACLE["rejects"] = SQL_REJECTS


def file_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file seen and what became of it: the cascade takes those that go on, so none is lost and none is in both."""
    seen = _seen(spark, sf_dir)
    accepted, rejected = files.sort_out(seen)
    found = consolidate.cascade(accepted.select("file", "period"), view(spark, sf_dir, "v_layout_cells"), view(spark, sf_dir, "v_layout_lines"))
    processed = found.results.join(accepted.select("file", "path"), "file")
    return files.reconcile(seen.select("path"), processed.select("path"), rejected.select("path"))


ORACLE["file_balance"] = f"""SELECT path, CASE WHEN r.reason IS NULL THEN 'processed' ELSE 'rejected' END AS status FROM
(SELECT concat(file, CASE WHEN file_seq % 13 = 6 THEN '-inv-3.pdf' ELSE '.pdf' END) AS path FROM v_files) f LEFT JOIN ({SQL_REJECTS}) r USING (path)"""


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that results, entries, weeks or rejects name: what a reviewer may ask for."""
    found = consolidated._found(spark, sf_dir)
    return files.referenced(found.results.where("found > 0"), found.entries, found.weeks, files.sort_out(_seen(spark, sf_dir))[1])


ORACLE["named_files"] = f"""WITH {consolidated.SQL_FOUND} SELECT file FROM results WHERE found > 0 UNION SELECT file FROM v_files f
JOIN ({SQL_REJECTS}) r ON r.path = concat(file, CASE WHEN file_seq % 13 = 6 THEN '-inv-3.pdf' ELSE '.pdf' END)"""


def _reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "v_uploads").select(
        F.col("user_id").alias("file"), F.col("month").alias("page"), F.col("id").alias("attempt"), (F.col("id") % 5 > 0).alias("ok"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).otherwise(F.lit(0)).alias("found"),
        (F.col("id") % 4).alias("worked"), (F.col("total") / 10).alias("hours"),
    )
    pages = rows.groupBy("file").agg(F.count_distinct("page").alias("pages"))
    return rows.where("attempt % 2 = 0"), rows.where("attempt % 2 = 1"), pages


def accepted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that each page of a file is taken from."""
    return answers.accepted_pages(_reads(spark, sf_dir)[0])


def sql_accepted(half: int) -> str:
    return f"""SELECT * FROM (SELECT user_id AS file, month AS page, id AS attempt, CASE WHEN id % 3 > 0 THEN id % 4 ELSE 0 END AS found, id % 4 AS worked,
  total / 10 AS hours, attempts FROM (
  SELECT *, CASE WHEN id % 3 > 0 THEN id % 4 ELSE 0 END > 0 AND id % 5 > 0 AS read, max(id) OVER (PARTITION BY user_id, month) AS attempts FROM v_uploads
  WHERE id % 2 = {half}) WHERE id % 5 > 0
  QUALIFY row_number() OVER (PARTITION BY user_id, month ORDER BY read DESC, CASE WHEN read THEN id ELSE -id END) = 1)"""


ORACLE["accepted_attempts"] = sql_accepted(0)


def chained_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files give after attempts, coverage and plausibility."""
    return answers.chained_reads(*_reads(spark, sf_dir))


ORACLE["chained_attempts"] = f"""WITH p AS (SELECT user_id AS file, count(DISTINCT month) AS pages FROM v_uploads GROUP BY 1),
a AS (SELECT file, count(*) AS n, sum(worked) AS w, round(sum(hours), 2) AS h FROM ({sql_accepted(0)})
  GROUP BY file), b AS (SELECT file, count(*) AS n, sum(worked) AS w, round(sum(hours), 2) AS h FROM ({sql_accepted(1)}) GROUP BY file),
j AS (SELECT p.file, coalesce(a.n, 0) AS an, coalesce(a.w, 0) AS aw, coalesce(a.h, 0) AS ah, coalesce(b.n, 0) AS bn, coalesce(b.w, 0) AS bw, coalesce(b.h, 0) AS bh,
  coalesce(a.w, 0) < 0.6 * CASE WHEN pages = 1 THEN 8 ELSE least(5 * pages, 22) END AND coalesce(b.h, 0) > coalesce(a.h, 0) AS more FROM p LEFT JOIN a USING (file) LEFT
  JOIN b USING (file)),
k AS (SELECT *, CASE WHEN NOT more THEN 'first' WHEN bw > 0 AND bw <= 24 AND bh <= 300 THEN 'coverage' ELSE 'implausible' END AS step FROM j)
SELECT file, step, CAST(CASE step WHEN 'coverage' THEN bn ELSE an END AS BIGINT) AS read, CAST(CASE step WHEN 'coverage' THEN bw ELSE aw END AS BIGINT) AS worked,
  CASE step WHEN 'coverage' THEN bh ELSE ah END AS hours FROM k"""


def always_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worklist of the policy that reads everything again."""
    rows = view(spark, sf_dir, "v_entries")
    extra = rows.groupBy("emp").agg(F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_llm"))
    return answers.worklist(answers.result_measures(rows, "emp").join(extra, "emp"), always=True).select("emp", "hours", "escalate", "second_opinion")


ORACLE["always_worklist"] = """SELECT emp, sum(total) AS hours, true AS escalate, count(*) FILTER (total > 0) > 23 OR sum(total) > 240 OR sum(total) < 40 AS second_opinion FROM v_entries GROUP BY emp"""


def contract_week_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly totals of answers; a missing bound is six days from the other."""
    said = F.expr(
        "concat('{\"weekly_totals\":[{\"', CASE file % 2 WHEN 0 THEN 'week_start' ELSE 'week_end' END, '\":\"', substr(text, instr(text, '\"date\":\"') + 8, 10), '\",\"total_hours\":\"', file % 50, ' hrs\"}, {\"total_hours\": 3}]}')",
    )
    return answers.contract_weeks(view(spark, sf_dir, "v_answers").select("file", said.alias("text")), F.lit("MDY"), F.lit(2000))


ORACLE["contract_week_rows"] = """SELECT o_orderkey AS file, CAST(d - CASE WHEN o_orderkey % 2 = 1 THEN 6 ELSE 0 END AS DATE) AS week_start, CAST(d + CASE
  WHEN o_orderkey % 2 = 0 THEN 6 ELSE 0 END AS DATE) AS week_end,
CAST(o_orderkey % 50 AS DOUBLE) AS total FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def grounded_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two OCR reads of a page the better one, and its text where it is good enough to ground an answer."""
    rows = view(spark, sf_dir, "v_words").select(F.col("file").alias("page"), "line", "conf", "text")
    reads = rows.groupBy("page", (F.col("line") % 2).alias("k")).agg(F.min("text").alias("text"), F.round(F.avg("conf"), 1).alias("confidence"))
    got = ocr.better_read(
        reads.where("k = 1").drop("k"), reads.where("k = 0").withColumn("text", F.when(F.col("page") % 5 > 0, F.col("text")).otherwise(F.lit(""))).drop("k"),
    )
    return got.withColumn("grounds", answers.grounding(F.col("text"), F.col("confidence")))


ORACLE["grounded_reads"] = """WITH r AS (SELECT file AS page, line % 2 AS k, min(text) AS text, round(avg(conf), 1) AS confidence FROM v_words GROUP BY 1, 2),
c AS (SELECT a.page, coalesce(a.confidence < 55 AND b.page % 5 > 0
  AND b.confidence > a.confidence, false) AS second, a.text AS t1, b.text AS t2, a.confidence AS c1, b.confidence AS c2 FROM (SELECT * FROM r WHERE k = 1) a LEFT
  JOIN (SELECT * FROM r WHERE k = 0) b ON a.page = b.page)
SELECT page, text, confidence, CASE WHEN confidence >= 55 THEN text END AS grounds
  FROM (SELECT page, CASE WHEN second THEN t2 ELSE t1 END AS text, CASE WHEN second THEN c2 ELSE c1 END AS confidence FROM c)"""


def vision_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an image and hardly any text."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file"), (F.col("doc_id") % 4).alias("page"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" \t\n"), F.substring("text", 1, 50))).otherwise(F.col("text")).alias("text"),
        (F.col("doc_id") % 2).alias("images"),
    )
    return files.needs_vision(rows)


ORACLE["vision_pages"] = r"""SELECT doc_id AS file, doc_id % 4 AS page FROM documents WHERE doc_id % 2 = 1 AND (doc_id % 3 = 0 OR length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 60)"""


def submission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions as a log that two runs add to: all rows stay, and the latest of each month holds."""
    path, rows = shared_path(spark, "submissions"), view(spark, sf_dir, "v_uploads")
    for half in (0, 1):
        submissions.append(rows.where(F.col("id") % 2 == half), path)
    stored = submissions.read_log(spark, path)
    held = review.latest(stored.select("user_id", "year", "month", "created_at", "id", "total"), submissions.KEYS, submissions.VERSION)
    return held.join(stored.groupBy(*submissions.KEYS).agg(F.count("*").alias("submissions")), submissions.KEYS).drop("created_at")


ORACLE["submission_log"] = """SELECT user_id, year, month, id, total, submissions FROM (SELECT *, row_number() OVER (PARTITION BY user_id, year, month
  ORDER BY created_at DESC, id DESC) AS k,
count(*) OVER (PARTITION BY user_id, year, month) AS submissions FROM v_uploads) WHERE k = 1"""


def newest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest month of the stored report."""
    rows = view(spark, sf_dir, "v_uploads").groupBy(F.col("user_id").alias("emp"), F.make_date("year", "month",
    F.lit(1)).alias("period")).agg(F.round(F.sum("total"), 2).alias("total"))
    path = shared_path(spark, "monthly-report")
    reports.write_report(rows, path)
    return reports.latest_report(spark, path).select("emp", "year", "month", "total")


ORACLE["newest_report"] = """SELECT user_id AS emp, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, round(sum(total), 2) AS total FROM v_uploads WHERE (year, month) = (SELECT max((year, month)) FROM v_uploads) GROUP BY 1, 2, 3"""


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents below a folder, in folders by brand; hidden and system files left out."""
    path = shared_path(spark, "folder")
    rows = view(spark, sf_dir, "v_paths").select(
        F.concat("path", F.lit(" "), "file_seq").alias("value"), (F.col("file_seq") % 7).alias("client"), (F.col("file_seq") % 3).alias("month"),
    )
    rows.repartition(2, "client", "month").write.partitionBy("client", "month").text(path)
    found = reports.list_files(spark, path)
    folder = F.regexp_extract("path", r"client=(\d+)/month=(\d+)/[^/]+$", 0)
    return found.groupBy(F.regexp_extract("path", r"client=(\d+)/", 1).cast("long").alias("client"), F.regexp_extract(folder, r"month=(\d+)/", 1).cast("long").alias("month")).agg(F.sum("length").alias("bytes"))


ORACLE["listed_files"] = """SELECT CAST(file_seq % 7 AS BIGINT) AS client, CAST(file_seq % 3 AS BIGINT) AS month, CAST(sum(strlen(concat(path, ' ', file_seq)) + 1) AS BIGINT) AS bytes FROM v_paths GROUP BY 1, 2"""

VIEWERS = [1, 50, 100_000_000]


def viewer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three viewers may see: an employee, an admin, and somebody without a profile."""
    return review.rows_visible_to(view(spark, sf_dir, "v_uploads").select("user_id", "id", "total"), view(spark, sf_dir, "v_profiles"), VIEWERS)


ORACLE["viewer_rows"] = """SELECT p.user_id AS viewer, u.user_id, u.id, u.total FROM v_profiles p JOIN v_uploads u ON p.role = 'admin' OR u.user_id = p.user_id WHERE p.user_id IN (1, 50, 100000000)"""


def corrected_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a review calendar with manual corrections of some."""
    cal = calendar_of(spark, sf_dir).select("user_id", "d", "regular", "overtime", "total", (F.col("is_weekend") & F.col("filled")).alias("flagged"))
    fixes = cal.where(F.dayofmonth("d") % 5 == 0).select(
        "user_id", "d", F.when(F.dayofmonth("d") % 2 == 0, F.lit(7.5)).alias("regular"), F.when(F.dayofmonth("d") % 3 == 0, F.lit(1.0)).alias("overtime"),
    )
    return review.correct(cal, fixes)


ORACLE["corrected_days"] = f"""SELECT user_id, d, CASE WHEN k % 5 > 0 THEN regular WHEN k % 2 = 0 THEN 7.5 END AS regular, CASE WHEN k % 5 > 0 THEN overtime
  WHEN k % 3 = 0 THEN 1.0 END AS overtime,
CASE WHEN k % 5 > 0 THEN total WHEN k % 2 = 0 OR k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 7.5 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0 END END AS total,
  is_weekend AND filled AND k % 5 > 0 AS flagged
FROM (SELECT *, day(d) AS k FROM ({SQL_REVIEW}))"""


def prefilled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers read off each month's calendar, and the name that a submission goes by."""
    cal = calendar_of(spark, sf_dir)
    got = review.prefilled(review.month_sums(cal), cal)
    name = review.first_of(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" U"), F.col("user_id"))), F.lit(""), F.lit("unnamed"))
    told = F.array_join(F.transform(F.map_entries("holidays_worked"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    return got.select("user_id", "period", "stated_regular", "stated_overtime", "weekends", told.alias("holidays"), name.alias("name"))


ORACLE["prefilled_answers"] = f"""SELECT user_id, period, round(coalesce(sum(regular), 0), 2) AS stated_regular, round(coalesce(sum(overtime), 0), 2) AS stated_overtime,
CASE WHEN coalesce(sum(total) FILTER (is_weekend), 0) > 0 THEN 'yes' ELSE 'no' END AS weekends,
coalesce(string_agg(concat(CAST(d AS VARCHAR), '=', CASE WHEN coalesce(total, 0) > 0 THEN 'true' ELSE 'false' END), ',' ORDER BY d) FILTER (is_holiday), '') AS holidays,
CASE WHEN user_id % 2 = 0 THEN concat('U', user_id) ELSE 'unnamed' END AS name FROM ({SQL_REVIEW}) GROUP BY user_id, period"""


def submission_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding on submissions as a row; the answers about holidays are checked day by day."""
    cal = calendar_of(spark, sf_dir)
    said = F.map_from_entries(
        F.collect_list(F.when(F.col("is_holiday") & (F.dayofmonth("d") % 3 > 0), F.struct("d", ((F.col("user_id") + F.dayofmonth("d")) % 2 == 0).alias("v")))),
    )
    answered = cal.groupBy("user_id", "period").agg(said.alias("worked"))
    return review.findings(checked(spark, sf_dir), review.holiday_answers(cal, answered))


ORACLE["submission_findings"] = f"""SELECT user_id, period, CAST(NULL AS DATE) AS d, severity, message FROM (
  SELECT user_id, period, 'error' AS severity, unnest(string_split(errors, '; ')) AS message FROM ({REVIEW['submission_check']})
  UNION ALL SELECT user_id, period, 'warning', unnest(string_split(warnings, '; ')) FROM ({REVIEW['submission_check']})
  UNION ALL SELECT user_id, period, 'info', unnest(string_split(infos, '; ')) FROM ({REVIEW['submission_check']})) WHERE message <> ''
UNION ALL SELECT user_id, period, d, CASE WHEN said THEN 'error' ELSE 'warning' END, CASE WHEN said THEN 'holiday marked as worked but no hours'
  ELSE 'holiday hours not marked' END FROM (
  SELECT *, day(d) % 3 > 0 AND (user_id + day(d)) % 2 = 0 AS said, coalesce(total, 0) AS t FROM ({SQL_REVIEW}) WHERE is_holiday) WHERE (said AND t = 0) OR (NOT said
  AND t > 0)"""



def clock_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of clock times with lunch columns: the day's hours are the time between, less lunch."""
    rows = view(spark, sf_dir, "v_clock").selectExpr(
        "emp AS table_id", "seq AS row_id", "concat('1/', CAST(seq % 28 + 1 AS STRING), '/1997') AS a", "time_in AS b", "CASE WHEN lunch_minutes > 0 THEN '12:00 PM' END AS c",
        "CASE lunch_minutes WHEN 30.0 THEN '12:30 pm' WHEN 60.0 THEN '1:00 PM' END AS e", "time_out AS f",
    )
    cells = rows.selectExpr("table_id", "row_id", "stack(5, 0, a, 1, b, 2, c, 3, e, 4, f) AS (col, value)").where("value is not null")
    heads = rows.select("table_id").distinct().selectExpr(
        "table_id", "-1L AS row_id", "stack(5, 0, 'Date', 1, 'Time In', 2, 'Lunch Out', 3, 'Lunch In', 4, 'Time Out') AS (col, value)",
    )
    return grids.daily_grid(grids.role_columns(cells.unionByName(heads)), F.lit("MDY"), F.lit(1997)).drop("project", "note")


ORACLE["clock_grid"] = f"""SELECT emp AS table_id, seq AS row_id, make_date(1997, 1, CAST(seq % 28 + 1 AS INT)) AS d, hours AS regular, CASE
  WHEN hours IS NOT NULL THEN 0.0 END AS overtime, hours AS total,
CASE WHEN hours IS NULL THEN 'UNCLEAR' WHEN hours > 16 THEN 'OUT_OF_RANGE' END AS issue FROM ({IN_OUT})"""


SHEET_ROWS = """SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY row_id) - 1 AS row_id,
       CASE WHEN row_id % 3 = 0 OR row_id % 4 = 1 OR table_id % 20 = 3 THEN '' ELSE written END AS a,
       CASE WHEN row_id % 3 = 0 OR row_id % 5 = 0 OR table_id % 20 = 3 THEN ' ' ELSE CAST(h AS STRING) END AS b FROM v_layout_rows"""
SHEETS = "SELECT concat('b', CAST(file_seq % 20 AS STRING)) AS file, file_seq AS table_id, CASE WHEN file_seq % 9 > 0 THEN concat('S', CAST(file_seq AS STRING)) END AS sheet FROM v_files"


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("v_layout_rows", "v_files"):
        view(spark, sf_dir, name).createOrReplaceTempView(name)
    cells = spark.sql(SHEET_ROWS).selectExpr("table_id", "CAST(row_id AS BIGINT) AS row_id", "stack(3, 0, a, 1, b, 2, '') AS (col, value)")
    return cells, spark.sql(SHEETS)


def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets' rows as lines that name sheet and row, blank rows left out but counted."""
    return grids.sheet_dump(*_sheets(spark, sf_dir))


SQL_SHEET_TEXTS = f"""SELECT file, s.table_id, row_id, concat('[', coalesce(sheet, ''), '!r', row_id + 1, '] ', a, CASE WHEN trim(b) <> '' THEN concat(' | ', b) ELSE '' END) AS line
FROM ({SHEET_ROWS}) r JOIN ({SHEETS}) s ON s.table_id = r.table_id WHERE a <> '' OR trim(b) <> ''"""
ORACLE["sheet_texts"] = SQL_SHEET_TEXTS


def sheet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by how many of their sheets hold anything; those without are empty."""
    cells, sheets = _sheets(spark, sf_dir)
    return grids.sheet_status(sheets, grids.sheet_dump(cells, sheets))


ORACLE["sheet_files"] = f"""SELECT s.file, count(DISTINCT t.table_id) AS tables, CASE WHEN count(t.table_id) > 0 THEN 'native' ELSE 'empty' END AS quality
FROM ({SHEETS}) s LEFT JOIN ({SQL_SHEET_TEXTS}) t ON t.table_id = s.table_id GROUP BY s.file"""


def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer sees of each file: its first tables under their titles."""
    cells, sheets = _sheets(spark, sf_dir)
    return grids.digest(cells, sheets.withColumnRenamed("sheet", "title"))


ORACLE["file_digest"] = f"""SELECT file, string_agg(concat(rtrim(concat('# table ', coalesce(sheet, ''))), coalesce(concat(chr(10), lines), ''), chr(10)), chr(10) ORDER BY t) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY table_id) AS t FROM ({SHEETS})) s
LEFT JOIN (SELECT table_id, string_agg(concat(a, ' | ', b, ' | '), chr(10) ORDER BY row_id) AS lines FROM ({SHEET_ROWS}) WHERE row_id < 60 GROUP BY table_id) r ON r.table_id = s.table_id
WHERE t <= 12 GROUP BY file"""


def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cascade's records come to: people, months, hours, findings by severity, files that results name and rejects, in one row."""
    found = consolidated._found(spark, sf_dir)
    got = consolidate.person_records(found, consolidated._named(spark, sf_dir, found))
    months = weekly.with_stated(got.months, got.stated)
    issues = consolidate.all_issues(got, _calendar(spark, got.days))
    count = lambda severity: F.count_if(F.col("severity") == severity).alias(f"{severity}s")
    parts = [
        months.agg(F.count_distinct("emp").alias("people"), F.count("*").alias("months"), F.round(F.sum("total"), 2).alias("hours"), F.sum("days_worked").alias("days_worked")),
        issues.agg(count("error"), count("warning"), count("info"), F.count_distinct(F.when(F.col("severity") == "error", F.col("emp"))).alias("people_with_errors")),
        found.results.agg(F.count("*").alias("files"), F.count_if("needs_llm").alias("weak_files")), files.sort_out(_seen(spark, sf_dir))[1].agg(F.count("*").alias("rejects")),
    ]
    out = parts[0].withColumn("k", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


ORACLE["issue_totals"] = f"""SELECT * FROM (SELECT count(DISTINCT ident) AS people, count(*) AS months, round(sum(total), 2) AS hours,
  CAST(sum(days_worked) AS BIGINT) AS days_worked FROM ({consolidated.ORACLE["consolidated_months"]})),
(SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
  count(DISTINCT ident) FILTER (severity = 'error') AS people_with_errors FROM ({consolidated.ORACLE["consolidated_issues"]})),
(SELECT count(*) AS files, count(*) FILTER (needs_llm) AS weak_files FROM ({consolidated.ORACLE["file_results"]})), (SELECT count(*) AS rejects FROM ({SQL_REJECTS}))"""

QUERIES = {
    f.__name__: f
    for f in (
        delimited_cells, delimited_dump, mail_results, rejects, file_balance, named_files, accepted_attempts, chained_attempts, always_worklist, contract_week_rows,
        grounded_reads, vision_pages, submission_log, newest_report, listed_files, viewer_rows, corrected_days, prefilled_answers, submission_findings,
        clock_grid, issue_totals, sheet_texts, sheet_files, file_digest,
    )
}
