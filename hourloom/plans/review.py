"""Queries of answers, identity, review, the upload stream and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions.text import html_to_text
from hourloom.operators import answers, calendar, days, identity, review
from hourloom.plans.records import SQL_DAYS, entries
from hourloom.plans.scalars import SQL_HOLIDAYS
from hourloom.plans.views import table, view
from hourloom.sources import reports
from hourloom.sources.staged import shared_path
from hourloom.streaming import uploads

ORACLE: dict[str, str] = {}


def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.read_contract(view(spark, sf_dir, "v_answers"))
    return rows.select("file", F.col("answer.employee_name").alias("employee_name"), F.size("answer.entries").alias("entries"))


ORACLE["lenient_json"] = "SELECT o_orderkey AS file, concat('E', CAST(o_custkey AS STRING)) AS employee_name, 1 AS entries FROM orders"


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.contract_entries(view(spark, sf_dir, "v_answers"), F.lit("MDY"), F.lit(2000))


ORACLE["contract_rows"] = """SELECT o_orderkey AS file, concat('E', CAST(o_custkey AS STRING)) AS employee_name, CAST(o_orderdate AS DATE) AS d,
CAST(o_orderkey % 13 AS DOUBLE) AS regular, 0.0 AS overtime, CAST(o_orderkey % 13 AS DOUBLE) AS total FROM orders"""


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.majority(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


ORACLE["majority_vote"] = """SELECT conv_id, role FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) AS k
FROM conversations WHERE role <> '' GROUP BY conv_id, role) WHERE k = 1"""


def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_entries").withColumn("page_seq", F.col("seq")).withColumn("total", F.when(F.col("seq") % 7 > 0, F.col("total")))
    return answers.merge_pages(rows, "emp")


ORACLE["page_merge"] = """SELECT emp, d, page_seq, total FROM (SELECT emp, d, seq AS page_seq, t AS total, row_number() OVER (PARTITION BY emp, d
  ORDER BY coalesce(t, 0) DESC, seq) AS k
FROM (SELECT *, CASE WHEN seq % 7 > 0 THEN total END AS t FROM v_entries)) WHERE k = 1"""


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.usage(view(spark, sf_dir, "v_usage"))


ORACLE["usage_by_model"] = "SELECT model, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM v_usage GROUP BY model"


def escalation_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_entries")
    extra = rows.groupBy("emp").agg((F.min("seq") % 10 / 10).alias("confidence"), F.bool_or(F.col("extractor") == "error").alias("needs_llm"))
    return answers.worklist(answers.result_measures(rows, "emp").join(extra, "emp"))


ORACLE["escalation_worklist"] = """SELECT *, needs_llm OR confidence < 0.6 AS escalate, worked > 23 OR hours > 240 OR (entries > 0
  AND hours < 40) AS second_opinion, worked > 0 AND worked <= 24 AND hours <= 300 AS plausible
FROM (SELECT emp, count(*) AS entries, count(*) FILTER (total > 0) AS worked, sum(total) AS hours, min(seq) % 10 / 10.0 AS confidence,
  bool_or(extractor = 'error') AS needs_llm FROM v_entries GROUP BY emp)
WHERE needs_llm OR confidence < 0.6 OR worked > 23 OR hours > 240 OR (entries > 0 AND hours < 40)"""


def second_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_entries")
    return answers.choose_read(answers.result_measures(rows.where("seq % 2 = 0"), "emp"), answers.result_measures(rows.where("seq % 2 = 1"), "emp"), "emp")


ORACLE["second_read"] = """WITH m AS (SELECT emp, seq % 2 AS half, count(*) AS entries, count(*) FILTER (total > 0) AS worked, sum(total) AS hours FROM v_entries
  GROUP BY 1, 2)
SELECT emp, second, CASE WHEN second THEN be ELSE ae END AS entries, CASE WHEN second THEN bw ELSE aw END AS worked, CASE WHEN second THEN bh ELSE ah END AS hours FROM (
SELECT a.emp, b.emp IS NOT NULL AND (b.entries > a.entries OR a.entries = 0) AS second, a.entries AS ae, b.entries AS be, a.worked AS aw, b.worked AS bw, a.hours AS ah,
  b.hours AS bh
FROM m a LEFT JOIN m b ON a.emp = b.emp AND b.half = 1 WHERE a.half = 0)"""


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.conflict_pairs(identity.day_maps(view(spark, sf_dir, "v_results")))


SQL_MAPS = "SELECT ident, file_seq, d, arg_max(total, entry_seq) AS total FROM v_results GROUP BY ident, file_seq, d"
ORACLE["conflict_pairs"] = f"""SELECT a.ident, a.file_seq AS a, b.file_seq AS b, count(*) FILTER (abs(a.total - b.total) > 0.5) AS dates
FROM ({SQL_MAPS}) a JOIN ({SQL_MAPS}) b ON a.ident = b.ident AND a.d = b.d AND a.file_seq < b.file_seq
  GROUP BY 1, 2, 3 HAVING count(*) FILTER (abs(a.total - b.total) > 0.5) >= 2"""


def split_conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fit of each name's results, told apart by days that contradict."""
    return identity.split_conflicting(identity.day_maps(view(spark, sf_dir, "v_results")))


#: One step a result: its cluster is the first that differs on fewer than two dates, whose days it joins.
ORACLE["split_conflicting"] = f"""WITH RECURSIVE maps AS (
  SELECT ident, file_seq, map(list(d ORDER BY d), list(total ORDER BY d)) AS mine, row_number() OVER (PARTITION BY ident ORDER BY file_seq) AS k FROM ({SQL_MAPS})
  WHERE total IS NOT NULL GROUP BY ident, file_seq),
fit AS (
  SELECT ident, file_seq, k, CAST(0 AS BIGINT) AS cluster, [mine] AS clusters FROM maps WHERE k = 1
  UNION ALL SELECT ident, file_seq, k, cluster, CASE WHEN cluster = len(clusters) THEN list_append(clusters, mine)
      ELSE list_concat(list_concat(clusters[1 : cluster], [map_concat(mine, clusters[cluster + 1])]), clusters[cluster + 2 : len(clusters)]) END
  FROM (
    SELECT m.ident, m.file_seq, m.k, m.mine, f.clusters, coalesce(list_filter(range(len(f.clusters)), lambda i:
      len(list_filter(map_keys(m.mine), lambda x: abs(f.clusters[i + 1][x] - m.mine[x]) > 0.5)) < 2)[1], len(f.clusters)) AS cluster
    FROM fit f JOIN maps m ON m.ident = f.ident AND m.k = f.k + 1))
SELECT ident, file_seq, cluster FROM fit"""


KEYS, VERSION = ["user_id", "year", "month"], ["created_at", "id"]


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_uploads")
    return review.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), KEYS, VERSION)


SQL_LATEST = "SELECT user_id, year, month, id, created_at, status, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, year, month ORDER BY created_at DESC, id DESC) AS k FROM v_uploads) WHERE k = 1"
ORACLE["upsert_latest"] = SQL_LATEST


def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table by a stream of files in several batches."""
    source, target = shared_path(spark, "uploads"), shared_path(spark, "baseline")
    rows = view(spark, sf_dir, "v_uploads")
    rows.repartition(4, "id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    uploads.run_upserts(stream, target, shared_path(spark, "stream-state"), KEYS, VERSION)
    return uploads.read_latest(spark, target).select("user_id", "year", "month", "id", "created_at", "status", "total")


ORACLE["incremental_upsert"] = SQL_LATEST


def latest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions (orders of status 1-URGENT) with the newest file of their user and month."""
    rows = view(spark, sf_dir, "v_uploads")
    files = review.latest(rows.select("user_id", "year", "month", "created_at", F.col("id").alias("file_id")), KEYS, ["created_at", "file_id"])
    return rows.where("status = '1-URGENT'").select("id", *KEYS).join(files.select(*KEYS, "file_id"), KEYS, "left")


ORACLE["latest_file"] = f"SELECT u.id, u.user_id, u.year, u.month, l.id AS file_id FROM v_uploads u LEFT JOIN ({SQL_LATEST}) l ON u.user_id = l.user_id AND u.year = l.year AND u.month = l.month WHERE u.status = '1-URGENT'"


def admin_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.with_profiles(view(spark, sf_dir, "v_uploads"), view(spark, sf_dir, "v_profiles")).select("id", "user_id", "full_name", "client", "total", "created_at").orderBy(F.desc("created_at"))


ORACLE["admin_submissions"] = """SELECT u.id, u.user_id, coalesce(p.full_name, 'Unknown') AS full_name, coalesce(p.client, '—') AS client, u.total, u.created_at FROM v_uploads u LEFT JOIN v_profiles p ON u.user_id = p.user_id"""


def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.visible(view(spark, sf_dir, "v_uploads"), view(spark, sf_dir, "v_profiles"))


ORACLE["visible_rows"] = """SELECT p.user_id AS viewer, count(*) AS rows, sum(total) AS total FROM v_profiles p JOIN v_uploads u ON p.user_id = u.user_id
  WHERE role <> 'admin' GROUP BY 1
UNION ALL SELECT user_id, (SELECT count(*) FROM v_uploads), (SELECT sum(total) FROM v_uploads) FROM v_profiles WHERE role = 'admin'"""


def _review_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = days.resolve_days(entries(spark, sf_dir))
    own = found.select(F.col("emp").alias("user_id"), "d", "regular", "overtime", F.when(F.col("seq") % 3 > 0, F.col("total")).alias("total"))
    cal = calendar.calendar_days(own.select(F.trunc("d", "MM").alias("period")), calendar.us_holidays(own.select(F.year("d").alias("year"))))
    return cal, own


SQL_H = SQL_HOLIDAYS.replace("SELECT DISTINCT year AS y FROM v_uploads", "SELECT DISTINCT CAST(year(d) AS INT) AS y FROM v_entries")
SQL_REVIEW = f"""SELECT *, total IS NOT NULL AS filled, is_holiday AND coalesce(total, 0) > 0 AS worked_on_holiday FROM (
SELECT u.user_id, c.period, c.date AS d, isodow(c.date) >= 6 AS is_weekend, h.name IS NOT NULL AS is_holiday, a.regular, a.overtime, coalesce(CASE
  WHEN a.seq % 3 > 0 THEN a.total END, a.regular + a.overtime) AS total
FROM (SELECT DISTINCT emp AS user_id, CAST(date_trunc('month', d) AS DATE) AS period FROM v_entries) u
JOIN (SELECT period, CAST(unnest(generate_series(period, last_day(period), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS period FROM v_entries)) c ON c.period = u.period
LEFT JOIN ({SQL_H}) h ON h.date = c.date LEFT JOIN ({SQL_DAYS}) a ON a.emp = u.user_id AND a.d = c.date)"""


def review_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_calendar(*_review_days(spark, sf_dir))


ORACLE["review_calendar"] = SQL_REVIEW


def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = review.month_sums(review_calendar(spark, sf_dir)).withColumn("full_name", F.when(F.col("user_id") % 9 > 0, F.lit("x"))).withColumn("client",
    F.when(F.col("user_id") % 5 > 0, F.lit("c")))
    sums = sums.withColumn("stated_regular", F.col("regular") + F.col("user_id") % 3 * 0.4).withColumn("stated_overtime", F.col("overtime")).withColumn("weekends", F.when(F.col("user_id") % 2 == 0, F.lit("yes")).otherwise(F.lit("no"))).withColumn("holidays_taken", F.col("user_id") % 4 - 1)
    return review.submission_check(sums)


ORACLE["submission_check"] = f"""SELECT *, errors = '' AS ok FROM (SELECT user_id, period,
concat_ws('; ', CASE WHEN user_id % 9 = 0 THEN 'name is empty' END, CASE WHEN user_id % 3 = 2 THEN 'stated regular hours are off' END, CASE WHEN user_id % 2 = 0
  AND weekend = 0 THEN 'weekend work stated but no hours' END, CASE WHEN user_id % 4 = 0 THEN 'holidays taken below 0' END) AS errors,
concat_ws('; ', CASE WHEN user_id % 5 = 0 THEN 'client is empty' END, CASE WHEN user_id % 2 = 1
  AND weekend > 0 THEN 'weekend hours but none stated' END, CASE WHEN user_id % 4 = 1 AND holiday > 0 THEN 'holiday hours not marked' END) AS warnings,
CASE WHEN empty_days > 0 THEN 'working days are empty' ELSE '' END AS infos
FROM (SELECT user_id, period, coalesce(sum(total) FILTER (is_weekend), 0) AS weekend, coalesce(sum(total) FILTER (is_holiday), 0) AS holiday,
  count(*) FILTER (NOT is_weekend AND NOT is_holiday AND NOT filled) AS empty_days FROM ({SQL_REVIEW}) GROUP BY 1, 2))"""


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report, written as JSON and read back."""
    found, path = days.resolve_days(entries(spark, sf_dir)), shared_path(spark, "report")
    reports.write_report(reports.nested_report(days.month_totals(found), found), path)
    back = spark.read.schema("emp long, period date, total double, days array<struct<d:date,total:double>>").json(path)
    return back.select("emp", "period", "total", F.size("days").cast("long").alias("days"))


ORACLE["report_json"] = f"SELECT emp, CAST(date_trunc('month', d) AS DATE) AS period, round(sum(total), 2) AS total, count(*) AS days FROM ({SQL_DAYS}) GROUP BY 1, 2"


def mail_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML mails: the body of each message is its page's text."""
    head = "concat('Subject: page ', page_id, '\\nFrom: a@example.com\\nMIME-Version: 1.0\\nContent-Type: text/html; charset=utf-8\\nContent-Transfer-Encoding: base64\\n\\n', base64(to_binary(html, 'utf-8')))"
    files = table(spark, sf_dir, "pages").selectExpr("CAST(page_id AS STRING) AS file", f"to_binary({head}, 'utf-8') AS content")
    return reports.mail_bodies(reports.mail_parts(files), html_to_text).select("file", "subject", "body")


ORACLE["mail_body"] = r"""SELECT CAST(page_id AS STRING) AS file, concat('page ', CAST(page_id AS STRING)) AS subject,
  trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>',
  ' ', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \t\n\r\f\v]+', ' ', 'g')) AS body FROM pages"""

QUERIES = {
    f.__name__: f
    for f in (
        lenient_json, contract_rows, majority_vote, page_merge, usage_by_model, escalation_worklist, second_read, conflict_pairs, split_conflicting, upsert_latest,
        incremental_upsert, latest_file, admin_submissions, visible_rows, review_calendar, submission_check, report_json, mail_body,
    )
}
