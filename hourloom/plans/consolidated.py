"""Queries from cells and texts to records, over files of varied layouts, and the rules around identities, months and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import text
from hourloom.operators import answers, consolidate, days, files, grids, submissions, weekly
from hourloom.plans import records
from hourloom.plans.views import table, view

ORACLE: dict[str, str] = {}


def _found(spark: SparkSession, sf_dir: str) -> consolidate.Found:
    own = view(spark, sf_dir, "v_files").select("file", "period")
    return consolidate.cascade(own, view(spark, sf_dir, "v_layout_cells"), view(spark, sf_dir, "v_layout_lines"))


def _named(spark: SparkSession, sf_dir: str, found: consolidate.Found) -> DataFrame:
    return consolidate.attach_identity(found.results, view(spark, sf_dir, "v_files").select("file", "file_seq", "name_hint", "client_hint"))


def file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which strategy each file took, what it found, and whether it needs another read."""
    return _found(spark, sf_dir).results


#: What each strategy reads of the layouts. tok: the parts of dates; orders: day or month first, by file; dated: rows with the date read.
SQL_FOUND = """tok AS (
  SELECT *, CASE WHEN contains(written, '/') THEN CAST(split_part(written, '/', 1) AS INT) END AS a, CASE WHEN contains(written, '/') THEN CAST(split_part(written, '/',
  2) AS INT) END AS b
  FROM v_layout_rows WHERE layout NOT IN (3, 7)),
votes AS (
  SELECT t.file, count(*) FILTER (a > 12) AS a12, count(*) FILTER (b > 12) AS b12, count(*) FILTER (b = month(period)) AS dmy, count(*) FILTER (a = month(period)) AS mdy
  FROM tok t JOIN v_files f ON f.file = t.file GROUP BY t.file),
date_orders AS (SELECT file, CASE WHEN a12 > 0 AND b12 = 0 THEN 'DMY' WHEN b12 > 0 AND a12 = 0 THEN 'MDY' WHEN dmy > mdy THEN 'DMY' ELSE 'MDY' END AS o FROM votes),
dated AS (
  SELECT t.* EXCLUDE (d), CASE WHEN a IS NULL THEN d WHEN a > 12 OR (o = 'DMY' AND b <= 12) THEN make_date(year(d), b, a) ELSE make_date(year(d), a, b) END AS d
  FROM tok t JOIN date_orders o ON o.file = t.file),
grid AS (
  SELECT file, table_id, row_id, d, r AS regular, CASE WHEN o IS NOT NULL THEN o WHEN r IS NOT NULL THEN 0.0 END AS overtime, r + coalesce(o, 0) AS total FROM (
    SELECT *, CASE WHEN row_id % 4 > 0 THEN CAST(h AS DOUBLE) END AS r, CASE WHEN row_id % 3 = 0 AND row_id % 5 > 0 THEN 1.5 END AS o FROM dated WHERE layout IN (0, 4))),
said AS (SELECT file, table_id, d, CASE WHEN count(DISTINCT h) = 1 THEN max(h) + 0.5 END AS total FROM dated WHERE layout IN (2, 6) GROUP BY file, table_id, d),
matrix AS (
  SELECT r.file, table_id, CAST(anchor + CAST(row_id % 7 AS INT) AS DATE) AS d, round(sum(CAST(h AS DOUBLE)), 2) AS total
  FROM v_layout_rows r JOIN v_files f ON f.file = r.file WHERE r.layout = 7 AND anchor IS NOT NULL AND h > 0 GROUP BY 1, 2, 3),
week_rows AS (SELECT file, table_id, row_id, CAST(d - 6 AS DATE) AS week_start, d AS week_end, CAST(w AS DOUBLE) AS total FROM dated WHERE layout IN (1, 5)),
covers AS (
  SELECT r.file, arg_min(CAST(w AS DOUBLE), row_id) AS stated FROM v_layout_rows r WHERE r.layout = 3 AND w > 0 AND row_id % 3 < 2 GROUP BY r.file),
results AS (
  SELECT f.file, f.file_seq, f.period, lower(f.name_hint) AS who, f.name_hint, f.client_hint,
    CASE WHEN g.n > 0 THEN 'daily_grid' WHEN w.n > 0 THEN 'weekly_totals' WHEN m.n > 0 THEN 'weekday_matrix' WHEN t.n > 0 THEN 'text_hours_labeled'
      WHEN c.stated IS NOT NULL THEN 'summary_total' ELSE 'deterministic_insufficient' END AS method,
    coalesce(g.n, w.n, m.n, t.n, 0) AS found, CASE WHEN g.n > 0 THEN g.c WHEN w.n > 0 THEN 0.7 WHEN m.n > 0 THEN 0.6 WHEN t.n > 0 THEN t.c
  WHEN c.stated IS NOT NULL THEN 0.6 ELSE 0.1 END AS confidence,
    CASE WHEN g.n > 0 AND f.layout = 0 AND f.file_seq % 3 = 0 THEN 160 ELSE c.stated END AS stated_total,
    CASE WHEN t.n > 0 THEN t.c < 0.5 ELSE coalesce(g.n, w.n, m.n) IS NULL AND c.stated IS NULL END AS needs_llm
  FROM v_files f
  LEFT JOIN (SELECT file, count(*) AS n, round(count(coalesce(regular, overtime)) / count(*), 2) AS c FROM grid GROUP BY file) g ON f.file = g.file
  LEFT JOIN (SELECT file, count(*) AS n FROM week_rows GROUP BY file) w ON f.file = w.file
  LEFT JOIN (SELECT file, count(*) AS n FROM matrix GROUP BY file) m ON f.file = m.file
  LEFT JOIN (SELECT file, count(*) AS n, CASE WHEN bool_or(total IS NULL) THEN 0.45 ELSE 0.72 END AS c FROM said GROUP BY file) t ON f.file = t.file
  LEFT JOIN covers c ON f.file = c.file)"""
ORACLE["file_results"] = f"WITH {SQL_FOUND} SELECT file, period, method, found, CAST(confidence AS DOUBLE) AS confidence, CAST(stated_total AS DOUBLE) AS stated_total, needs_llm FROM results"


def consolidated_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cells and lines to each person's months: every calendar day once, by trust, then by weekly totals; months known by a stated
    total alone have that."""
    found = _found(spark, sf_dir)
    return consolidate.records(found, _named(spark, sf_dir, found))


#: People's entries, days, weeks, months with data, and stated totals by the rule: the first that a month's files state.
SQL_PEOPLE = f"""{SQL_FOUND},
entries AS (
  SELECT concat('nm:', r.who) AS ident, e.*, file_seq, r.file AS f FROM results r JOIN (
    SELECT file, d, regular, overtime, total, 3.0 AS trust, table_id AS t, row_id AS r, 1 AS kind, concat(file, ' · sheet=', table_id, ' · row', row_id) AS label
  FROM grid
    UNION ALL SELECT file, d, total, CASE WHEN total IS NOT NULL THEN 0.0 END, total, 1.5, -1, -1, 2, file FROM said
    UNION ALL SELECT file, d, NULL, NULL, total, 2.0, table_id, -1, 3, concat(file, ' · sheet=', table_id) FROM matrix) e ON e.file = r.file),
readable AS (SELECT * FROM entries WHERE coalesce(regular, overtime, total) IS NOT NULL),
days AS (
  SELECT *, count(*) OVER (PARTITION BY ident, d) AS n FROM readable QUALIFY row_number() OVER (PARTITION BY ident, d ORDER BY trust DESC, file_seq, t, r) = 1),
weeks AS (
  SELECT concat('nm:', r.who) AS ident, file_seq, w.*, count(*) OVER same AS n FROM week_rows w
  JOIN results r ON r.file = w.file WINDOW same AS (PARTITION BY r.who, week_start)
  QUALIFY row_number() OVER (PARTITION BY r.who, week_start ORDER BY total DESC, file_seq, row_id) = 1),
owned AS (
  SELECT * FROM (SELECT ident, week_start, total, file_seq, row_id, CAST(unnest(generate_series(week_start, week_end, INTERVAL 1 DAY)) AS DATE) AS d FROM weeks) w
  WHERE NOT EXISTS (SELECT 1 FROM days p WHERE p.ident = w.ident AND p.d = w.d) QUALIFY row_number() OVER (PARTITION BY ident, d
  ORDER BY week_start, file_seq, row_id) = 1),
with_data AS (
  SELECT ident, period, round(sum(r), 2) AS regular, round(sum(o), 2) AS overtime, round(sum(t), 2) AS total, CAST(sum(n) AS BIGINT) AS days_worked FROM (
    SELECT ident, CAST(date_trunc('month', d) AS DATE) AS period, coalesce(regular, 0) AS r, coalesce(overtime, 0) AS o, coalesce(total, 0) AS t, CASE
  WHEN total > 0 THEN 1 ELSE 0 END AS n FROM days
    UNION ALL SELECT ident, period, part, 0, part, round_even(part / 8, 0) FROM (
      SELECT ident, CAST(date_trunc('month', d) AS DATE) AS period, any_value(total) * (count(*) / 7) AS part FROM owned GROUP BY ident, week_start, 2))
  GROUP BY ident, period),
stated AS (
  SELECT concat('nm:', who) AS ident, period, arg_min(stated_total, file_seq) AS stated, arg_min(file, file_seq) AS file FROM results WHERE stated_total IS NOT NULL
  GROUP BY 1, 2),
stated_alone AS (SELECT * FROM stated s WHERE NOT EXISTS (SELECT 1 FROM with_data w WHERE w.ident = s.ident AND w.period = s.period))"""
ORACLE["consolidated_months"] = f"""WITH {SQL_PEOPLE} SELECT * FROM with_data
UNION ALL SELECT ident, period, round(stated, 2), 0, round(stated, 2), CAST(round_even(stated / 8, 0) AS BIGINT) FROM stated_alone"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's name, clients, methods and open reads, by name."""
    got = consolidate.people(_named(spark, sf_dir, _found(spark, sf_dir)))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return days.by_name(got.select("ident", "employee_name", "stated_total", "needs_llm", joined("clients"), joined("files"), joined("methods")))


ORACLE["people"] = f"""WITH {SQL_FOUND}, clients AS (SELECT who, client_hint AS c, min(file_seq) AS s FROM results
  GROUP BY 1, 2), methods AS (SELECT who, method AS m, min(file_seq) AS s FROM results GROUP BY 1, 2)
SELECT concat('nm:', r.who) AS ident, any_value(name_hint) AS employee_name, CAST(arg_min(stated_total,
  file_seq) FILTER (stated_total IS NOT NULL) AS DOUBLE) AS stated_total, bool_or(needs_llm) AS needs_llm,
(SELECT string_agg(c, ',' ORDER BY s) FROM clients k WHERE k.who = r.who) AS clients, string_agg(file, ',' ORDER BY file_seq) AS files,
(SELECT string_agg(m, ',' ORDER BY s) FROM methods k WHERE k.who = r.who) AS methods FROM results r GROUP BY r.who"""


def consolidated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding about entries, days, weeks and months of the cascade's records, each with its sources."""
    found = _found(spark, sf_dir)
    got = consolidate.person_records(found, _named(spark, sf_dir, found))
    issues = consolidate.all_issues(got, records._calendar(spark, got.days))
    return issues.withColumn("sources", days.labels(F.col("sources"))).withColumnRenamed("emp", "ident")


ORACLE["consolidated_issues"] = f"""WITH {SQL_PEOPLE}, holidays AS ({records.HOLIDAYS.replace("v_entries", "days")}),
cal AS (
  SELECT period, date, isodow(date) >= 6 AS is_weekend, date IN (SELECT date FROM holidays) AS is_holiday FROM (
    SELECT period, CAST(unnest(generate_series(period, last_day(period), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS period FROM days))),
day_sources AS (SELECT ident, d, count(DISTINCT round(total, 2)) AS dt, string_agg(label, '; ' ORDER BY file_seq, t, r) AS sources FROM readable GROUP BY ident, d),
files_by_month AS (
  SELECT ident, period, string_agg(f, '; ' ORDER BY f) AS sources FROM (SELECT DISTINCT ident, CAST(date_trunc('month', d) AS DATE) AS period, f FROM entries)
  GROUP BY 1, 2),
active AS (SELECT a.ident, c.* FROM (SELECT DISTINCT ident, CAST(date_trunc('month', d) AS DATE) AS period FROM days) a JOIN cal c ON c.period = a.period),
week_all AS (
  SELECT concat('nm:', r.who) AS ident, file_seq, w.*, CAST(table_id AS VARCHAR) AS sheet, concat(w.file, ' · sheet=', table_id, ' · row', row_id) AS label
  FROM week_rows w JOIN results r ON r.file = w.file),
week_codes AS (
  SELECT ident, week_start, count(*) AS n, count(DISTINCT round(total, 2)) AS dt, string_agg(label, '; ' ORDER BY file_seq, row_id) AS sources FROM week_all
  GROUP BY ident, week_start),
reads AS (SELECT concat('nm:', who) AS ident, period, bool_or(needs_llm) AS needs, string_agg(file, '; ' ORDER BY file) AS sources FROM results GROUP BY 1, 2)
SELECT ident, period, scope, date, code, severity, message, coalesce(sources, '') AS sources FROM (
SELECT ident, CAST(date_trunc('month', d) AS DATE) AS period, 'entry' AS scope, d AS date, 'UNCLEAR' AS code, 'warning' AS severity,
  CASE kind WHEN 1 THEN 'date present but hours unreadable' ELSE 'several labelled hours for the day' END AS message, label AS sources
  FROM entries e WHERE coalesce(regular, overtime, total) IS NULL AND (kind = 2 OR NOT EXISTS (SELECT 1 FROM days x WHERE x.ident = e.ident AND x.d = e.d))
UNION ALL SELECT ident, CAST(date_trunc('month', d) AS DATE), 'entry', d, 'OUT_OF_RANGE', 'warning', concat(CAST(total AS VARCHAR), 'h exceeds the day''s bound'), label
  FROM entries WHERE total > 16
UNION ALL SELECT ident, CAST(date_trunc('month', d) AS DATE), 'day', d, 'OUT_OF_RANGE', 'warning', concat(CAST(total AS VARCHAR), 'h exceeds the day''s bound'), sources
  FROM days JOIN day_sources USING (ident, d) WHERE total > 16
UNION ALL SELECT x.ident, c.period, 'day', x.d, 'OUT_OF_RANGE', 'info', CASE WHEN is_holiday THEN 'hours on a holiday' ELSE 'hours on a weekend' END, sources
  FROM days x JOIN day_sources s ON s.ident = x.ident AND s.d = x.d JOIN cal c ON c.date = x.d WHERE (is_weekend OR is_holiday) AND total > 0
UNION ALL SELECT x.ident, CAST(date_trunc('month', x.d) AS DATE), 'day', x.d, CASE WHEN dt > 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END, CASE WHEN dt > 1 THEN 'error'
  ELSE 'info' END, 'several sources', sources
  FROM days x JOIN day_sources s ON s.ident = x.ident AND s.d = x.d WHERE n > 1
UNION ALL SELECT a.ident, a.period, 'day', a.date, 'MISSING', 'info', 'no data for a working day', sources FROM active a LEFT JOIN files_by_month m ON m.ident = a.ident
  AND m.period = a.period
  WHERE NOT is_weekend AND NOT is_holiday AND NOT EXISTS (SELECT 1 FROM days x WHERE x.ident = a.ident AND x.d = a.date)
  AND NOT EXISTS (SELECT 1 FROM week_all w WHERE w.ident = a.ident AND a.date BETWEEN w.week_start AND w.week_end)
UNION ALL SELECT ident, CAST(date_trunc('month', week_start) AS DATE), 'week', NULL, CASE WHEN dt > 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END, CASE WHEN dt > 1 THEN 'error'
  ELSE 'info' END,
  concat(CASE WHEN dt > 1 THEN 'conflicting' ELSE 'repeated' END, ' totals of the week from ', CAST(week_start AS VARCHAR)), sources FROM week_codes WHERE n > 1
UNION ALL SELECT ident, period, 'month', NULL, 'WEEK_ONLY', 'info', concat(CAST(count(DISTINCT week_start) AS VARCHAR), ' weekly totals, shared out to the month'),
  string_agg(label, '; ' ORDER BY file, sheet, row_id) FROM (
  SELECT *, CAST(unnest(list_distinct([date_trunc('month', week_start), date_trunc('month', week_end)])) AS DATE) AS period FROM week_all) GROUP BY ident, period
UNION ALL SELECT ident, period, 'month', NULL, 'WEEK_ONLY', 'info', 'only a stated month total', file FROM stated_alone
UNION ALL SELECT s.ident, s.period, 'month', NULL, 'TOTAL_MISMATCH', 'warning', 'the stated month total is off', file FROM stated s JOIN with_data w ON w.ident = s.ident
  AND w.period = s.period WHERE abs(stated - total) > 0.5
UNION ALL SELECT ident, period, 'month', NULL, 'NEEDS_LLM', 'warning', 'a source needs another read', sources FROM reads WHERE needs)"""


def _split_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records._weeks(spark, sf_dir)
    overtime = F.when(F.col("l_partkey") % 3 == 0, F.floor(F.col("total") / 10).cast("double"))
    return rows.select(
        "emp", "week_start", "week_end", "total", F.when(overtime.isNotNull(), F.col("total") - overtime).alias("regular"), overtime.alias("overtime"), "seq",
    )


def rollup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with regular and overtime: weeks bring their parts, and those that aren't split count as regular."""
    daily = records._daily(spark, sf_dir)
    parts = daily.select("emp", "d", F.least("total", F.lit(8.0)).alias("regular"), F.greatest(F.col("total") - 8, F.lit(0.0)).alias("overtime"), "total")
    return weekly.rollup_split(weekly.dedupe_split(_split_weeks(spark, sf_dir)), parts)


ORACLE["rollup_split"] = f"""WITH split_weeks AS (
  SELECT k.*, CASE WHEN v.l_partkey % 3 = 0 THEN floor(k.total / 10) END AS ot FROM ({records.SQL_WEEKS}) k
  JOIN v_weekly v ON v.emp = k.emp AND v.l_orderkey * 10000000 + v.l_linenumber * 1000000 + v.l_partkey = k.seq),
owned AS (
  SELECT * FROM (
    SELECT emp, week_start, week_end, total, ot, seq, CAST(unnest(generate_series(week_start, week_end, INTERVAL 1 DAY)) AS DATE) AS d FROM split_weeks) w
  WHERE NOT EXISTS (SELECT 1 FROM v_daily v WHERE v.emp = w.emp AND v.d = w.d) QUALIFY row_number() OVER (PARTITION BY emp, d ORDER BY week_start, seq) = 1),
shares AS (
  SELECT emp, CAST(date_trunc('month', d) AS DATE) AS period, any_value(total) AS total, any_value(ot) AS ot, count(*) / 7 AS s FROM owned GROUP BY emp, week_start, week_end, 2)
SELECT emp, period, round(sum(r), 2) AS regular, round(sum(o), 2) AS overtime, round(sum(t), 2) AS total, CAST(sum(n) AS BIGINT) AS days_worked FROM (
  SELECT emp, period, (total - coalesce(ot, 0)) * s AS r, coalesce(ot, 0) * s AS o, total * s AS t, round_even(total * s / 8, 0) AS n FROM shares
  UNION ALL SELECT emp, CAST(date_trunc('month', d) AS DATE), least(total, 8), greatest(total - 8, 0), total, CASE WHEN total > 0 THEN 1 ELSE 0 END FROM ({records.SQL_DAILY}))
GROUP BY emp, period"""


def _read_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each person's months, as the events tell: how they were read and whether that was enough. Reads of signups say nothing."""
    rows = view(spark, sf_dir, "v_entries")
    method = F.when(F.col("extractor") == "error", F.lit("llm_vision")).otherwise(F.lit("csv"))
    at = days.source(F.concat(F.lit("f"), (F.col("seq") % 5).cast("string")), method)
    late = F.add_months("d", F.when(F.col("extractor") == "error", F.lit(1)).otherwise(F.lit(0)))
    return rows.select("emp", F.trunc(late, "MM").alias("period"), method.alias("method"), (F.col("total") > 22).alias("needs_llm"), at.alias("source"))


def month_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings about weeks and months: weekly conflicts, shared-out weeks, stated totals, weak reads, split names; with sources."""
    weeks = _split_weeks(spark, sf_dir).withColumn("source", days.source(F.concat(F.lit("w"), F.col("seq").cast("string")), F.lit("weekly_totals")))
    months = records.employee_month_daily(spark, sf_dir)
    file = F.concat(F.lit("u"), F.min_by("id", F.struct(-F.col("total"), F.col("id"))).cast("string"))
    stated = view(spark, sf_dir, "v_uploads").groupBy(F.col("user_id").alias("emp"), F.make_date("year", "month", F.lit(1)).alias("period")).agg(
        F.max("total").alias("stated"), F.array(days.source(file, F.lit("form"))).alias("sources"),
    )
    clusters = view(spark, sf_dir, "v_entries").select(
        "emp", F.trunc("d", "MM").alias("period"), (F.col("seq") % 50 == 0).cast("long").alias("cluster"),
        days.source(F.concat(F.lit("f"), (F.col("seq") % 5).cast("string")), F.lit("x")).alias("source"),
    )
    found = consolidate.month_issues(weekly.dedupe_split(weeks), months, stated, _read_by(spark, sf_dir), clusters)
    return found.withColumn("sources", days.labels(F.col("sources")))


SQL_STATED = "SELECT user_id AS emp, make_date(year, month, 1) AS period, max(total) AS stated, concat('u', arg_min(id, struct_pack(a := -total, b := id))) AS sources FROM v_uploads GROUP BY 1, 2"
SQL_READS = """SELECT emp, period, bool_or(by_model) AS by_model, bool_or(needs) AS needs, string_agg(DISTINCT f, '; ' ORDER BY f) AS sources FROM (
  SELECT emp, CAST(date_trunc('month', CASE WHEN extractor = 'error' THEN d + INTERVAL 1 MONTH ELSE d END) AS DATE) AS period, extractor = 'error' AS by_model,
  total > 22 AS needs, concat('f', seq % 5) AS f FROM v_entries) GROUP BY 1, 2"""
ORACLE["month_issue_list"] = f"""WITH weeks AS ({records.SQL_WEEKS}), months AS ({records.SQL_MONTHS}), stated AS ({SQL_STATED}), reads AS ({SQL_READS}),
every_week AS (SELECT *, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq FROM v_weekly),
week_sources AS (SELECT emp, week_start, week_end, string_agg(concat('w', seq), '; ' ORDER BY seq) AS sources FROM every_week GROUP BY ALL),
known AS (SELECT emp, period, total, days_worked FROM months UNION ALL SELECT emp, period, stated, CAST(round_even(stated / 8, 0) AS BIGINT) FROM stated s
  WHERE NOT EXISTS (SELECT 1 FROM months m WHERE m.emp = s.emp AND m.period = s.period)),
parted AS (SELECT emp, CAST(date_trunc('month', d) AS DATE) AS period, seq % 50 = 0 AS c, concat('f', seq % 5) AS f FROM v_entries)
SELECT emp, period, scope, CAST(NULL AS DATE) AS date, code, severity, message, coalesce(sources, '') AS sources FROM (
SELECT emp, CAST(date_trunc('month', week_start) AS DATE) AS period, 'week' AS scope, code, CASE code WHEN 'CONFLICT' THEN 'error' ELSE 'info' END AS severity,
  concat(CASE code WHEN 'CONFLICT' THEN 'conflicting' ELSE 'repeated' END, ' totals of the week from ', CAST(week_start AS VARCHAR)) AS message, sources FROM weeks
  JOIN week_sources USING (emp, week_start, week_end) WHERE code IS NOT NULL
UNION ALL SELECT emp, period, 'month', 'WEEK_ONLY', 'info', concat(CAST(count(DISTINCT week_start) AS VARCHAR), ' weekly totals, shared out to the month'),
  string_agg(concat('w', seq), '; ' ORDER BY concat('w', seq)) FROM (
  SELECT emp, week_start, seq, CAST(unnest(list_distinct([date_trunc('month', week_start), date_trunc('month', week_end)])) AS DATE) AS period FROM every_week)
  GROUP BY emp, period
UNION ALL SELECT emp, period, 'month', 'WEEK_ONLY', 'info', 'only a stated month total', sources FROM stated s WHERE NOT EXISTS (SELECT 1 FROM months m
  WHERE m.emp = s.emp AND m.period = s.period)
UNION ALL SELECT s.emp, s.period, 'month', 'TOTAL_MISMATCH', 'warning', 'the stated month total is off', sources FROM stated s JOIN months m ON m.emp = s.emp
  AND m.period = s.period WHERE abs(stated - total) > 0.5
UNION ALL SELECT r.emp, r.period, 'month', 'NEEDS_LLM', 'warning', 'few hours read by a model or from an image', sources FROM reads r LEFT JOIN known m ON m.emp = r.emp
  AND m.period = r.period
  WHERE by_model AND coalesce(total, 0) < 80 AND coalesce(days_worked, 0) < 10
UNION ALL SELECT emp, period, 'month', 'NEEDS_LLM', 'warning', 'a source needs another read', sources FROM reads WHERE needs
UNION ALL SELECT emp, period, 'month', 'CONFLICT', 'warning', 'several people share a name', string_agg(DISTINCT f, '; ' ORDER BY f) FROM parted
  WHERE (emp, period) IN (SELECT (emp, period) FROM parted GROUP BY emp, period HAVING count(DISTINCT c) > 1) GROUP BY emp, period, c)"""


def uncovered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working days without data that no weekly total covers either."""
    rows = records.entries(spark, sf_dir)
    weeks = rows.where("seq % 20 = 0").select("emp", F.trunc("d", "week").alias("week_start"), F.date_add(F.trunc("d", "week"), 6).alias("week_end"))
    return days.missing_days(rows.where(days.has_hours()), records._calendar(spark, rows), weeks)


ORACLE["uncovered_days"] = f"""SELECT emp, period, d FROM ({records.SQL_MISSING}) m WHERE NOT EXISTS (SELECT 1 FROM v_entries e WHERE e.seq % 20 = 0 AND e.emp = m.emp AND date_trunc('week', e.d) = date_trunc('week', m.d))"""


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the people that parts of one size share a name of, told apart by their files' stems."""
    rows = view(spark, sf_dir, "v_paths")
    stem = F.regexp_replace(F.initcap(F.regexp_replace(F.regexp_extract("path", r"([^/]+)[.][^.]*$", 1), "_", " ")), "[.]", " ")
    stems = rows.select("file_seq", stem.alias("stem"))
    clusters = rows.select((F.col("file_seq") % 100).alias("ident"), "file_seq", (F.col("file_seq") % 3).alias("cluster"))
    names = clusters.select("ident").distinct().withColumn("employee_name", F.when(F.col("ident") % 2 == 0, F.concat(F.lit("Employee-"), F.col("ident").cast("string"))))
    return consolidate.split_names(clusters, stems, names, text.distinguishing_words(F.col("stem")))


ORACLE["split_names"] = r"""SELECT ident, cluster, CASE WHEN words <> '' THEN concat(base, ' — ', words) ELSE base END AS employee_name FROM (
SELECT ident, cluster, coalesce(CASE WHEN ident % 2 = 0 THEN concat('Employee-', CAST(ident AS VARCHAR)) END, 'Unknown') AS base,
  array_to_string(list_filter(list_slice(w, greatest(len(w) - 2, 1), len(w)), lambda x: lower(x) NOT IN ('employee', 'unknown')), ' ') AS words
FROM (SELECT ident, cluster, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(p_name, '[_\-]+', ' ', 'g'), '#', '#', 'g')), '\s+'),
  lambda x: length(x) > 2 AND lower(x) NOT IN ('copy', 'may', 'final')) AS w0,
  list_transform(w0, lambda x: concat(upper(substr(x, 1, 1)), lower(substr(x, 2)))) AS w
  FROM (SELECT p_partkey % 100 AS ident, p_partkey % 3 AS cluster, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1, 2)
  WHERE ident IN (SELECT p_partkey % 100 FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 3) > 1)))"""


def submission_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of each person's months: the latest submission, with the latest correction beside it."""
    rows = view(spark, sf_dir, "v_uploads").select(
        "user_id", "year", "month", "id", "created_at", F.least("total", F.lit(160.0)).alias("regular"),
        F.greatest(F.col("total") - 160, F.lit(0.0)).alias("overtime"), "total", "status",
    )
    fixes = rows.where("id % 3 = 0").select(
        "user_id", "year", "month", "id", "created_at", F.when(F.col("id") % 2 == 0, F.col("regular") + 1).alias("regular"), F.lit(2.0).alias("overtime"),
    )
    return submissions.current(rows.drop("status"), fixes)


ORACLE["submission_state"] = """SELECT s.user_id, s.year, s.month, s.id, coalesce(f.r, least(s.total, 160)) AS regular, coalesce(f.o, greatest(s.total - 160,
  0)) AS overtime,
CASE WHEN f.o IS NOT NULL THEN coalesce(f.r, least(s.total, 160)) + 2.0 ELSE s.total END AS total, f.o IS NOT NULL AS corrected
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, year, month ORDER BY created_at DESC, id DESC) AS k FROM v_uploads) s
LEFT JOIN (SELECT *, CASE WHEN id % 2 = 0 THEN least(total, 160) + 1 END AS r, 2.0 AS o, row_number() OVER (PARTITION BY user_id, year, month
  ORDER BY created_at DESC, id DESC) AS k FROM v_uploads WHERE id % 3 = 0) f
ON f.user_id = s.user_id AND f.year = s.year AND f.month = s.month AND f.k = 1 WHERE s.k = 1"""


def baseline_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' baselines with the totals of their latest submission."""
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("timesheet_id"), F.lit(160.0).alias("regular"), F.lit(0.0).alias("overtime"), F.lit(160.0).alias("total"),
    )
    sent = view(spark, sf_dir, "v_uploads").select(
        F.col("user_id").alias("timesheet_id"), "id", "created_at", F.col("total").alias("regular"), F.lit(None).cast("double").alias("overtime"), "total",
    )
    return submissions.sync_baseline(base, sent)


ORACLE["baseline_sync"] = """SELECT c_custkey AS timesheet_id, coalesce(t, 160.0) AS regular, 0.0 AS overtime, coalesce(t, 160.0) AS total FROM customer
LEFT JOIN (SELECT user_id, arg_max(total, struct_pack(a := created_at, b := id)) AS t FROM v_uploads GROUP BY user_id) u ON user_id = c_custkey"""


def file_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files in the order in which they count, with name, size and period."""
    rows = view(spark, sf_dir, "v_paths").select(
        F.concat("path", F.lit("/"), F.col("file_seq").cast("string")).alias("path"), F.lit("application/pdf").alias("mime"),
        (F.col("file_seq") * 700).alias("length"), F.lit(1997).alias("year"), (F.col("file_seq") % 12 + 1).cast("int").alias("month"),
        F.when(F.col("file_seq") % 2 == 0, F.lit("processed")).alias("status"),
    )
    order = files.arrival(rows.select("path"))
    return submissions.register(rows).join(order, "path")


ORACLE["file_register"] = """SELECT path, CAST(file_seq AS VARCHAR) AS name, 'application/pdf' AS mime, CAST(round(file_seq * 700 / 1024) AS BIGINT) AS kb,
  make_date(1997, file_seq % 12 + 1, 1) AS period,
CASE WHEN file_seq % 2 = 0 THEN 'processed' ELSE 'uploaded' END AS status, row_number() OVER (ORDER BY path) - 1 AS file_seq
  FROM (SELECT concat(path, '/', CAST(file_seq AS VARCHAR)) AS path, file_seq FROM v_paths)"""


def canonical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times as the text of spreadsheet cells."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 2 * 3601)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.canonical(at).alias("value"))


ORACLE["canonical_cells"] = """SELECT o_orderkey, CASE WHEN strftime(t, '%H:%M:%S') = '00:00:00' THEN strftime(t, '%Y-%m-%d') ELSE strftime(t,
  '%Y-%m-%dT%H:%M:%S') END AS value
FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3601 SECOND * (o_orderkey % 2) AS t FROM orders)"""


def clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as page tables: those of one line go."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"),
    F.col("l_linenumber").cast("long").alias("row_id")).agg(F.max("l_returnflag").alias("mode"))
    cells = rows.selectExpr("table_id", "row_id", "stack(2, 0, concat(' ', mode), 1, concat(mode, ' ')) AS (col, value)")
    return grids.clean_tables(cells).groupBy("table_id").agg(F.count("*").alias("cells"), F.min(F.when(F.col("is_header"), F.col("value"))).alias("first_header"))


ORACLE["clean_tables"] = """SELECT table_id, 2 * count(*) AS cells, arg_min(mode, row_id) AS first_header FROM (SELECT l_orderkey AS table_id, l_linenumber AS row_id, trim(max(l_returnflag)) AS mode FROM lineitem GROUP BY 1, 2) GROUP BY table_id HAVING count(*) >= 2"""


def answer_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as results: confidence, and whether they say anything."""
    said = F.expr(
        "concat(CASE file % 3 WHEN 0 THEN text WHEN 1 THEN concat('```json ', '{\"employee_name\": \"A\", \"confidence\": \"0.9\", \"entries\": []}', ' ```') ELSE 'no answer' END, '')",
    )
    return answers.contract_results(view(spark, sf_dir, "v_answers").select("file", said.alias("text"))).select("file", "employee_name", "confidence", "needs_llm")


ORACLE["answer_results"] = """SELECT o_orderkey AS file, CASE o_orderkey % 3 WHEN 0 THEN concat('E', CAST(o_custkey AS VARCHAR)) WHEN 1 THEN 'A' END AS employee_name,
CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.65 ELSE 0.3 END AS DOUBLE) AS confidence, o_orderkey % 3 > 0 AS needs_llm FROM orders"""


def larger_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several reads of a customer's file the first where it covers its pages, else the one with most hours."""
    reads = view(spark, sf_dir, "v_uploads").select(
        F.col("user_id").alias("file"), F.col("id").alias("seq"), (F.col("id") % 23).alias("worked"), F.col("total").alias("hours"),
        (F.col("user_id") % 5 + 1).alias("pages"),
    )
    return answers.larger_read(reads)


ORACLE["larger_reads"] = """SELECT file, CASE WHEN ok THEN a ELSE b END AS seq, CASE WHEN ok THEN ha ELSE hb END AS hours, ok AS covers FROM (
SELECT file, a, b, ha, hb, wa >= 0.6 * CASE WHEN pages = 1 THEN greatest(least(5 * pages, 22), 8) ELSE least(5 * pages, 22) END AS ok FROM (
SELECT user_id AS file, any_value(user_id % 5 + 1) AS pages, min(id) AS a, arg_min(total, id) AS ha, arg_min(id % 23, id) AS wa, arg_max(id, struct_pack(h := total,
  k := -id)) AS b, max(total) AS hb FROM v_uploads GROUP BY user_id))"""


def trust_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far entries are trusted, by extractor, else by the method's first part."""
    method = F.when(F.col("extractor") == "click", F.lit("llm_vision:page")).when(F.col("extractor") == "view", F.lit("csv")).otherwise(F.lit("other:x"))
    own = F.when(F.col("extractor") == "purchase", F.lit("pdf_native"))
    return view(spark, sf_dir, "v_entries").select("seq", days.trust_of(own, method).alias("trust"))


ORACLE["trust_weights"] = "SELECT seq, CAST(CASE extractor WHEN 'purchase' THEN 2.8 WHEN 'click' THEN 1.9 WHEN 'view' THEN 3.0 ELSE 1.5 END AS DOUBLE) AS trust FROM v_entries"


def ident_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under which key each customer's files are one person's."""
    name, number = F.expr("CASE WHEN c_custkey % 7 > 0 THEN concat(' ', upper(c_name), '  (x) ') END"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END")
    return table(spark, sf_dir, "customer").select("c_custkey", days.ident_key(name, number).alias("ident"))


ORACLE["ident_keys"] = r"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('id:', regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g'))
  WHEN c_custkey % 7 > 0
THEN concat('nm:', trim(regexp_replace(trim(regexp_replace(lower(concat(c_name, '  x')), '[^a-z0-9 ]', '', 'g')), '\s+', ' ', 'g'))) ELSE 'nm:unknown' END AS ident
  FROM customer"""


def recovered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of one month in which some dates were lost to the empty epoch, and their months' stated totals."""
    period = F.lit("1997-03-01").cast("date")
    rows = view(spark, sf_dir, "v_layout_rows").selectExpr(
        "table_id", "row_id", "CASE WHEN row_id % 3 = 0 THEN concat('1900-01-', lpad(CAST(day(d) AS STRING), 2, '0')) ELSE CAST(d AS STRING) END AS a",
        "CAST(h AS STRING) AS b",
    )
    cells = rows.selectExpr("table_id", "row_id", "stack(2, 0, a, 1, b) AS (col, value)")
    own = rows.select("table_id").distinct()
    heads = own.selectExpr(
        "table_id",
        "stack(4, -1L, 0, 'Date', -1L, 1, 'Hours', 1L << 40, 0, 'Month total', 1L << 40, 1, CAST(table_id % 200 + 1 AS STRING)) AS (row_id, col, value)",
    )
    read = grids.role_columns(cells.unionByName(heads))
    entries = grids.daily_grid(read, F.lit("MDY"), F.lit(1997), period=period).groupBy("table_id").agg(
        F.count("*").alias("entries"), F.count_if("recovered").alias("recovered"), F.round(F.sum("total"), 2).alias("total"),
    )
    return entries.join(grids.stated_totals(read, F.lit("MDY"), F.lit(1997), "date"), "table_id", "full")


ORACLE["recovered_dates"] = """SELECT t.table_id, entries, recovered, total, CAST(t.table_id % 200 + 1 AS DOUBLE) AS stated_total FROM (SELECT DISTINCT table_id
  FROM v_layout_rows) t
LEFT JOIN (SELECT table_id, count(*) AS entries, count(*) FILTER (row_id % 3 = 0) AS recovered, round(sum(CAST(h AS DOUBLE)), 2) AS total FROM v_layout_rows
  WHERE row_id % 3 = 0 OR date_trunc('month', d) = DATE '1997-03-01' GROUP BY table_id) e ON e.table_id = t.table_id"""

QUERIES = {
    f.__name__: f
    for f in (
        file_results, consolidated_months, consolidated_issues, people, rollup_split, month_issue_list, uncovered_days, split_names, submission_state, baseline_sync, file_register,
        canonical_cells, clean_tables, answer_results, larger_reads, trust_weights, ident_keys, recovered_dates,
    )
}
