"""Queries of the consolidated records: days, weeks, months, issues, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators import calendar, days, weekly
from hourloom.plans.scalars import SQL_HOLIDAYS
from hourloom.plans.views import view

ORACLE: dict[str, str] = {}
HOLIDAYS = SQL_HOLIDAYS.replace("SELECT DISTINCT year AS y FROM v_uploads", "SELECT DISTINCT CAST(year(d) AS INT) AS y FROM v_entries")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_entries with hours above eight as overtime, a client that some entries lack, and where each was read."""
    seq, sheet = F.col("seq"), F.when(F.col("seq") % 3 == 0, F.lit("S1"))
    at = days.source(
        F.concat(F.lit("f"), (seq % 5).cast("string")), F.col("extractor"), sheet=sheet, page=F.when(seq % 3 == 1, seq % 4), row=seq,
        cell=F.when(seq % 7 == 0, F.lit("B2")), region=F.when(seq % 11 == 0, F.lit("top")),
    )
    return view(spark, sf_dir, "v_entries").select(
        "*", F.least("total", F.lit(8.0)).alias("regular"), F.greatest(F.col("total") - 8, F.lit(0.0)).alias("overtime"),
        F.when(F.col("extractor") != "error", F.col("extractor")).alias("client"), F.when(F.col("emp") % 4 > 0, F.concat(F.lit("p"), F.col("emp") % 3)).alias("project"), at.alias("source"),
    )


SQL_DAYS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emp, d ORDER BY trust DESC, seq) AS k, count(*) OVER (PARTITION BY emp, d) AS n,
    least(total, 8.0) AS regular, greatest(total - 8, 0.0) AS overtime, CASE WHEN extractor <> 'error' THEN extractor END AS client,
    CASE WHEN emp % 4 > 0 THEN concat('p', emp % 3) END AS project FROM v_entries) WHERE k = 1"""
#: The label of an entry's source, and of all of a day's.
SQL_LABEL = """concat('f', seq % 5, CASE WHEN seq % 3 = 0 THEN ' · sheet=S1' ELSE '' END, CASE WHEN seq % 3 = 1 THEN concat(' · p', seq % 4) ELSE '' END,
  CASE WHEN seq % 7 = 0 THEN ' · B2' ELSE concat(' · row', seq) END, CASE WHEN seq % 11 = 0 THEN ' · @top' ELSE '' END)"""
SQL_DAY_SOURCES = f"SELECT emp, d, string_agg({SQL_LABEL}, '; ' ORDER BY seq) AS sources FROM v_entries GROUP BY emp, d"
SQL_DISTINCT = "SELECT emp, d, count(DISTINCT round(total, 2)) AS distinct_totals, count(*) AS n FROM v_entries GROUP BY emp, d"


def _calendar(spark: SparkSession, rows: DataFrame) -> DataFrame:
    years = rows.select(F.year("d").alias("year"))
    return calendar.calendar_days(rows.select(F.trunc("d", "MM").alias("period")), calendar.us_holidays(years))


SQL_CALENDAR = f"""SELECT c.period, c.date, isodow(c.date) >= 6 AS is_weekend, h.name IS NOT NULL AS is_holiday
FROM (SELECT period, CAST(unnest(generate_series(period, last_day(period), INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS period FROM v_entries)) c LEFT JOIN ({HOLIDAYS}) h ON c.date = h.date"""
SQL_ACTIVE = f"SELECT a.emp, c.* FROM (SELECT DISTINCT emp, CAST(date_trunc('month', d) AS DATE) AS period FROM v_entries) a JOIN ({SQL_CALENDAR}) c ON a.period = c.period"


def resolve_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = days.resolve_days(entries(spark, sf_dir))
    sources = F.array_join(F.transform("sources", lambda s: s["seq"].cast("string")), ",")
    return got.select("emp", "d", "seq", "extractor", "regular", "overtime", "total", "n", "distinct_totals", sources.alias("sources"))


ORACLE["resolve_day"] = f"""SELECT a.emp, a.d, seq, extractor, regular, overtime, total, a.n, distinct_totals, sources
FROM ({SQL_DAYS}) a JOIN (SELECT emp, d, count(DISTINCT round(total, 2)) AS distinct_totals, string_agg(CAST(seq AS STRING), ',' ORDER BY seq) AS sources FROM v_entries
  GROUP BY emp, d) b
ON a.emp = b.emp AND a.d = b.d"""


def day_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.duplicates(days.resolve_days(entries(spark, sf_dir)))


SQL_CONFLICTS = f"""SELECT emp, d, CASE WHEN distinct_totals > 1 THEN 'CONFLICT' ELSE 'DUPLICATE' END AS code, CASE WHEN distinct_totals > 1 THEN 'error'
  ELSE 'info' END AS severity
FROM ({SQL_DISTINCT}) WHERE n > 1"""
ORACLE["day_conflicts"] = SQL_CONFLICTS


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return days.missing_days(rows.where(days.has_hours()), _calendar(spark, rows))


SQL_MISSING = f"""SELECT emp, period, date AS d FROM ({SQL_ACTIVE}) x WHERE NOT is_weekend AND NOT is_holiday
AND NOT EXISTS (SELECT 1 FROM v_entries e WHERE e.emp = x.emp AND e.d = x.date)"""
ORACLE["missing_days"] = SQL_MISSING


def employee_month_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.month_totals(days.resolve_days(entries(spark, sf_dir))).orderBy(F.desc("total"), "emp")


SQL_MONTHS = f"""SELECT emp, CAST(date_trunc('month', d) AS DATE) AS period, round(sum(regular), 2) AS regular, round(sum(overtime), 2) AS overtime, round(sum(total),
  2) AS total,
CAST(count(*) FILTER (total > 0) AS BIGINT) AS days_worked FROM ({SQL_DAYS}) GROUP BY 1, 2"""
ORACLE["employee_month_daily"] = SQL_MONTHS


def client_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.client_breakdown(days.resolve_days(entries(spark, sf_dir), "client", "project"), "client", "project")


ORACLE["client_breakdown"] = f"""SELECT emp, client, project, round(sum(regular), 2) AS regular, round(sum(overtime), 2) AS overtime, round(sum(total), 2) AS total,
CAST(count(*) FILTER (total > 0) AS BIGINT) AS days_worked FROM (
  SELECT a.emp, coalesce(a.client, f.first_client) AS client, project, regular, overtime, total FROM ({SQL_DAYS}) a
  LEFT JOIN (SELECT emp, arg_min(client, seq) AS first_client FROM ({SQL_DAYS}) WHERE client IS NOT NULL GROUP BY emp) f ON a.emp = f.emp) GROUP BY 1, 2, 3"""


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days.ordered_distinct(view(spark, sf_dir, "v_entries"), "emp", "extractor", "seq").select("emp", F.array_join("items", ",").alias("items"))


ORACLE["ordered_distinct"] = """SELECT emp, string_agg(extractor, ',' ORDER BY first_seq) AS items FROM (SELECT emp, extractor, min(seq) AS first_seq FROM v_entries GROUP BY emp, extractor) GROUP BY emp"""


def _issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = entries(spark, sf_dir)
    found, cal = days.resolve_days(rows), _calendar(spark, rows)
    return days.day_issues(rows, found, cal), found, cal


def issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _issues(spark, sf_dir)[0]
    return found.withColumn("sources", days.labels(F.col("sources"))).orderBy(days.severity_rank(), "date", "emp")


SQL_ISSUES = f"""SELECT emp, CAST(date_trunc('month', date) AS DATE) AS period, scope, date, code, severity, message, sources FROM (
SELECT emp, d AS date, 'entry' AS scope, 'OUT_OF_RANGE' AS code, 'warning' AS severity, concat(CAST(total AS STRING), 'h exceeds the day''s bound') AS message,
  {SQL_LABEL} AS sources FROM v_entries WHERE total > 16
UNION ALL SELECT emp, d, 'day', 'OUT_OF_RANGE', 'warning', concat(CAST(total AS STRING), 'h exceeds the day''s bound'), sources FROM ({SQL_DAYS})
  JOIN ({SQL_DAY_SOURCES}) USING (emp, d) WHERE total > 16
UNION ALL SELECT a.emp, a.d, 'day', 'OUT_OF_RANGE', 'info', CASE WHEN c.is_holiday THEN 'hours on a holiday' ELSE 'hours on a weekend' END, sources
  FROM ({SQL_DAYS}) a JOIN ({SQL_DAY_SOURCES}) s ON s.emp = a.emp AND s.d = a.d JOIN ({SQL_CALENDAR}) c ON a.d = c.date WHERE (c.is_weekend OR c.is_holiday)
  AND a.total > 0
UNION ALL SELECT emp, d, 'day', code, severity, 'several sources', sources FROM ({SQL_CONFLICTS}) JOIN ({SQL_DAY_SOURCES}) USING (emp, d)
UNION ALL SELECT emp, d, 'day', 'TOTAL_MISMATCH', 'warning', 'regular and overtime are not the total', sources FROM ({SQL_DAYS}) JOIN ({SQL_DAY_SOURCES}) USING (emp, d)
  WHERE abs(regular + overtime - total) > 0.05
UNION ALL SELECT emp, d, 'day', 'MISSING', 'info', 'no data for a working day', sources FROM ({SQL_MISSING}) JOIN (
  SELECT emp, CAST(date_trunc('month', d) AS DATE) AS period, string_agg(DISTINCT concat('f', seq % 5), '; ' ORDER BY concat('f', seq % 5)) AS sources FROM v_entries
  GROUP BY 1, 2) USING (emp, period))"""
ORACLE["issue_list"] = SQL_ISSUES


def day_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, found, cal = _issues(spark, sf_dir)
    return days.day_status(found, cal, issues)


ORACLE["day_status"] = f"""SELECT x.emp, x.date AS d, is_weekend, is_holiday, NOT is_weekend AND NOT is_holiday AND a.total IS NULL AS missing,
coalesce(a.overtime, 0) > 0 AS overtime, i.emp IS NOT NULL AS flagged
FROM ({SQL_ACTIVE}) x LEFT JOIN ({SQL_DAYS}) a ON a.emp = x.emp AND a.d = x.date
LEFT JOIN (SELECT DISTINCT emp, date FROM ({SQL_ISSUES}) WHERE severity <> 'info') i ON i.emp = x.emp AND i.date = x.date"""


def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, found, _ = _issues(spark, sf_dir)
    return days.report_stats(days.month_totals(found), found, issues)


ORACLE["report_stats"] = f"""SELECT * FROM (SELECT count(DISTINCT emp) AS employees, count(*) AS employee_months, round(sum(total), 2) AS total_hours,
  CAST(sum(days_worked) AS BIGINT) AS worked_days FROM ({SQL_MONTHS})),
(SELECT count(*) AS issues, count(DISTINCT CASE WHEN severity = 'error' THEN emp END) AS employees_with_errors FROM ({SQL_ISSUES}))"""


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)[0].groupBy("emp", "code").agg(F.count("*").alias("issues"))


ORACLE["issue_counts"] = f"SELECT emp, code, count(*) AS issues FROM ({SQL_ISSUES}) GROUP BY emp, code"


def conflict_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per employee, a line for each conflicting day with its total and sources, by date."""
    found = days.resolve_days(entries(spark, sf_dir)).where("n > 1 and distinct_totals > 1")
    line = F.concat_ws(
        " ", F.concat(F.col("d").cast("string"), F.lit(":")), F.concat(F.lit("total="), F.col("total").cast("long")),
        F.concat(F.lit("sources="), F.array_join(F.transform("sources", lambda s: s["extractor"]), "+")),
    )
    return found.groupBy("emp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", line.alias("line")))), lambda x: x["line"]), "; ").alias("digest"))


ORACLE["conflict_digest"] = f"""SELECT a.emp, string_agg(concat(CAST(a.d AS STRING), ': total=', CAST(CAST(total AS BIGINT) AS STRING), ' sources=', src), '; '
  ORDER BY a.d) AS digest
FROM ({SQL_DAYS}) a JOIN (SELECT emp, d, count(DISTINCT round(total, 2)) AS k2, count(*) AS n2, string_agg(extractor, '+' ORDER BY seq) AS src FROM v_entries
  GROUP BY emp, d) b
ON a.emp = b.emp AND a.d = b.d WHERE n2 > 1 AND k2 > 1 GROUP BY a.emp"""


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    rows = view(spark, sf_dir, "v_weekly")
    return rows.withColumn("seq", F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).withColumn("order", order)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_daily")
    return rows.groupBy("emp", "d").agg(F.min_by("total", F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("total"))


SQL_WEEKS = """SELECT emp, week_start, week_end, total, seq, n, CASE WHEN n > 1 AND dt > 1 THEN 'CONFLICT' WHEN n > 1 THEN 'DUPLICATE' END AS code FROM (
SELECT *, row_number() OVER (PARTITION BY emp, week_start, week_end ORDER BY total DESC, seq) AS k, count(*) OVER (PARTITION BY emp, week_start, week_end) AS n
FROM (SELECT *, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq FROM v_weekly))
JOIN (SELECT emp, week_start, week_end, count(DISTINCT round(total, 2)) AS dt FROM v_weekly GROUP BY ALL) USING (emp, week_start, week_end) WHERE k = 1"""
SQL_DAILY = "SELECT emp, d, arg_min(total, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey) AS total FROM v_daily GROUP BY emp, d"
SQL_OWNED = f"""SELECT emp, d, week_start, week_end, total, span FROM (SELECT *, row_number() OVER (PARTITION BY emp, d ORDER BY week_start, seq) AS k FROM (
  SELECT emp, week_start, week_end, total, seq, 7 AS span, CAST(unnest(generate_series(week_start, week_end, INTERVAL 1 DAY)) AS DATE) AS d FROM ({SQL_WEEKS})) w
  WHERE NOT EXISTS (SELECT 1 FROM v_daily v WHERE v.emp = w.emp AND v.d = w.d)) WHERE k = 1"""
SQL_ROLLUP = f"""SELECT emp, period, round(sum(total), 2) AS total, CAST(sum(dw) AS BIGINT) AS days_worked FROM (
  SELECT emp, period, part AS total, round_even(part / 8, 0) AS dw FROM (SELECT emp, period, any_value(total) * count(*) / 7 AS part
    FROM (SELECT *, CAST(date_trunc('month', d) AS DATE) AS period FROM ({SQL_OWNED})) GROUP BY emp, week_start, week_end, period)
  UNION ALL SELECT emp, CAST(date_trunc('month', d) AS DATE), total, CASE WHEN total > 0 THEN 1 ELSE 0 END FROM ({SQL_DAILY})) GROUP BY emp, period"""


def weekly_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.dedupe(_weeks(spark, sf_dir))


ORACLE["weekly_dedupe"] = SQL_WEEKS


def weekly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.coverage(weekly.dedupe(_weeks(spark, sf_dir)), _daily(spark, sf_dir)).groupBy("emp", "week_start", "week_end").agg(
        F.count("*").alias("owned_days"), F.min("d").alias("first_day"),
    )


ORACLE["weekly_coverage"] = f"SELECT emp, week_start, week_end, count(*) AS owned_days, min(d) AS first_day FROM ({SQL_OWNED}) GROUP BY emp, week_start, week_end"


def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly.rollup(weekly.dedupe(_weeks(spark, sf_dir)), _daily(spark, sf_dir))


ORACLE["monthly_rollup"] = SQL_ROLLUP


def stated_total_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _weeks(spark, sf_dir).groupBy("emp", F.trunc("week_start", "MM").alias("period")).agg(F.sum("total").alias("stated"))
    return weekly.stated_mismatch(monthly_rollup(spark, sf_dir), stated)


ORACLE["stated_total_mismatch"] = f"""SELECT r.emp, r.period, total, stated FROM ({SQL_ROLLUP}) r
  JOIN (SELECT emp, CAST(date_trunc('month', week_start) AS DATE) AS period, sum(total) AS stated FROM v_weekly GROUP BY 1, 2) s
ON r.emp = s.emp AND r.period = s.period WHERE abs(stated - total) > 0.5"""


def stated_only_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = view(spark, sf_dir, "v_uploads").groupBy(F.col("user_id").alias("emp"), F.expr("make_date(year, month, 1)").alias("period")).agg(F.max("total").alias("stated"))
    return weekly.stated_only(days.month_totals(days.resolve_days(entries(spark, sf_dir))), stated)


ORACLE["stated_only_months"] = """SELECT emp, period, stated AS regular, stated AS total, CAST(round_even(stated / 8, 0) AS BIGINT) AS days_worked
FROM (SELECT user_id AS emp, make_date(year, month, 1) AS period, max(total) AS stated FROM v_uploads GROUP BY 1, 2) s
WHERE NOT EXISTS (SELECT 1 FROM v_entries e WHERE e.emp = s.emp AND CAST(date_trunc('month', e.d) AS DATE) = s.period)"""

QUERIES = {
    f.__name__: f
    for f in (
        resolve_day, day_conflicts, missing_days, employee_month_daily, client_breakdown, ordered_distinct, issue_list, day_status, report_stats,
        issue_counts, conflict_digest, weekly_dedupe, weekly_coverage, monthly_rollup, stated_total_mismatch, stated_only_months,
    )
}
