"""Queries of the scalar rules: hours, dates, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import dates, hours
from hourloom.operators import calendar, lines
from hourloom.plans.views import view

ORACLE: dict[str, str] = {}

#: SQL of hours in a text column `value`, as the Spark rule has it.
SQL_HOURS = r"""CASE WHEN s IN ('', '-', '--', 'n/a', 'na', 'off', 'none') THEN NULL
     WHEN regexp_matches(t, '^[0-9]{1,3}[:\s][0-9]{2}$') AND CAST(regexp_extract(t, '[:\s]([0-9]{2})$', 1) AS INT) < 60
       THEN CAST(regexp_extract(t, '^([0-9]{1,3})', 1) AS INT) + CAST(regexp_extract(t, '[:\s]([0-9]{2})$', 1) AS INT) / 60.0
     WHEN regexp_matches(replace(t, ',', '.'), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') AND CAST(replace(t, ',', '.') AS DOUBLE) >= 0
       THEN CAST(replace(t, ',', '.') AS DOUBLE) END"""


def hours_of(source: str, keys: str, column: str = "value") -> str:
    """A query of keys and `h`, the hours of a column of a source."""
    return rf"""SELECT {keys}, {SQL_HOURS} AS h FROM (
      SELECT *, trim(replace(trim(replace(replace(replace(replace(s, 'hrs', ''), 'hours', ''), 'hour', ''), 'h', '')), '$', '')) AS t
      FROM (SELECT *, lower(trim({column})) AS s FROM {source}))"""


def parse_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_hours").select("seq", "value", F.round(hours.parse_hours(F.col("value")), 6).alias("hours"))


ORACLE["parse_hours"] = f"SELECT seq, value, round(h, 6) AS hours FROM ({hours_of('v_hours', 'seq, value')})"


def parse_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_clock").select("seq", hours.parse_clock(F.col("time_in")).alias("in_s"), hours.parse_clock(F.col("time_out")).alias("out_s"))


SQL_CLOCK = """SELECT *, CASE WHEN ih = 12 AND time_in LIKE '%AM' THEN 0 ELSE ih END * 3600 + im * 60 AS in_s, oh * 3600 + om * 60 AS out_s
FROM (SELECT *, CAST(split_part(time_in, ':', 1) AS INT) AS ih, CAST(regexp_extract(time_in, ':([0-9]{2})', 1) AS INT) AS im,
      CAST(split_part(time_out, ':', 1) AS INT) AS oh, CAST(split_part(time_out, ':', 2) AS INT) AS om FROM v_clock)"""
ORACLE["parse_clock"] = f"SELECT seq, in_s, out_s FROM ({SQL_CLOCK})"


def in_out_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_clock").select(
        "seq", "emp", "lunch_minutes", hours.parse_clock(F.col("time_in")).alias("in_s"), hours.parse_clock(F.col("time_out")).alias("out_s"),
    )
    return rows.select("seq", "emp", hours.hours_between(F.col("in_s"), F.col("out_s"), F.col("lunch_minutes")).alias("hours"))


ORACLE["in_out_hours"] = f"""SELECT seq, emp, CASE WHEN a = 0 AND b = 0 THEN 0.0 WHEN w BETWEEN 0 AND 24 THEN round(w, 2) END AS hours
FROM (SELECT *, CASE WHEN b > a THEN b WHEN b + 12 > a THEN b + 12 ELSE b + 24 END - a - lunch_minutes / 60.0 AS w
      FROM (SELECT *, in_s / 3600.0 AS a, out_s / 3600.0 AS b FROM ({SQL_CLOCK})))"""


def split_rot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_weekly").select(
        "l_orderkey", "l_linenumber", "l_partkey", "emp", "week_start",
        F.expr("CASE WHEN l_orderkey % 3 <> 0 THEN total END").alias("t"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN total - 1.5 END").alias("r"),
        F.expr("CASE WHEN l_partkey % 3 = 1 THEN 1.5 END").alias("o"),
    )
    r, o, t = hours.split_hours(F.col("t"), F.col("r"), F.col("o"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "emp", "week_start", r.alias("regular"), o.alias("overtime"), t.alias("total"))


ORACLE["split_rot"] = """SELECT l_orderkey, l_linenumber, l_partkey, emp, week_start, r2 AS regular,
  coalesce(o, CASE WHEN abs(round(t2 - r2, 2)) < 1e-6 THEN 0.0 ELSE round(t2 - r2, 2) END) AS overtime, t2 AS total
FROM (SELECT *, coalesce(r, t2 - coalesce(o, 0)) AS r2 FROM (SELECT *, coalesce(t, r + coalesce(o, 0)) AS t2 FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, emp, week_start, CASE WHEN l_orderkey % 3 <> 0 THEN total END AS t,
    CASE WHEN l_linenumber % 2 = 0 THEN total - 1.5 END AS r, CASE WHEN l_partkey % 3 = 1 THEN 1.5 END AS o FROM v_weekly)))"""


def norm_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, base = F.expr("CASE WHEN id % 5 = 0 THEN 1900 + CAST(id % 150 AS INT) ELSE CAST(id % 100 AS INT) END"), F.expr("year + CAST(user_id % 60 AS INT) - 30")
    return view(spark, sf_dir, "v_uploads").select("id", y.alias("y"), base.alias("base"), dates.full_year(y, base).alias("full_year"))


ORACLE["norm_year"] = """SELECT id, y, base, CASE WHEN y >= 100 THEN y ELSE
  CASE WHEN abs(1900 + y - base) <= abs(2000 + y - base) AND abs(1900 + y - base) <= abs(2100 + y - base) THEN 1900 + y
       WHEN abs(2000 + y - base) <= abs(2100 + y - base) THEN 2000 + y ELSE 2100 + y END END AS full_year
FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 1900 + CAST(id % 150 AS INT) ELSE CAST(id % 100 AS INT) END AS y,
      year + CAST(user_id % 60 AS INT) - 30 AS base FROM v_uploads)"""


def rescue_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_uploads").select(
        "id", F.expr("make_date(year, month, 1)").alias("period"), F.expr("DATE '1900-01-01' + CAST(id % 60 AS INT)").alias("d"),
    )
    return rows.select("id", "d", "period", dates.rescue_epoch(F.col("d"), F.col("period")).alias("rescued"))


ORACLE["rescue_epoch"] = """SELECT id, d, period, CASE WHEN year(d) < 1990 AND day(d) <= day(last_day(period)) THEN period + CAST(day(d) - 1 AS INT) END AS rescued
FROM (SELECT id, make_date(year, month, 1) AS period, DATE '1900-01-01' + CAST(id % 60 AS INT) AS d FROM v_uploads)"""


def week_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.trunc("week_start", "MM")
    got = F.round(dates.week_overlap(F.col("week_end"), F.col("week_start"), period), 3)
    return view(spark, sf_dir, "v_weekly").select("emp", "l_orderkey", "l_linenumber", "l_partkey", "week_start", "week_end", got.alias("fraction"))


ORACLE["week_overlap"] = """SELECT emp, l_orderkey, l_linenumber, l_partkey, week_start, week_end,
  round((least(week_end, last_day(week_start)) - week_start + 1) / 7.0, 3) AS fraction FROM v_weekly"""


def date_order_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.date_orders(view(spark, sf_dir, "v_lines").select("file", F.col("line").alias("text")), F.lit("1998-01-01").cast("date"))


ORACLE["date_order_vote"] = r"""SELECT file, CASE WHEN a12 > 0 AND b12 = 0 THEN 'DMY' WHEN b12 > 0
  AND a12 = 0 THEN 'MDY' WHEN dmy > mdy THEN 'DMY' ELSE 'MDY' END AS date_order
FROM (SELECT file, count(*) FILTER (a > 12 AND a <= 31) AS a12, count(*) FILTER (b > 12 AND a <= 31) AS b12, count(*) FILTER (b = 1 AND a <= 31) AS dmy,
  count(*) FILTER (a = 1) AS mdy
  FROM (SELECT file, CAST(split_part(tok, '/', 1) AS INT) AS a, CAST(split_part(tok, '/', 2) AS INT) AS b, CAST(split_part(tok, '/', 3) AS INT) AS c
        FROM (SELECT file, regexp_extract(line, '[0-9]+/[0-9]+/[0-9]+') AS tok FROM v_lines)) GROUP BY file)"""


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven written forms of the order dates, each read back."""
    forms = """CASE o_orderkey % 7 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'd-MMM-yy')
      WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'd/M/yyyy') WHEN 4 THEN date_format(o_orderdate, 'dd.MM.yy')
      WHEN 5 THEN concat(date_format(o_orderdate, 'dd MMM yyyy'), ' ') ELSE 'not a date' END"""
    rows = view(spark, sf_dir, "v_uploads").select("id", F.col("created_at").alias("o_orderdate"), F.col("id").alias("o_orderkey"))
    return rows.select("id", dates.parse_date(F.expr(forms), F.lit("DMY"), F.lit(2000)).alias("date"))


ORACLE["parse_date"] = "SELECT id, CASE WHEN id % 7 = 6 THEN NULL ELSE CAST(created_at AS DATE) END AS date FROM v_uploads"


def month_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("is_dmy") == 1, F.lit("DMY")).otherwise(F.lit("MDY"))
    d = dates.parse_date(F.regexp_extract("line", dates.NUMERIC, 0), order, F.lit(1998))
    rows = view(spark, sf_dir, "v_lines").select("file", "l_orderkey", "l_linenumber", "l_partkey", d.alias("date"))
    return rows.where(F.trunc("date", "MM") == F.lit("1998-03-01").cast("date"))


ORACLE["month_filter"] = """SELECT concat('s', CAST(l_suppkey AS STRING)) AS file, l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS date
FROM lineitem WHERE date_trunc('month', l_shipdate) = DATE '1998-03-01'"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_uploads").select("year").distinct()


def us_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.us_holidays(_years(spark, sf_dir))


SQL_HOLIDAYS = """SELECT CAST(year(date) AS INT) AS year, date, name FROM (
SELECT make_date(y, m, dd) AS date, name FROM (SELECT DISTINCT year AS y FROM v_uploads), (VALUES ('New Year''s Day', 1, 1), ('Juneteenth', 6, 19),
  ('Independence Day', 7, 4), ('Veterans Day', 11, 11), ('Christmas Day', 12, 25)) f(name, m, dd)
UNION ALL
SELECT date, name FROM (SELECT name, date, n, row_number() OVER (PARTITION BY name, year(date) ORDER BY date) AS k,
    count(*) OVER (PARTITION BY name, year(date)) AS last FROM (
  SELECT name, n, CAST(g AS DATE) AS date FROM (SELECT DISTINCT year AS y FROM v_uploads),
    (VALUES ('Martin Luther King Jr. Day', 1, 1, 3), ('Presidents'' Day', 2, 1, 3), ('Memorial Day', 5, 1, -1), ('Labor Day', 9, 1, 1),
            ('Columbus Day', 10, 1, 2), ('Thanksgiving Day', 11, 4, 4)) f(name, m, wd, n),
    LATERAL (SELECT unnest(generate_series(make_date(y, m, 1), last_day(make_date(y, m, 1)), INTERVAL 1 DAY)) AS g)
  WHERE isodow(g) = wd)) WHERE k = n OR (n = -1 AND k = last))"""
ORACLE["us_holidays"] = SQL_HOLIDAYS


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = view(spark, sf_dir, "v_uploads").select(F.expr("make_date(year, month, 1)").alias("period"))
    return calendar.calendar_days(periods, calendar.us_holidays(_years(spark, sf_dir)))


ORACLE["calendar_days"] = f"""SELECT period, d.date, dayname(d.date) AS weekday, isodow(d.date) >= 6 AS is_weekend, h.name IS NOT NULL AS is_holiday,
  h.name AS holiday_name
FROM (SELECT period, CAST(unnest(generate_series(period, last_day(period), INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT DISTINCT make_date(year, month, 1) AS period FROM v_uploads)) d LEFT JOIN ({SQL_HOLIDAYS}) h ON d.date = h.date"""


def default_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("created_at").cast("date")
    period = dates.default_period(d)
    return view(spark, sf_dir, "v_uploads").select("id", period.alias("period"), dates.period_label(period).alias("label"))


ORACLE["default_period"] = """SELECT id, period, strftime(period, '%B %Y') AS label FROM (
  SELECT id, CAST(date_trunc('month', CASE WHEN day(created_at) <= 10 THEN created_at - INTERVAL 1 MONTH ELSE created_at END) AS DATE) AS period FROM v_uploads)"""


def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.month_grid(view(spark, sf_dir, "v_uploads").select(F.expr("make_date(year, month, 1)").alias("period")).distinct())


ORACLE["month_grid"] = """SELECT period, CAST(day(last_day(period)) AS INT) AS days, CAST(dayofweek(period) AS INT) AS first_weekday
FROM (SELECT DISTINCT make_date(year, month, 1) AS period FROM v_uploads)"""

QUERIES = {f.__name__: f for f in (parse_hours, parse_clock, in_out_hours, split_rot, norm_year, rescue_epoch, week_overlap, date_order_vote, parse_date, month_filter, us_holidays, calendar_days, default_period, month_grid)}
