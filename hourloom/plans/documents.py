"""Queries over grids, text lines, pages, files and OCR output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.functions import text
from hourloom.operators import files, grids, lines, ocr
from hourloom.plans.scalars import hours_of
from hourloom.plans.views import table, view

ORACLE: dict[str, str] = {}



def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_cells")


def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.assign_roles(_cells(spark, sf_dir).where("row_id = -1")).groupBy("role", "col").agg(F.count("*").alias("tables"))


ORACLE["header_roles"] = """SELECT * FROM (VALUES ('date', 0), ('regular', 1), ('overtime', 2), ('note', 3)) r(role, col),
(SELECT count(*) AS tables FROM customer)"""


def header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.header_rows(_cells(spark, sf_dir))


ORACLE["header_row"] = "SELECT c_custkey AS table_id, CAST(-1 AS BIGINT) AS header_row, CAST(6 AS BIGINT) AS score FROM customer"


def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.daily_grid(grids.role_columns(_cells(spark, sf_dir)), F.lit("MDY"), F.lit(2000))


SQL_GRID = f"""SELECT *, coalesce(t0, r0 + coalesce(o0, 0)) AS tt
  FROM (SELECT d.table_id, d.row_id, d.value AS ds, r.h AS r0, o.h AS o0, CAST(NULL AS DOUBLE) AS t0, r.value AS rv, o.value AS ov, n.value AS nv
FROM v_cells d JOIN ({hours_of("v_cells", "table_id, row_id, col, value")}) r ON r.table_id = d.table_id AND r.row_id = d.row_id AND r.col = 1
JOIN ({hours_of("v_cells", "table_id, row_id, col, value")}) o ON o.table_id = d.table_id AND o.row_id = d.row_id AND o.col = 2
JOIN v_cells n ON n.table_id = d.table_id AND n.row_id = d.row_id AND n.col = 3 WHERE d.col = 0 AND d.row_id >= 0)"""
ORACLE["daily_grid"] = f"""SELECT table_id, row_id, CAST(ds AS DATE) AS d, r0 AS regular, coalesce(o0, CASE WHEN r0 IS NOT NULL THEN 0.0 END) AS overtime, tt AS total,
CAST(NULL AS VARCHAR) AS project, nv AS note, CASE WHEN r0 IS NULL AND o0 IS NULL AND tt IS NULL THEN 'UNCLEAR' WHEN tt > 16 THEN 'OUT_OF_RANGE' END AS issue
FROM ({SQL_GRID})"""


def _week_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of v_weekly as cells below a header; a third of the weeks state no hours."""
    rows = view(spark, sf_dir, "v_weekly").selectExpr(
        "emp AS table_id", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS row_id", "CAST(week_end AS STRING) AS a",
        "CASE WHEN l_partkey % 3 = 0 THEN 'off' ELSE CAST(total AS STRING) END AS b",
    )
    cells = rows.selectExpr("table_id", "row_id", "stack(2, 0, a, 1, b) AS (col, value)")
    heads = rows.select("table_id").distinct().selectExpr("table_id", "-1L AS row_id", "stack(2, 0, 'Week Ending', 1, 'Total Hours') AS (col, value)")
    return cells.unionByName(heads)


def weekly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.weekly_totals(grids.role_columns(_week_cells(spark, sf_dir)), F.lit("MDY"), F.lit(2000))


ORACLE["weekly_totals"] = """SELECT emp AS table_id, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS row_id, CAST(week_end - 6 AS DATE) AS week_start,
  week_end,
total AS regular, 0.0 AS overtime, total FROM v_weekly WHERE l_partkey % 3 <> 0"""


def weekday_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One matrix a supplier: a row for each of its line items with hours under one of seven weekday names."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS table_id", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS row_id", "CAST(l_linenumber % 7 AS INT) AS col",
        "CAST(CAST(l_quantity AS INT) AS STRING) AS value",
    )
    tables = rows.select("table_id").distinct()
    names = "stack(7, 0, 'Mon', 1, 'Tuesday', 2, 'Wed', 3, 'thu', 4, 'Fri', 5, 'SAT', 6, 'Sunday') AS (col, value)"
    heads = tables.selectExpr("table_id", "-1L AS row_id", names)
    anchors = tables.selectExpr("table_id", "date_add(DATE '1998-01-05', CAST(table_id % 28 AS INT)) AS anchor", "-1L AS header_row")
    return grids.weekday_matrix(rows.unionByName(heads), anchors)


ORACLE["weekday_matrix"] = """SELECT l_suppkey AS table_id, DATE '1998-01-05' + CAST(l_suppkey % 28 AS INT) + l_linenumber % 7 AS d, round(sum(CAST(l_quantity AS INT)),
  2) AS total
FROM lineitem WHERE CAST(l_quantity AS INT) > 0 GROUP BY 1, 2"""


def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("table_id"),
        F.expr("CASE event_type WHEN 'click' THEN 'daily_grid' WHEN 'view' THEN 'weekly_totals' ELSE 'weekday_matrix' END").alias("method"),
    )
    return grids.best_strategy(results.agg((F.count("*") % 4).alias("found"), F.round(F.max("value") / 500, 1).alias("confidence")))


ORACLE["best_strategy"] = """SELECT table_id, method, found, confidence FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY found DESC, confidence DESC,
  CASE method WHEN 'daily_grid' THEN 0 WHEN 'weekly_totals' THEN 1 ELSE 2 END) AS k FROM (
  SELECT user_id AS table_id, CASE event_type WHEN 'click' THEN 'daily_grid' WHEN 'view' THEN 'weekly_totals' ELSE 'weekday_matrix' END AS method,
    count(*) % 4 AS found, round(max(value) / 500, 1) AS confidence FROM events GROUP BY 1, 2)) WHERE k = 1"""


def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id AS file", "event_id AS seq", "event_type AS method", "CAST(value AS BIGINT) % 3 AS found",
        "CASE WHEN event_id % 3 = 0 THEN floor(value) END AS stated_total", "CAST(event_id % 10 AS DOUBLE) / 10 AS confidence", "event_type = 'error' AS needs_llm",
    )
    return grids.merge_results(rows)


ORACLE["merge_results"] = """SELECT file, CAST(sum(found) AS BIGINT) AS found, string_agg(DISTINCT method, '+'
  ORDER BY method) AS method, arg_max(stated_total, seq) FILTER (stated_total IS NOT NULL) AS stated_total,
round(avg(confidence), 2) AS confidence, bool_or(needs_llm) AND sum(found) = 0 AS needs_llm
  FROM (SELECT user_id AS file, event_id AS seq, event_type AS method, CAST(floor(value) AS BIGINT) % 3 AS found,
CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS stated_total, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, event_type = 'error' AS needs_llm
  FROM events) GROUP BY file"""


def summary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover sheets: one table a customer, its orders as rows of period and total hours; the first of January 1997 counts."""
    rows = view(spark, sf_dir, "v_uploads").selectExpr(
        "user_id AS table_id", "id AS row_id", "stack(2, 0, date_format(created_at, 'MMMM yyyy'), 1, CAST(CAST(total AS INT) AS STRING)) AS (col, value)",
    )
    heads = rows.select("table_id").distinct().selectExpr("table_id", "-1L AS row_id", "stack(2, 0, 'Period', 1, 'Total Hours') AS (col, value)")
    return grids.summary_totals(rows.unionByName(heads), F.lit("1997-01-01").cast("date"))


ORACLE["summary_total"] = """SELECT user_id AS table_id, arg_min(total, id) AS stated_total FROM v_uploads
WHERE (month = 1 OR year = 1997) AND floor(total) > 0 GROUP BY user_id"""


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each customer's sheet within the sheet limits, its rows numbered from the top."""
    nth = F.dense_rank().over(W.partitionBy("table_id").orderBy("row_id")) - 1
    return grids.sheet_rows(_cells(spark, sf_dir).withColumn("row_id", nth))


ORACLE["sheet_lines"] = """SELECT table_id, CAST(k - 1 AS INT) AS row_id, string_agg(coalesce(value, ''), ' | ' ORDER BY col) AS line FROM (
SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY row_id) AS k FROM v_cells) WHERE k <= 400 GROUP BY table_id, k"""


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


ORACLE["html_to_text"] = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages"""


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as marked pages of a file, split again."""
    pages = table(spark, sf_dir, "documents").selectExpr("source AS file", "doc_id AS page", "text")
    return files.split_marked(pages).groupBy("file").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


ORACLE["page_split"] = "SELECT source AS file, count(*) AS pages, CAST(sum(length(trim(text, ' \n\t\r'))) AS BIGINT) AS chars FROM documents WHERE length(trim(text, ' \n\t\r')) > 40 GROUP BY source"


def labelled_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_lines").select(
        "file", (F.col("l_orderkey") * 10_000_000 + F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("line_no"), "line",
    )
    orders = rows.select("file").distinct().select(
        "file", F.when(F.substring("file", 2, 9).cast("int") % 2 == 1, F.lit("DMY")).otherwise(F.lit("MDY")).alias("date_order"),
    )
    got = lines.labelled_hours(rows, orders, F.lit(1998), 50.5)
    return got.select("file", "date", "total", "distinct_values", "unclear")


ORACLE["labelled_hours"] = """SELECT file, date, CASE WHEN count(DISTINCT v) = 1 THEN max(v) END AS total, CAST(count(DISTINCT v) AS INT) AS distinct_values,
  count(DISTINCT v) > 1 AS unclear
FROM (SELECT concat('s', CAST(l_suppkey AS STRING)) AS file, CAST(l_shipdate AS DATE) AS date,
  CAST(l_quantity AS INT) + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0 END AS v FROM lineitem) GROUP BY 1, 2"""


def invoice_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with invoice words put in by the doc_id."""
    body = F.expr(
        "concat(text, CASE doc_id % 6 WHEN 0 THEN ' Invoice # 12 Bill To: X' WHEN 1 THEN ' invoice no 7' WHEN 2 THEN ' rate amount $ 5' WHEN 3 THEN ' amount due' ELSE '' END)",
    )
    name = F.expr("CASE WHEN doc_id % 4 = 0 THEN 'x-inv-12.pdf' ELSE 'sheet.pdf' END")
    return table(spark, sf_dir, "documents").select("doc_id", text.is_invoice(body, name).alias("invoice"))


ORACLE["invoice_filter"] = """SELECT doc_id, (w AND score >= 2) OR (fn AND (w OR score >= 1)) AS invoice
  FROM (SELECT doc_id, contains(t, 'invoice') AS w, doc_id % 4 = 0 AS fn,
CASE WHEN regexp_matches(t, 'invoice\\s*#|invoice\\s*(no|number)\\b') THEN 2 ELSE 0 END + CASE WHEN contains(t, 'bill to') THEN 2 ELSE 0 END
+ CASE WHEN contains(t, 'amount due') OR contains(t, 'total due') OR contains(t, 'balance due') THEN 2 ELSE 0 END
+ CASE WHEN contains(t, 'rate') AND contains(t, 'amount') AND contains(t, '$') THEN 1 ELSE 0 END AS score
FROM (SELECT doc_id, lower(concat(text, CASE doc_id % 6 WHEN 0 THEN ' Invoice # 12 Bill To: X' WHEN 1 THEN ' invoice no 7' WHEN 2 THEN ' rate amount $ 5'
  WHEN 3 THEN ' amount due' ELSE '' END)) AS t FROM documents))""".replace("\\\\", "\\")


def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review digest of each customer's table: its first 60 rows as lines."""
    return grids_digest(_cells(spark, sf_dir), 60)


def grids_digest(cells: DataFrame, rows: int) -> DataFrame:
    by = W.partitionBy("table_id").orderBy("row_id")
    first = cells.select("table_id", "row_id").distinct().withColumn("k", F.row_number().over(by)).where(F.col("k") <= rows)
    own = cells.join(first, ["table_id", "row_id"]).groupBy("table_id", "k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"]), " | ").alias("line"),
    )
    return own.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("digest"))


ORACLE["table_digest"] = """SELECT table_id, string_agg(line, chr(10) ORDER BY row_id) AS digest FROM (SELECT table_id, row_id, string_agg(coalesce(value, ''), ' | '
  ORDER BY col) AS line,
row_number() OVER (PARTITION BY table_id ORDER BY row_id) AS k FROM v_cells GROUP BY table_id, row_id) WHERE k <= 60 GROUP BY table_id"""


def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with the first bytes that such files have; unknown extensions are told by them, zips by their members."""
    member = "CASE file_seq % 9 WHEN 1 THEN 'word/document.xml' WHEN 4 THEN 'xl/workbook.xml' ELSE 'other.txt' END"
    zipped = f"concat(unhex('504B0304140000000800'), to_binary({member}, 'utf-8'), unhex('00FF'))"
    heads = F.expr(
        f"CASE WHEN file_seq % 3 = 0 THEN to_binary('%PDF-1.7', 'utf-8') WHEN file_seq % 3 = 1 THEN {zipped} WHEN file_seq % 9 = 2 THEN unhex('89504E470D0A1A0A') ELSE to_binary('plain', 'utf-8') END",
    )
    return view(spark, sf_dir, "v_paths").select("file_seq", files.kind_of(F.col("path"), heads).alias("kind"))


ORACLE["detect_kind"] = """SELECT p_partkey AS file_seq, CASE p_size % 6 WHEN 0 THEN 'excel' WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'email'
ELSE CASE WHEN p_partkey % 3 = 0 THEN 'pdf' WHEN p_partkey % 9 = 1 THEN 'docx' WHEN p_partkey % 9 = 4 THEN 'excel' WHEN p_partkey % 9 = 2 THEN 'image'
  ELSE 'unknown' END END AS kind FROM part"""


def pdf_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of files; every third file's vowels are unreadable."""
    pages = table(spark, sf_dir, "documents").selectExpr(
        "concat(lang, floor(doc_id / 5)) AS file", "doc_id AS page",
        "CASE WHEN floor(doc_id / 5) % 3 = 0 THEN translate(text, 'aeioustnr', '§¤¬¦¶§¤¬¦') ELSE text END AS text",
    )
    return files.pdf_kind(pages)


ORACLE["pdf_profile"] = r"""SELECT file, pages, chars, CASE WHEN chars > 0
  AND printable / chars < 0.6 THEN 'pdf_scanned' WHEN chars >= 80 * pages THEN 'pdf_native' ELSE 'pdf_scanned' END AS kind
FROM (SELECT concat(lang, CAST(CAST(floor(doc_id / 5) AS BIGINT) AS STRING)) AS file, count(*) AS pages, CAST(sum(length(trim(t, E' \n\t\r'))) AS BIGINT) AS chars,
  CAST(sum(length(regexp_replace(t, '[^\p{L}\p{N}\s.,:/\-$%()]', '', 'g'))) AS DOUBLE) AS printable
  FROM (SELECT lang, doc_id, CASE WHEN CAST(floor(doc_id / 5) AS BIGINT) % 3 = 0 THEN translate(text, 'aeioustnr', '§¤¬¦¶§¤¬¦') ELSE text END AS t FROM documents)
  GROUP BY 1)"""


def client_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_paths").select("file_seq", text.client_from_path(F.col("path")).alias("client"))


ORACLE["client_from_path"] = "SELECT p_partkey AS file_seq, replace(p_brand, '#', ' ') AS client FROM part"


def name_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1)
    return view(spark, sf_dir, "v_paths").select("file_seq", text.name_hint(stem).alias("name"))


ORACLE["name_hint"] = "SELECT p_partkey AS file_seq, trim(replace(replace(p_name, ' ', '_'), '_', ' '), ' -·,') AS name FROM part"


def file_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file seen is processed or rejected: what is neither would show as lost."""
    seen = view(spark, sf_dir, "v_paths").select("path", "file_seq")
    got = seen.where(~F.col("path").endswith(".bin")).select("path")
    gone = seen.where(F.col("path").endswith(".bin")).select("path", F.lit("unknown format").alias("reason"))
    return files.reconcile(seen.select("path"), got, gone).groupBy("status").agg(F.count("*").alias("files"))


ORACLE["file_reconcile"] = "SELECT CASE WHEN p_size % 6 = 5 THEN 'rejected' ELSE 'processed' END AS status, count(DISTINCT path) AS files FROM v_paths JOIN part ON p_partkey = file_seq GROUP BY 1"


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.word_lines(view(spark, sf_dir, "v_words"), "file", "line", tie="l_suppkey")


ORACLE["ocr_lines"] = """SELECT file, line, string_agg(text, ' ' ORDER BY left_px, l_suppkey) AS text, round(avg(conf), 1) AS confidence FROM v_words WHERE conf >= 0 GROUP BY file, line"""


def ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.box_rows(view(spark, sf_dir, "v_boxes").withColumn("seq", F.col("l_orderkey") * 100 + F.col("l_linenumber")))


ORACLE["ocr_rows"] = """SELECT file, row_no, string_agg(text, '  ' ORDER BY x, seq) AS text, round(avg(score) * 100, 1) AS confidence FROM (
SELECT *, CAST(sum(CASE WHEN prev IS NULL OR y - prev <= tol THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY y, x, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_no
  FROM (
  SELECT b.*, l_orderkey * 100 + l_linenumber AS seq, lag(y) OVER (PARTITION BY b.file ORDER BY y, x, l_orderkey * 100 + l_linenumber) AS prev, tol FROM v_boxes b
  JOIN (SELECT file, 0.6 * list_sort(list(h))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS tol FROM v_boxes GROUP BY file) t ON t.file = b.file)) GROUP BY file, row_no"""

QUERIES = {
    f.__name__: f
    for f in (
        header_roles, header_row, daily_grid, weekly_totals, weekday_matrix, best_strategy, merge_results, summary_total, sheet_lines, html_to_text, page_split, labelled_hours,
        invoice_filter, table_digest, detect_kind, pdf_profile, client_from_path, name_hint, file_reconcile, ocr_lines, ocr_rows,
    )
}
