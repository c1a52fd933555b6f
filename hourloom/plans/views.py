"""Domain tables read from the driver's tables by projections that Spark and other engines run alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "benchmark", "embeddings")

VIEWS = {
    "v_entries": """SELECT event_id AS seq, user_id AS emp, CAST(ts AS DATE) AS d, event_type AS extractor,
       CAST(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 2.8 WHEN 'view' THEN 2.0
                            WHEN 'click' THEN 1.2 ELSE 1.5 END AS DOUBLE) AS trust,
       CAST(floor(value / 40) * 2 AS DOUBLE) AS total
FROM events""",
    "v_weekly": """SELECT l_suppkey AS emp, CAST(date_trunc('week', l_shipdate) AS DATE) + l_linenumber % 3 AS week_start,
       CAST(date_trunc('week', l_shipdate) AS DATE) + l_linenumber % 3 + 6 AS week_end,
       l_quantity AS total, l_orderkey, l_linenumber, l_partkey
FROM lineitem
WHERE l_returnflag <> 'R'""",
    "v_daily": """SELECT l_suppkey AS emp, CAST(l_shipdate AS DATE) AS d, CAST(floor(l_quantity / 5) AS DOUBLE) AS total,
       l_orderkey, l_linenumber, l_partkey
FROM lineitem
WHERE l_returnflag = 'R'""",
    "v_lines": """SELECT concat('s', CAST(l_suppkey AS STRING)) AS file, l_suppkey % 2 AS is_dmy, l_orderkey, l_linenumber, l_partkey,
       concat(CASE WHEN l_suppkey % 2 = 1
                   THEN concat(CAST(day(l_shipdate) AS STRING), '/', CAST(month(l_shipdate) AS STRING))
                   ELSE concat(CAST(month(l_shipdate) AS STRING), '/', CAST(day(l_shipdate) AS STRING)) END,
              '/', CAST(year(l_shipdate) AS STRING), '  ',
              CASE WHEN l_linenumber % 2 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.50')
                   ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), ' regular') END) AS line
FROM lineitem""",
    "v_clock": """SELECT o_orderkey AS seq, o_custkey AS emp,
       concat(CAST(o_orderkey % 12 + 1 AS STRING), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'),
              CASE WHEN o_orderkey % 3 = 0 THEN ' AM' ELSE '' END) AS time_in,
       concat(CAST(o_custkey % 24 AS STRING), ':', lpad(CAST(o_custkey % 4 * 15 AS STRING), 2, '0')) AS time_out,
       CAST(o_orderkey % 3 * 30 AS DOUBLE) AS lunch_minutes
FROM orders""",
    "v_hours": """SELECT o_orderkey AS seq,
       CASE o_orderkey % 12
         WHEN 0 THEN concat(CAST(o_custkey % 24 AS STRING), ':', lpad(CAST(o_orderkey % 75 AS STRING), 2, '0'))
         WHEN 1 THEN concat(CAST(o_custkey % 14 AS STRING), ' hrs') WHEN 2 THEN concat(CAST(o_custkey % 14 AS STRING), ',5')
         WHEN 3 THEN 'N/A' WHEN 4 THEN concat('$', CAST(o_custkey % 14 AS STRING)) WHEN 5 THEN '  off '
         WHEN 6 THEN concat(CAST(o_custkey % 14 AS STRING), 'd') WHEN 7 THEN concat('-', CAST(o_custkey % 14 AS STRING))
         WHEN 8 THEN concat(CAST(o_custkey % 14 AS STRING), ' 30') WHEN 9 THEN concat(CAST(o_custkey % 14 AS STRING), '.25 Hours')
         WHEN 10 THEN NULL ELSE CAST(o_custkey % 14 AS STRING) END AS value
FROM orders""",
    "v_cells": """SELECT o_custkey AS table_id, o_orderkey AS row_id, 0 AS col, CAST(CAST(o_orderdate AS DATE) AS STRING) AS value FROM orders
UNION ALL
SELECT o_custkey, o_orderkey, 1, CASE WHEN o_orderkey % 5 = 0 THEN 'off' ELSE CAST(o_orderkey % 9 AS STRING) END FROM orders
UNION ALL
SELECT o_custkey, o_orderkey, 2, CASE WHEN o_orderkey % 4 = 0 THEN '1:30' ELSE '' END FROM orders
UNION ALL
SELECT o_custkey, o_orderkey, 3, o_orderpriority FROM orders
UNION ALL
SELECT c_custkey, -1, 0, CASE WHEN c_custkey % 2 = 0 THEN 'Date' ELSE 'Work date' END FROM customer
UNION ALL
SELECT c_custkey, -1, 1, 'Number of Regular Hours' FROM customer
UNION ALL
SELECT c_custkey, -1, 2, 'Number of Overtime Hours' FROM customer
UNION ALL
SELECT c_custkey, -1, 3, 'Notes' FROM customer""",
    "v_results": """SELECT user_id % 30 AS ident, user_id AS file_seq, event_id AS entry_seq, CAST(ts AS DATE) AS d,
       CAST(CASE WHEN user_id % 3 = 0 THEN 8 ELSE floor(value / 200) * 4 END AS DOUBLE) AS total
FROM events""",
    "v_words": """SELECT l_orderkey AS file, l_linenumber AS line, l_partkey AS left_px, concat('w', CAST(l_partkey AS STRING)) AS text,
       round(l_discount * 1000) AS conf, l_suppkey
FROM lineitem""",
    "v_boxes": """SELECT l_suppkey AS file, l_extendedprice / 100 AS y, l_partkey AS x, l_quantity AS h,
       concat('b', CAST(l_partkey AS STRING)) AS text, l_tax AS score, l_orderkey, l_linenumber
FROM lineitem""",
    "v_answers": """SELECT o_orderkey AS file,
       concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Here it is: ' ELSE '' END,
              '{"employee_name":"E', CAST(o_custkey AS STRING), '","entries":[{"date":"',
              CAST(CAST(o_orderdate AS DATE) AS STRING), '","total_hours":', CAST(o_orderkey % 13 AS STRING),
              '}],"weekly_totals":[]}', CASE WHEN o_orderkey % 2 = 0 THEN ' Done.' ELSE '' END) AS text
FROM orders""",
    "v_usage": """SELECT event_id AS call_id, event_type AS model, CAST(floor(value) AS BIGINT) AS total_tokens, floor(value) / 1000 AS cost
FROM events""",
    "v_uploads": """SELECT o_orderkey AS id, o_custkey AS user_id, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
       o_orderdate AS created_at, o_orderpriority AS status, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS total
FROM orders""",
    "v_profiles": """SELECT c_custkey AS user_id, c_name AS full_name, n_name AS client,
       CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'employee' END AS role
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "v_files": """SELECT c_custkey AS file_seq, concat('f', CAST(c_custkey AS STRING)) AS file, c_mktsegment AS client_hint, c_custkey % 8 AS layout,
       CASE WHEN c_custkey % 40 = 35 THEN concat('Solo ', CAST(c_custkey AS STRING)) ELSE concat('Person ', CAST(c_custkey % 39 AS STRING)) END AS name_hint,
       make_date(CAST(1996 + c_custkey % 2 AS INT), CAST(c_custkey % 12 + 1 AS INT), 1) AS period,
       CASE WHEN c_custkey % 8 = 7 AND c_custkey % 16 <> 15 THEN CAST(DATE '1997-03-17' + 7 * CAST(c_custkey % 2 AS INT) AS DATE) END AS anchor
FROM customer""",
    "v_layout_rows": """SELECT o_custkey AS table_id, concat('f', CAST(o_custkey AS STRING)) AS file, o_orderkey AS row_id, o_custkey % 8 AS layout,
       CAST(o_orderdate AS DATE) AS d, o_orderkey % 9 AS h, o_orderkey % 50 AS w,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
            WHEN o_custkey % 5 = 0 THEN concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
            ELSE concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING)) END AS written
FROM orders""",
    "v_layout_cells": """SELECT file, table_id, row_id, 0 AS col, written AS value FROM v_layout_rows WHERE layout IN (0, 1, 4, 5)
UNION ALL
SELECT file, table_id, row_id, 1, CASE WHEN row_id % 4 = 0 THEN 'off' WHEN row_id % 7 = 0 THEN concat(CAST(h AS STRING), ' hrs') ELSE CAST(h AS STRING) END
  FROM v_layout_rows WHERE layout IN (0, 4)
UNION ALL
SELECT file, table_id, row_id, 2, CASE WHEN row_id % 3 = 0 THEN '1:30' ELSE ' ' END FROM v_layout_rows WHERE layout IN (0, 4) AND row_id % 5 > 0
UNION ALL
SELECT file, table_id, row_id, 1, CAST(w AS STRING) FROM v_layout_rows WHERE layout IN (1, 5)
UNION ALL
SELECT r.file, table_id, row_id, 0, CASE row_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(month(period) AS STRING), '/', CAST(year(period) AS STRING))
       ELSE concat('FY ', CAST(year(period) - 1 AS STRING)) END FROM v_layout_rows r JOIN v_files f ON f.file = r.file WHERE r.layout = 3
UNION ALL
SELECT file, table_id, row_id, 1, CAST(w AS STRING) FROM v_layout_rows WHERE layout = 3
UNION ALL
SELECT file, table_id, row_id, 0, concat('job ', CAST(w AS STRING)) FROM v_layout_rows WHERE layout = 7
UNION ALL
SELECT file, table_id, row_id, CAST(1 + row_id % 7 AS INT), CAST(h AS STRING) FROM v_layout_rows WHERE layout = 7
UNION ALL
SELECT file, file_seq, -1, 0, CASE layout WHEN 0 THEN 'Date' WHEN 4 THEN ' Work DATE ' WHEN 1 THEN 'Week Ending' WHEN 5 THEN 'Timesheet End' WHEN 3 THEN 'Period'
  ELSE 'Project' END
FROM v_files WHERE layout NOT IN (2, 6)
UNION ALL
SELECT file, file_seq, -1, 1, CASE layout WHEN 0 THEN 'Regular Hours' WHEN 4 THEN 'Reg.' WHEN 7 THEN 'Mon' ELSE 'Total Hours' END FROM v_files WHERE layout NOT IN (2, 6)
UNION ALL
SELECT file, file_seq, -1, 2, CASE layout WHEN 0 THEN 'OT' WHEN 7 THEN 'Tuesday' ELSE 'Overtime' END FROM v_files WHERE layout IN (0, 4, 7)
UNION ALL
SELECT file, file_seq, -1, k, name FROM v_files, (VALUES (3, 'Wed'), (4, ' THU'), (5, 'Fri.'), (6, 'saturday'), (7, 'Sun')) AS named(k, name) WHERE layout = 7
UNION ALL
SELECT file, file_seq, -2, 0, 'Weekly report of hours worked' FROM v_files WHERE layout IN (0, 4)
UNION ALL
SELECT file, file_seq, 1099511627776, k, said FROM v_files, (VALUES (0, 'Month total'), (1, '160')) AS stated(k, said) WHERE layout = 0 AND file_seq % 3 = 0""",
    "v_layout_lines": """SELECT file, row_id AS line_no, concat(written, '  ', CAST(h AS STRING), '.50') AS line FROM v_layout_rows WHERE layout IN (2, 6)
UNION ALL
SELECT file, 2, concat('Hours from ', CAST(anchor AS STRING), ' to ', CAST(CAST(anchor + 6 AS DATE) AS STRING)) FROM v_files WHERE anchor IS NOT NULL
  AND file_seq % 32 < 16
UNION ALL
SELECT file, 1, concat('For ', CAST(month(anchor) AS STRING), '/', CAST(day(anchor) AS STRING), '/1997 - 3/30/1997') FROM v_files WHERE anchor IS NOT NULL
  AND file_seq % 32 >= 16
UNION ALL
SELECT file, 9, '1/2/1998 to 1/8/1998 is the next range' FROM v_files WHERE anchor IS NOT NULL""",
    "v_paths": """SELECT p_partkey AS file_seq,
       concat(replace(p_brand, '#', ' '), ' TS April -2026/', replace(p_name, ' ', '_'), '_timesheet_04-01-2026.',
              CASE p_size % 6 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx'
                              WHEN 4 THEN 'eml' ELSE 'bin' END) AS path
FROM part""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expanded(names: list[str]) -> list[str]:
    """Views in an order in which each stands behind those that it reads."""
    out: list[str] = []
    for name in names:
        for v in [*expanded([v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]), name]:
            if v not in out:
                out.append(v)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the driver's tables of sf_dir."""
    for own in expanded([name]):
        sql = VIEWS[own]
        for t in TABLES:
            if re.search(rf"\b{t}\b", sql):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        got = spark.sql(sql)
        if own != name:
            got.createOrReplaceTempView(own)
    return got


def with_views(sql: str) -> str:
    """SQL whose domain tables are defined in front of it."""
    heads = [f"{v} AS ({VIEWS[v]})" for v in expanded([v for v in VIEWS if re.search(rf"\b{v}\b", sql)])]
    body = sql.strip()
    if not heads:
        return body
    for start in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(start):
            return f"{start} " + ",\n".join(heads) + ",\n" + body[len(start) :].lstrip()
    return "WITH " + ",\n".join(heads) + "\n" + body
