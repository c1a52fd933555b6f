"""Submissions, corrections and uploads as append-only logs; what holds now is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.review import latest

#: A person's month, and what orders the rows of a log.
KEYS, VERSION = ["user_id", "year", "month"], ["created_at", "id"]


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log, by year and month; nothing that is stored is ever changed."""
    rows.write.mode("append").partitionBy("year", "month").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def current(submissions: DataFrame, corrections: DataFrame) -> DataFrame:
    """The latest submission of each person's month with what the latest correction says; a correction stands beside a submission and
    doesn't replace it. Corrections hold where they are not null."""
    fixed = latest(corrections.select(*KEYS, *VERSION, F.col("regular").alias("new_regular"), F.col("overtime").alias("new_overtime")), KEYS, VERSION).drop(*VERSION)
    rows = latest(submissions, KEYS, VERSION).join(fixed, KEYS, "left")
    regular, overtime = F.coalesce("new_regular", "regular"), F.coalesce("new_overtime", "overtime")
    corrected = F.col("new_regular").isNotNull() | F.col("new_overtime").isNotNull()
    total = F.when(corrected, F.coalesce(regular, F.lit(0.0)) + F.coalesce(overtime, F.lit(0.0))).otherwise(F.col("total"))
    return rows.select(*KEYS, "id", regular.alias("regular"), overtime.alias("overtime"), total.alias("total"), corrected.alias("corrected"))


def sync_baseline(timesheets: DataFrame, submissions: DataFrame) -> DataFrame:
    """timesheets(timesheet_id, regular, overtime, total) with the totals of the latest submission of each, where there is one."""
    new = latest(submissions.select("timesheet_id", *VERSION, *[F.col(c).alias(f"new_{c}") for c in ("regular", "overtime", "total")]), ["timesheet_id"], VERSION)
    return timesheets.join(new, "timesheet_id", "left").select("timesheet_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("regular", "overtime", "total")])


def register(files: DataFrame) -> DataFrame:
    """Rows of the file register: path, name, mime, size in KB, period, status of files(path, mime, length, year, month, status)."""
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.select(
        "path", name.alias("name"), "mime", F.round(F.col("length") / 1024).cast("long").alias("kb"), F.make_date("year", "month", F.lit(1)).alias("period"),
        F.coalesce("status", F.lit("uploaded")).alias("status"),
    )
