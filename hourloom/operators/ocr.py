"""Text lines from OCR words and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def word_lines(words: DataFrame, *keys: str, tie: str = "text") -> DataFrame:
    """Words of each line from left to right, by the column `tie` among equals, with the mean confidence; blank words and those of
    confidence below 0 go."""
    kept = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left_px", F.col(tie).alias("tie"), "text"))), lambda x: x["text"]), " ")
    return kept.groupBy(*keys).agg(text.alias("text"), F.round(F.coalesce(F.avg("conf"), F.lit(0.0)), 1).alias("confidence"))


def box_rows(boxes: DataFrame) -> DataFrame:
    """file, row_no, text, confidence of boxes(file, seq, x, y, h, text, score).

    By height, a row ends where the gap to the box before exceeds 0.6 of the upper median box height (12 if that is 0).
    """
    median = F.element_at(F.array_sort(F.collect_list("h")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    tol = boxes.groupBy("file").agg(F.when(median > 0, 0.6 * median).otherwise(F.lit(12.0)).alias("tol"))
    by = W.partitionBy("file").orderBy("y", "x", "seq")
    gap = F.col("y") - F.lag("y").over(by)
    rows = boxes.join(tol, "file").withColumn("new", (gap > F.col("tol")).cast("int"))
    rows = rows.withColumn("row_no", F.coalesce(F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda b: b["text"]), "  ")
    return rows.groupBy("file", "row_no").agg(text.alias("text"), F.round(F.avg("score") * 100, 1).alias("confidence"))


def better_read(first: DataFrame, second: DataFrame, least: float = 55.0) -> DataFrame:
    """Per page, the second read only if the first is weak and the second is better and not empty."""
    both = first.alias("a").join(second.alias("b"), "page", "left")
    take = (F.col("a.confidence") < least) & (F.coalesce("b.text", F.lit("")) != "") & (F.col("b.confidence") > F.col("a.confidence"))
    return both.select(
        "page", F.when(take, F.col("b.text")).otherwise(F.col("a.text")).alias("text"),
        F.when(take, F.col("b.confidence")).otherwise(F.col("a.confidence")).alias("confidence"),
    )
