"""Delimited files and texts as cells: any number of columns, ragged rows, quoted separators, quotes and line breaks.

Files are read by lines and byte ranges, so one large file is many tasks. Whether a line begins inside a quoted cell depends on all
lines before it, but only through one bit: each line maps that bit to the next line's. A line's map is read off the line for
either start, maps of a range follow from its lines, and a fold over a file's ranges, a few numbers each, says how each begins and which
row it begins with. Only then are the lines of a row brought together.

A quote opens a cell only at its begin; elsewhere it is a character. Line breaks in cells read as \\n. Empty lines between rows are
skipped; empty cells, like those that ragged rows lack, are missing rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Lines of a range that are put in order together: bounds what the windows of a task hold.
BLOCK_LINES = 1 << 16
#: Rows of a file in its text dump.
DUMP_ROWS = 200
QUOTED = r'"(?:[^"]++|"")*+"'


class Dialect:
    """Patterns of lines and cells for a separator."""

    def __init__(self, separator: str):
        s = re.escape(separator)
        self.separator = separator
        cell = rf'{QUOTED}[^{s}]*+|[^{s}"][^{s}]*+'
        opened = rf'(?:(?:{cell})?{s})*+"(?:[^"]++|"")*+$'
        #: Of a line that begins outside quotes, and one that begins inside: whether it ends inside.
        self.opens = rf"^{opened}"
        self.stays = rf'^(?:[^"]++|"")*+$|^(?:[^"]++|"")*+"[^{s}]*+{s}{opened}'
        #: A cell of a row, with the separator behind it.
        self.cells = rf'(?s)((?:{cell})?){s}'
        #: A cell of a text and what ends it; line breaks end rows.
        self.of_text = rf'(?s)((?:{QUOTED}[^{s}\n]*+|[^{s}"\n][^{s}\n]*+)?)({s}|\n)'


def unquoted(cell: Column) -> Column:
    """What a raw cell says: quotes around it go, doubled ones are one."""
    whole = r'(?s)^"((?:[^"]++|"")*+)"(.*)$'
    return F.when(cell.rlike(whole), F.concat(F.replace(F.regexp_extract(cell, whole, 1), F.lit('""'), F.lit('"')), F.regexp_extract(cell, whole, 2))).otherwise(cell)


def _parity(n: Column) -> Column:
    return F.pmod(n, F.lit(2)) == 1


def numbered_lines(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """file, row_id, block, at, line of lines(file, block, at, line), the lines of a block being in order of at: the row that each line
    belongs to, from 0."""
    ends = [F.col("line").rlike(dialect.opens).alias("from_out"), F.col("line").rlike(dialect.stays).alias("from_in")]
    rows = lines.select("file", "block", "at", "line", *ends)
    fixed, turns = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    before = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    to_here = before.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("turned", _parity(F.coalesce(F.count_if(turns).over(before), F.lit(0))))
    # What the bit was set to last, as if turned back to the block's begin; null while it still depends on how the block begins.
    rows = rows.withColumn("set_to", F.last(F.when(fixed, F.col("from_out") != F.col("turned")), ignorenulls=True).over(before))
    inside = lambda start: F.coalesce("set_to", F.lit(start)) != F.col("turned")
    rows = rows.select("*", *[inside(s).alias(f"in_{k}") for k, s in enumerate((False, True))])
    rows = rows.select("*", *[F.count_if(~F.col(f"in_{k}") & (F.col("line") != "")).over(to_here).alias(f"begun_{k}") for k in (0, 1)])
    end = lambda k: F.when(F.col(f"in_{k}"), F.col("from_in")).otherwise(F.col("from_out")).alias(f"end_{k}")
    last = F.max_by(F.struct(end(0), end(1), "begun_0", "begun_1"), "at")
    blocks = rows.groupBy("file", "block").agg(last.alias("b")).select("file", "block", "b.*")
    listed = blocks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "end_0", "end_1", "begun_0", "begun_1"))).alias("blocks"))
    start = F.expr("struct(false as inside, 0L as rows, cast(array() as array<struct<block:bigint,inside:boolean,rows:bigint>>) as starts)")
    follow = lambda s, b: F.struct(
        F.when(s["inside"], b["end_1"]).otherwise(b["end_0"]).alias("inside"), (s["rows"] + F.when(s["inside"], b["begun_1"]).otherwise(b["begun_0"])).alias("rows"),
        F.array_append(s["starts"], F.struct(b["block"].alias("block"), s["inside"].alias("inside"), s["rows"].alias("rows"))).alias("starts"),
    )
    starts = listed.select("file", F.inline(F.aggregate("blocks", start, follow)["starts"])).select(
        "file", "block", F.col("inside").alias("begins_in"), F.col("rows").alias("rows_before"),
    )
    placed = rows.join(starts, ["file", "block"])
    of = lambda name: F.when(F.col("begins_in"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
    return placed.where(of("in") | (F.col("line") != "")).select("file", (F.col("rows_before") + of("begun") - 1).alias("row_id"), "block", "at", "line")


def row_cells(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """file, row_id, col, value of numbered_lines()."""
    whole = rows.groupBy("file", "row_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n").alias("row"),
    )
    raw = F.regexp_extract_all(F.concat("row", F.lit(dialect.separator)), F.lit(dialect.cells), F.lit(1))
    cells = whole.select("file", "row_id", F.posexplode(raw).alias("col", "value")).select("file", "row_id", "col", unquoted(F.col("value")).alias("value"))
    return cells.where("value <> ''")


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, row_id, col, value of delimited files: all cells as text, nothing taken for null; the header is row 0.

    By default .tsv files are cut at tabs and .csv files at commas. Ranges of files follow spark.sql.files.maxPartitionBytes.
    """

    def read(sep: str, pattern: str) -> DataFrame:
        text = spark.read.option("pathGlobFilter", pattern).text(path)
        lines = text.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("line"),
        )
        # A range's lines are cut into blocks, numbered from the range's begin: it has more bytes than lines, so the next range's numbers follow.
        nth = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        lines = lines.withColumn("block", F.col("block") + F.floor(nth / BLOCK_LINES))
        return row_cells(numbered_lines(lines, Dialect(sep)), Dialect(sep))

    return read(separator, "*") if separator else read("\t", "*.tsv").unionByName(read(",", "*.csv"))


def text_cells(docs: DataFrame, separator: str = ",") -> DataFrame:
    """The columns of docs but text, and row_id, col, value of the delimited table in each text (a mail's attachment): texts that fit a row."""
    beside = [c for c in docs.columns if c != "text"]
    dialect = Dialect(separator)
    ended = F.concat(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\n+$", ""), F.lit("\n"))
    both = [F.regexp_extract_all(ended, F.lit(dialect.of_text), F.lit(k)) for k in (1, 2)]
    found = docs.where("text <> ''").select(*beside, F.arrays_zip(both[0].alias("cell"), both[1].alias("end")).alias("cells"))
    # A cell's row is the number of line breaks before it; a fold keeps it beside the column.
    start = F.expr("struct(0L as row_id, 0 as col, cast(array() as array<struct<row_id:bigint,col:int,value:string>>) as out)")
    follow = lambda s, c: F.struct(
        (s["row_id"] + F.when((c["end"] == "\n") & ~((s["col"] == 0) & (c["cell"] == "")), F.lit(1)).otherwise(F.lit(0))).alias("row_id"), F.when(c["end"] == "\n", F.lit(0)).otherwise(s["col"] + 1).alias("col"),
        F.array_append(s["out"], F.struct(s["row_id"].alias("row_id"), s["col"].alias("col"), c["cell"].alias("value"))).alias("out"),
    )
    cells = found.select(*beside, F.inline(F.aggregate("cells", start, follow)["out"]))
    return cells.select(*beside, "row_id", "col", unquoted(F.col("value")).alias("value")).where("value <> ''")


def dump(cells: DataFrame, rows: int = DUMP_ROWS) -> DataFrame:
    """file, row_id, line of cells(file, row_id, col, value): the header as `a | b`, the first rows below it as `[r2] a | b`, with a place
    for each of the header's columns."""
    kept = cells.where(F.col("row_id") <= rows).groupBy("file", "row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("last"),
    )
    width = cells.where("row_id = 0").groupBy("file").agg(F.max("col").alias("width"))
    kept = kept.join(width, "file", "left")
    at = F.sequence(F.lit(0), F.greatest("last", F.coalesce("width", F.lit(0))))
    line = F.array_join(F.transform(at, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))), " | ")
    head = F.when(F.col("row_id") > 0, F.concat(F.lit("[r"), (F.col("row_id") + 1).cast("string"), F.lit("] "))).otherwise(F.lit(""))
    return kept.select("file", "row_id", F.concat(head, line).alias("line"))
