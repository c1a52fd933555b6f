"""Records from ragged grids: column roles by header keywords, then one rule set for each layout.

cells: table_id, row_id, col, value (text); ragged rows are missing cells. All tables are worked on in one job; a row is the
unit of work, a table's header is one small row joined to it. Where cells serve several rules, grid_rows() brings them together by row
once; all functions here take cells or such rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.functions import dates, hours

#: Words of each role, and the order in which roles take columns.
ROLE_KEYWORDS = {
    "date": ["date"],
    "regular": ["regular", "reg hrs", "reg.", "straight", "st/fp", "st hours", "regula", "billable hours", "worked hours"],
    "overtime": ["overtime", "ot hours", "o.t", "overti", "ot"],
    "total": ["total"],
    "in": ["time in", "clock in", "start time", "start", "in"],
    "out": ["time out", "clock out", "finish time", "finish", "out"],
    "lunch_out": ["lunch out", "break out"],
    "lunch_in": ["lunch in", "break in"],
    "hours": ["hours", "hrs", "# of hours"],
    "week_start": ["week start", "start date", "timesheet start", "period start", "week beginning"],
    "week_end": ["week end", "week ending", "end date", "timesheet end", "period end"],
    "project": ["project", "client", "customer", "task", "program"],
    "note": ["note", "comment", "description", "shift notes"],
    "sick": ["sick"],
    "vacation": ["vacation", "pto"],
    "holiday": ["holiday"],
    "leave": ["leave"],
}
ROLE_PRIORITY = ["date", "week_start", "week_end", "regular", "overtime", "total", "sick", "vacation", "holiday", "leave", "lunch_out", "lunch_in", "in", "out", "project", "note", "hours"]
DAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Rows in which a header is looked for.
HEADER_ROWS = 15


def keyword_match(cell: Column, word: str) -> Column:
    """Contained; short words only as the whole cell or at its edge."""
    if len(word) <= 3:
        return (cell == word) | cell.startswith(word + " ") | cell.endswith(" " + word)
    return cell.contains(word)


def _any_keyword() -> str:
    """A pattern that lower-cased texts have wherever keyword_match() may fit: words grouped by their first letters, as an engine tries
    all alternatives at each place; short ones only at a text's edges."""
    words = sorted({w for own in ROLE_KEYWORDS.values() for w in own})
    by_letter: dict[str, list[str]] = {}
    for w in (w for w in words if len(w) > 3):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    inside = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in by_letter.items())
    short = "|".join(re.escape(w) for w in words if len(w) <= 3)
    return rf"^ *(?:{short})(?: |\z)|{inside}| (?:{short}) *\z"


ANY_KEYWORD = _any_keyword()


def _role_numbers(cell: Column) -> Column:
    """Numbers of the roles, by priority, that a header cell's text fits."""
    fits = [F.when(reduce(lambda a, b: a | b, [keyword_match(cell, w) for w in ROLE_KEYWORDS[r]]), F.lit(k)) for k, r in enumerate(ROLE_PRIORITY)]
    return F.array_compact(F.array(*fits))


def grid_rows(cells: DataFrame) -> DataFrame:
    """table_id, row_id, cells (array of col, value in order of columns) and the columns that cells has beside; one shuffle."""
    if "cells" in cells.columns:
        return cells
    beside = [c for c in cells.columns if c not in ("table_id", "row_id", "col", "value")]
    return cells.groupBy("table_id", "row_id", *beside).agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))


def _plain(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def assign_roles(cells: DataFrame) -> DataFrame:
    """table_id, row_id, role, col: what each row would be as a header."""
    return header_candidates(cells).select("table_id", "row_id", F.inline("roles")).select("table_id", "row_id", "role", "col")


def _single_cells(cells: DataFrame) -> DataFrame:
    """table_id, row_id, col, value of cells or of grid_rows()."""
    own = [F.inline("cells")] if "cells" in cells.columns else ["col", "value"]
    return cells.select("table_id", "row_id", *own)


def header_candidates(cells: DataFrame) -> DataFrame:
    """table_id, row_id, roles (array of role, col) of the rows that fit any role.

    Only cells that look like a role's words are brought together by row: few of a table's cells do. Roles choose in order of
    priority, each the first fitting column that is free: a fold over the row's columns.
    """
    likely = _single_cells(cells).where(F.lower("value").rlike(ANY_KEYWORD))
    fits = dates.once(likely, dates.bound(_plain(F.col("value")), _role_numbers).alias("fits")).where(F.size("fits") > 0)
    rows = fits.groupBy("table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("col", "fits"))).alias("fitting"))

    def choose(state: Column, role: Column) -> Column:
        free = F.filter("fitting", lambda c: F.array_contains(c["fits"], role) & ~F.exists(state, lambda s: s["col"] == c["col"]))
        return F.when(F.size(free) > 0, F.array_append(state, F.struct(role.alias("role"), F.element_at(free, 1)["col"].alias("col")))).otherwise(state)

    empty = F.expr("cast(array() as array<struct<role:int,col:int>>)")
    asked = F.array_sort(F.array_distinct(F.flatten(F.transform("fitting", lambda c: c["fits"]))))
    taken = F.aggregate(asked, empty, choose)
    names = F.array(*[F.lit(r) for r in ROLE_PRIORITY])
    return rows.select(
        "table_id", "row_id", F.transform(taken, lambda t: F.struct(F.element_at(names, t["role"] + 1).alias("role"), t["col"].alias("col"))).alias("roles"),
    )


def _headers(cells: DataFrame) -> DataFrame:
    """table_id, header_row, score, roles: of the first rows the one with most roles, dates and week bounds counting more; earliest
    on ties. Cells are read once for it: those beyond a table's first rows are dropped before the shuffle, and values go along only
    where they look like a role's words."""
    nth = F.dense_rank().over(W.partitionBy("table_id").orderBy("row_id"))
    own = [F.inline_outer("cells")] if "cells" in cells.columns else ["col", "value"]
    likely = F.when(F.lower("value").rlike(ANY_KEYWORD), F.col("value"))
    first = cells.where("table_id is not null").select("table_id", "row_id", *own).select("table_id", "row_id", "col", likely.alias("value"))
    first = first.withColumn("nth", nth).where(F.col("nth") <= HEADER_ROWS)
    has = lambda *names: F.exists("roles", lambda r: r["role"].isin(*names)).cast("int")
    score = (F.size("roles") + 2 * has("date") + 2 * has("week_start", "week_end")).cast("long")
    scored = header_candidates(first).withColumn("score", score)
    best = scored.groupBy("table_id").agg(F.min_by(F.struct("row_id", "score", "roles"), F.struct(-F.col("score"), F.col("row_id"))).alias("best"))
    return best.select("table_id", F.col("best.row_id").alias("header_row"), F.col("best.score").alias("score"), F.col("best.roles").alias("roles"))


def header_rows(cells: DataFrame) -> DataFrame:
    """table_id, header_row, score of each table in which some row fits a role."""
    return _headers(cells).drop("roles")


def role_columns(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """table_id, row_id and a text column for each role, of the rows below each table's header (found if not given); row_text, the
    row's lower-cased text, row_cells, its values in order of columns, and the columns that cells has beside.

    Cells are brought together by row once; for the headers only the first rows' ids and cells that look like a role's words are moved.
    """
    rows = grid_rows(cells)
    beside = [c for c in rows.columns if c not in ("table_id", "row_id", "cells")]
    if headers is None:
        found = _headers(cells).select("table_id", "header_row", "roles")
    else:
        at = headers.select("table_id", F.col("header_row").alias("row_id"))
        found = header_candidates(rows.join(at, ["table_id", "row_id"], "left_semi")).withColumnRenamed("row_id", "header_row")
    # Columns of roles are looked up once a table.
    col_of = lambda r: F.get(F.filter("roles", lambda x: x["role"] == r), F.lit(0))["col"]
    found = found.select("table_id", "header_row", F.struct(*[col_of(r).alias(r) for r in ROLE_PRIORITY]).alias("at_"))
    below = rows.join(found, "table_id").where("row_id > header_row")
    at = lambda col: F.when(col.isNotNull(), F.get(F.filter("cells", lambda c: c["col"] == col), F.lit(0))["value"])
    return below.select(
        "table_id", "row_id", *beside, *[at(F.col("at_")[r]).alias(r) for r in ROLE_PRIORITY],
        F.lower(F.array_join(F.col("cells")["value"], " ")).alias("row_text"), F.col("cells")["value"].alias("row_cells"),
    )


def daily_grid(rows: DataFrame, order: Column, base_year: Column, most: float = 16.0, period: Column | None = None) -> DataFrame:
    """Entries of role_columns() rows that have a date: table_id, row_id, d, regular, overtime, total, project, note, issue.

    Generic hours are the total only without regular and total; then in and out times count. Rows blank in all hour columns
    are no entries; unreadable ones are entries with an issue. With a period (the month's first day) dates of a spreadsheet's empty
    epoch move into its month, entries of other months go, and a column `recovered` marks moved dates.
    """
    # Texts are parsed once; what follows works on numbers.
    hour_cols = ("regular", "overtime", "total", "hours", "in", "out")
    rows = dates.once(rows.where(F.col("date").isNotNull()), dates.parse_date(F.col("date"), order, base_year).alias("read")).where("read is not null")
    moved = F.lit(None).cast("date") if period is None else dates.rescue_epoch(F.col("read"), period)
    rows = rows.withColumns({"d": F.coalesce(moved, "read"), "recovered": moved.isNotNull()})
    if period is not None:
        rows = rows.where(F.trunc("d", "MM") == period)
    # One rule over an array of columns is built and planned once.
    clocks = ("in", "out", "lunch_out", "lunch_in")
    own = rows.select("table_id", "row_id", "d", "recovered", "project", "note", *ROLE_CELLS)
    own = dates.once(own, F.transform(F.array(*hour_cols[:4]), hours.parse_hours).alias("hs"), F.transform(F.array(*clocks), hours.parse_clock).alias("cs"))
    rows = own.select("*", *[F.col("hs")[k].alias(f"{c}_h") for k, c in enumerate(hour_cols[:4])], *[F.col("cs")[k].alias(f"{c}_s") for k, c in enumerate(clocks)])
    clock = hours.hours_between(F.col("in_s"), F.col("out_s"), hours.lunch_minutes(F.col("lunch_out_s"), F.col("lunch_in_s")))
    bare = F.col("regular_h").isNull() & F.col("total_h").isNull()
    # Each step is bound once: nested, these rules grow beyond what the engine compiles.
    rows = dates.once(rows, F.when(bare, F.coalesce("hours_h", clock)).otherwise(F.col("total_h")).alias("t0"))
    r, o, t = hours.split_hours(F.col("t0"), F.col("regular_h"), F.col("overtime_h"))
    rows = dates.once(rows, r.alias("r"), o.alias("o"), t.alias("t"))
    present = reduce(lambda a, b: a | b, [F.coalesce(F.trim(c), F.lit("")) != "" for c in hour_cols])
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    got = rows.select(
        "table_id", "row_id", "d", "recovered", "r", "o", "t", clean("project").alias("project"), clean("note").alias("note"),
        present.alias("present"),
    )
    has = F.col("r").isNotNull() | F.col("o").isNotNull() | F.col("t").isNotNull()
    issue = F.when(~has, F.lit("UNCLEAR")).when(F.col("t") > most, F.lit("OUT_OF_RANGE"))
    extra = [] if period is None else ["recovered"]
    return got.where(has | F.col("present")).select(
        "table_id", "row_id", "d", F.col("r").alias("regular"), F.col("o").alias("overtime"), F.col("t").alias("total"), "project", "note", issue.alias("issue"),
        *extra,
    )


#: Columns that a day's hours are read from.
ROLE_CELLS = ("regular", "overtime", "total", "hours", "in", "out", "lunch_out", "lunch_in")


def stated_totals(rows: DataFrame, order: Column, base_year: Column, *bounds: str) -> DataFrame:
    """table_id, stated_total: of rows without a date in the columns `bounds` that speak of a month's total the last one's first
    positive number."""
    texts = rows.where(F.col("row_text").rlike("(?s)month.*total|total.*month"))
    undated = F.forall(F.array(*bounds), lambda c: dates.parse_date(c, order, base_year).isNull())
    got = texts.where(undated).select("table_id", "row_id", F.get(F.filter(F.transform("row_cells", hours.parse_hours), lambda h: h > 0), F.lit(0)).alias("h"))
    return got.where("h is not null").groupBy("table_id").agg(F.max_by("h", "row_id").alias("stated_total"))


def weekly_totals(rows: DataFrame, order: Column, base_year: Column) -> DataFrame:
    """Weeks of role_columns() rows: table_id, row_id, week_start, week_end, regular, overtime, total.

    A missing bound is the other plus or minus six days; regular falls back to generic hours; rows without hours go.
    """
    own = rows.select("table_id", "row_id", "week_start", "week_end", "regular", "overtime", "total", "hours", order.alias("order_"), base_year.alias("year_"))
    bounds = F.transform(F.array("week_start", "week_end"), lambda c: dates.parse_date(c, F.col("order_"), F.col("year_")))
    rows = dates.once(own.where("week_start is not null or week_end is not null"), bounds.alias("bounds"))
    rows = rows.select("*", F.col("bounds")[0].alias("s"), F.col("bounds")[1].alias("e")).where("s is not null or e is not null")
    read = F.transform(F.array("regular", "hours", "overtime", "total"), hours.parse_hours).alias("hs")
    rows = dates.once(rows.select("table_id", "row_id", "s", "e", "regular", "overtime", "total", "hours"), read)
    rows = rows.select("*", F.coalesce(F.col("hs")[0], F.col("hs")[1]).alias("r0"), F.col("hs")[2].alias("o0"), F.col("hs")[3].alias("t0"))
    rows = rows.where("r0 is not null or o0 is not null or t0 is not null")
    r, o, t = hours.split_hours(F.col("t0"), F.col("r0"), F.col("o0"))
    bounds = [F.coalesce("s", F.date_sub("e", 6)).alias("week_start"), F.coalesce("e", F.date_add("s", 6)).alias("week_end")]
    return rows.select("table_id", "row_id", *bounds, r.alias("regular"), o.alias("overtime"), t.alias("total"))


def period_anchor(text: Column, order: Column, base_year: Column) -> Column:
    """The first date of a range such as "03/29/2026 to 04/04/2026" in a text."""
    day = r"[0-9]{1,4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,4}"
    return dates.parse_date(F.regexp_extract(text, rf"({day}).{{0,6}}(?:to|-|–|—).{{0,6}}{day}", 1), order, base_year)


def text_anchors(lines: DataFrame, order: Column, base_year: Column) -> DataFrame:
    """file, anchor: the first date of the first range of dates in a file's lines(file, line_no, line); null if that is no date."""
    day = r"[0-9]{1,4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,4}"
    ranged = lines.where(F.col("line").rlike(rf"{day}.{{0,6}}(?:to|-|–|—).{{0,6}}{day}"))
    beside = [c for c in lines.columns if c not in ("file", "line_no", "line")]
    first = ranged.groupBy("file").agg(*[F.min_by(c, "line_no").alias(c) for c in ("line", *beside)])
    return first.select("file", period_anchor(F.col("line"), order, base_year).alias("anchor"))


def weekday_heads(cells: DataFrame) -> DataFrame:
    """table_id, header_row, day_cols: tables whose first row names at least five weekdays, and the columns that do, in order."""
    named = F.transform(F.filter("cells", lambda c: dates.bound(_plain(c["value"]), _is_weekday)), lambda c: c["col"])
    first = grid_rows(cells).groupBy("table_id").agg(F.min_by(F.struct("row_id", "cells"), "row_id").alias("first")).select("table_id", "first.*")
    return first.select("table_id", F.col("row_id").alias("header_row"), named.alias("day_cols")).where(F.size("day_cols") >= LEAST_WEEKDAYS)


#: Columns named like weekdays that make a matrix.
LEAST_WEEKDAYS = 5


def _is_weekday(name: Column) -> Column:
    return name.isin(*DAY_NAMES) | ((F.length(name) <= 4) & F.substring(name, 1, 3).isin(*[d[:3] for d in DAY_NAMES]))


def weekday_matrix(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """table_id, d, total: columns named like weekdays, in their order, are the days from anchors(table_id, anchor, header_row) on.

    At least five such columns are needed. Hours of all rows below the header add up by day.
    """
    cells = _single_cells(cells)
    at = anchors.where("anchor is not null").select("table_id", "anchor", "header_row")
    day = dates.bound(_plain(F.col("value")), _is_weekday)
    named = cells.join(at, "table_id").where((F.col("row_id") == F.col("header_row")) & day)
    heads = named.groupBy("table_id", "anchor", "header_row").agg(F.array_sort(F.collect_list("col")).alias("day_cols")).where(F.size("day_cols") >= LEAST_WEEKDAYS)
    return matrix_days(cells, heads)


def matrix_days(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """table_id, d, total of the cells, or grid_rows(), below heads(table_id, anchor, header_row, day_cols). Cells add up by themselves
    and need not be brought together by row."""
    # One small row a table is looked up: the cells needn't be sorted for that.
    below = _single_cells(cells).join(heads.hint("shuffle_hash"), "table_id").where("row_id > header_row")
    placed = below.select("table_id", "anchor", F.array_position("day_cols", F.col("col")).cast("int").alias("k"), "value").where("k > 0")
    read = dates.once(placed.select("table_id", F.expr("date_add(anchor, k - 1)").alias("d"), "value"), hours.parse_hours(F.col("value")).alias("h")).where("h > 0")
    return read.groupBy("table_id", "d").agg(F.round(F.sum("h"), 2).alias("total"))


def best_strategy(results: DataFrame) -> DataFrame:
    """One row a table of results(table_id, method, found, confidence): most found, then most confident, then daily, weekly, matrix."""
    rank = F.expr("CASE method WHEN 'daily_grid' THEN 0 WHEN 'weekly_totals' THEN 1 ELSE 2 END")
    best = F.min_by(F.struct("method", "found", "confidence"), F.struct(-F.col("found"), -F.col("confidence"), rank))
    return results.groupBy("table_id").agg(best.alias("b")).select("table_id", "b.*")


def merge_results(results: DataFrame) -> DataFrame:
    """Table results per file: found, methods joined by +, last stated total, mean confidence, needs_llm only without data."""
    last = F.max_by("stated_total", F.when(F.col("stated_total").isNotNull(), F.col("seq")))
    merged = results.groupBy("file").agg(
        F.sum("found").alias("found"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method"), last.alias("stated_total"),
        F.round(F.avg("confidence"), 2).alias("confidence"), F.bool_or("needs_llm").alias("any"),
    )
    return merged.withColumn("needs_llm", F.col("any") & (F.col("found") == 0)).drop("any")


def summary_totals(cells: DataFrame, period: Column) -> DataFrame:
    """table_id, stated_total: the first positive value below a total column's header, if a period column fits the month, which may be
    a column beside the cells.

    Of several header candidates the first counts; of several total or period columns in one, the last.
    """
    rows = grid_rows(cells)
    is_total = lambda v: v.isin("total", "total hours", "total hrs", "totalhours") | (v.contains("total") & (v.contains("hour") | v.contains("hrs")))
    is_period = lambda v: v.isin("period", "month", "month/year", "duration")
    last = lambda fits: F.array_max(F.transform(F.filter("cells", lambda c: fits(_plain(c["value"]))), lambda c: c["col"]))
    heads = dates.once(rows.select("table_id", F.col("row_id").alias("head"), "cells"), last(is_total).alias("tc"),
    last(is_period).alias("pc")).where("tc is not null").drop("cells")
    of = lambda col: F.get(F.filter("cells", lambda c: c["col"] == F.col(col)), F.lit(0))["value"]
    below = rows.withColumn("period_", period).join(heads, "table_id").where("row_id > head").select(
        "table_id", "head", "row_id", "period_", of("tc").alias("t"), F.lower(F.trim(of("pc"))).alias("p"),
    )
    month, own = F.lower(F.date_format("period_", "MMMM")), F.col("period_")
    named = [month, F.substring(month, 1, 3), F.concat(F.month(own).cast("string"), F.lit("/")), F.concat(F.lit("-"), F.month(own).cast("string"), F.lit("-")), F.year(own).cast("string")]
    fits = F.col("p").isNull() | (F.col("p") == "") | reduce(lambda a, b: a | b, [F.col("p").contains(x) for x in named])
    read = dates.once(below.where(fits), hours.parse_hours(F.col("t")).alias("h")).where(F.col("h") > 0)
    return read.groupBy("table_id").agg(F.min_by("h", F.struct("head", "row_id")).alias("stated_total"))


def sheet_rows(cells: DataFrame, rows: int = 400, cols: int = 64) -> DataFrame:
    """table_id, row_id, line: rows within the sheet limits as `a | b`, blank rows left out, blanks at a row's end trimmed."""
    kept = cells.where((F.col("row_id") < rows) & (F.col("col") < cols)).where(F.coalesce(F.trim("value"), F.lit("")) != "")
    lists = kept.groupBy("table_id", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("last"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))), " | ")
    return lists.select("table_id", "row_id", line.alias("line"))


def sheet_dump(cells: DataFrame, sheets: DataFrame, rows: int = 400, cols: int = 64) -> DataFrame:
    """file, table_id, row_id, line: rows within the sheet limits as `[sheet!rN] a | b`, N from 1, of sheets(file, table_id, sheet)."""
    lines = sheet_rows(cells.select("table_id", "row_id", "col", "value"), rows, cols).join(sheets, "table_id")
    head = F.concat(F.lit("["), F.coalesce("sheet", F.lit("")), F.lit("!r"), (F.col("row_id") + 1).cast("string"), F.lit("] "))
    return lines.select("file", "table_id", "row_id", F.concat(head, "line").alias("line"))


def sheet_status(sheets: DataFrame, lines: DataFrame) -> DataFrame:
    """file, tables, quality: how many of a file's sheets hold anything; a file of which none does is `empty`."""
    held = lines.select("table_id").distinct().withColumn("held", F.lit(1))
    got = sheets.join(held, "table_id", "left").groupBy("file").agg(F.count("held").alias("tables"))
    return got.withColumn("quality", F.when(F.col("tables") > 0, F.lit("native")).otherwise(F.lit("empty")))


def digest(cells: DataFrame, tables: DataFrame, most: int = 12, rows: int = 60) -> DataFrame:
    """file, digest: of tables(file, table_id, title) each file's first `most` by table_id, as `# table title` and its first rows as
    `a | b`, a blank line behind each. What a reviewer or a model is shown; both limits are its feature."""
    nth = lambda *by: F.row_number().over(W.partitionBy(by[0]).orderBy(by[1]))
    shown = tables.withColumn("t", nth("file", "table_id")).where(F.col("t") <= most)
    first = grid_rows(cells).select("table_id", "row_id", "cells", nth("table_id", "row_id").alias("k")).where(F.col("k") <= rows)
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c["value"], F.lit(""))), " | ")
    listed = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "\n")
    lines = first.select("table_id", "k", line.alias("line")).groupBy("table_id").agg(listed("k", "line").alias("lines"))
    head = F.rtrim(F.concat(F.lit("# table "), F.coalesce("title", F.lit(""))))
    blocks = shown.join(lines, "table_id", "left").select("file", "t", F.concat(head, F.coalesce(F.concat(F.lit("\n"), "lines"), F.lit("")), F.lit("\n")).alias("block"))
    return blocks.groupBy("file").agg(listed("t", "block").alias("digest"))


def clean_tables(cells: DataFrame, least_rows: int = 2) -> DataFrame:
    """Cells of page and document tables: texts trimmed, tables of fewer rows dropped, and `is_header` on each table's first row."""
    # Two rows differ where the least id isn't the largest one: most calls need no count of distinct ids.
    enough = F.min("row_id") < F.max("row_id") if least_rows == 2 else F.count_distinct("row_id") >= least_rows
    sizes = cells.groupBy("table_id").agg(enough.alias("enough"), F.min("row_id").alias("header_row")).where("enough")
    rows = cells.join(sizes.select("table_id", "header_row"), "table_id")
    return rows.select("table_id", "row_id", "col", F.trim("value").alias("value"), (F.col("row_id") == F.col("header_row")).alias("is_header"))
