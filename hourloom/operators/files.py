"""Files and their pages: kinds, native or scanned text, page assembly, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from hourloom.functions import dates

#: Extensions of each kind, and names that are no documents.
EXTENSIONS = {
    "excel": ("xlsx", "xlsm", "xls"), "csv": ("csv", "tsv"), "pdf": ("pdf",), "docx": ("docx",), "email": ("eml",),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff"),
}
SKIPPED = ("desktop.ini", ".ds_store", "thumbs.db")
#: Characters a page from which text is native, and the least share of readable characters.
PAGE_CHARS, READABLE = 80, 0.6
#: What stands between the pages of a joined file.
MARKER = r"-{3,}\s*page\s+[0-9]+[^\n]*-{3,}"


def is_document(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"[^/]+$", 0))
    return ~(name.isin(*SKIPPED) | name.startswith("~$") | name.startswith("."))


def kind_of(path: Column, content: Column) -> Column:
    """The kind by extension; only for an unknown one by the first bytes or a zip's members."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.when(F.lit(False), F.lit(""))
    for name, exts in EXTENSIONS.items():
        kind = kind.when(ext.isin(*exts), F.lit(name))
    head = F.hex(F.substring(content, 1, 8))
    has = lambda s: F.contains(content, F.to_binary(F.lit(s), F.lit("utf-8")))
    kind = kind.when(head.startswith("25504446"), F.lit("pdf"))
    for magic in ("89504E47", "FFD8FF", "47494638"):
        kind = kind.when(head.startswith(magic), F.lit("image"))
    zipped = head.startswith("504B0304")
    return kind.when(zipped & has("word/"), F.lit("docx")).when(zipped & has("xl/"), F.lit("excel")).otherwise(F.lit("unknown"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def pdf_kind(pages: DataFrame) -> DataFrame:
    """file, pages, chars, kind of pages(file, page, text): scanned if unreadable or short, else native."""
    readable = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\s.,:/\-$%()]", ""))
    got = pages.groupBy("file").agg(F.count("*").alias("pages"), F.sum(F.length(trimmed(F.col("text")))).alias("chars"), F.sum(readable).cast("double").alias("ok"))
    scanned = ((F.col("chars") > 0) & (F.col("ok") / F.col("chars") < READABLE)) | (F.col("chars") < PAGE_CHARS * F.col("pages"))
    return got.select("file", "pages", "chars", F.when(scanned, F.lit("pdf_scanned")).otherwise(F.lit("pdf_native")).alias("kind"))


def needs_vision(pages: DataFrame, least: int = 60) -> DataFrame:
    """Pages (file, page, text, images) with little text and an image."""
    return pages.where((F.length(trimmed(F.coalesce("text", F.lit("")))) < least) & (F.col("images") > 0)).select("file", "page")


def marked(page: Column, text: Column) -> Column:
    """A page's text under its marker."""
    return F.concat(F.lit("--- page "), page.cast("string"), F.lit(" ---\n"), text)


def join_pages(pages: DataFrame) -> DataFrame:
    """file, text: a file's pages in order, each under its marker. One value holds a whole file: for files of bounded size."""
    body = marked(F.col("page"), F.col("text"))
    return pages.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def split_pages(docs: DataFrame, least: int = 40) -> DataFrame:
    """file, nth, text: the chunks between page markers that have more than `least` characters."""
    parts = docs.select("file", F.posexplode(F.split("text", MARKER)).alias("nth", "text"))
    return parts.withColumn("text", trimmed(F.col("text"))).where(F.length("text") > least)


def split_marked(pages: DataFrame, least: int = 40) -> DataFrame:
    """file, page, nth, text: the chunks that split_pages gives of the joined file, page by page. As each page begins with a
    marker, no chunk spans two pages, so a file of any size is never put together."""
    own = pages.select("file", "page", marked(F.col("page"), F.col("text")).alias("text"))
    parts = own.select("file", "page", F.posexplode(F.split("text", MARKER)).alias("nth", "text"))
    return parts.withColumn("text", trimmed(F.col("text"))).where(F.length("text") > least)


def reject_reason(files: DataFrame) -> Column:
    """Why a file of files(text, tables, images, invoice, notes) goes no further, or null: nothing to extract (the notes say why, if they
    say anything), or an invoice."""
    nothing = (F.coalesce(F.col("text"), F.lit("")) == "") & (F.coalesce("tables", F.lit(0)) == 0) & (F.coalesce("images", F.lit(0)) == 0)
    said = F.coalesce(F.nullif(F.array_join("notes", "; "), F.lit("")), F.lit("nothing extractable"))
    return F.when(nothing, said).when(F.coalesce("invoice", F.lit(False)), F.lit("an invoice or bill, not a timesheet"))


def sort_out(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that go on, rejects with their reason): each file is in one of the two."""
    judged = dates.once(files, reject_reason(files).alias("reason"))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def reconcile(seen: DataFrame, processed: DataFrame, rejected: DataFrame) -> DataFrame:
    """path, status: processed, rejected, or lost when a file seen is in neither."""
    done = processed.select("path").distinct().withColumn("status", F.lit("processed"))
    out = done.unionByName(rejected.select("path").distinct().withColumn("status", F.lit("rejected")))
    return seen.distinct().join(out, "path", "left").select("path", F.coalesce("status", F.lit("lost")).alias("status"))


def referenced(*tables: DataFrame) -> DataFrame:
    """file: what results, days, issues and rejects name; a request for evidence is a semi-join with it."""
    out = tables[0].select("file")
    for t in tables[1:]:
        out = out.union(t.select("file"))
    return out.where("file is not null").distinct()


def arrival(files: DataFrame, buckets: int = 64) -> DataFrame:
    """files with file_seq, their place in the order of paths, which breaks all ties later on.

    Paths are dealt to ordered ranges; a range's place follows from the sizes of those before it, so no task sees all paths.
    """
    ranged = files.repartitionByRange(buckets, "path").withColumn("range", F.spark_partition_id())
    by = W.partitionBy("range").orderBy("path")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("range", "before")
    return ranged.withColumn("nth", F.row_number().over(by)).join(before, "range").select(*files.columns, (F.col("before") + F.col("nth") - 1).alias("file_seq"))
