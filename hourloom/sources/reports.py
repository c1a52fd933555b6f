"""The nested report as JSON files, one folder a month, and mail parts from message files."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage
from functools import cache, lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.operators.files import is_document
from hourloom.sources.delimited import text_cells


def nested_report(months: DataFrame, days: DataFrame) -> DataFrame:
    """months with their days as an array by date: the only nested form, made at the sink."""
    lists = days.groupBy("emp", F.trunc("d", "MM").alias("period")).agg(F.array_sort(F.collect_list(F.struct("d", "regular", "overtime", "total"))).alias("days"))
    return months.join(lists, ["emp", "period"], "left")


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines by year and month; a later run of a month replaces that month only."""
    rows = report.withColumn("year", F.year("period")).withColumn("month", F.month("period"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").json(path)


def latest_report(spark: SparkSession, path: str) -> DataFrame:
    """The newest month of a stored report; other months' files aren't read."""
    stored = spark.read.json(path)
    newest = stored.agg(F.max(F.struct("year", "month")).alias("m")).first()["m"]
    return stored.where((F.col("year") == newest["year"]) & (F.col("month") == newest["month"])) if newest else stored


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of all documents below a folder, hidden and system files left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(is_document(F.col("path")))


MAIL = "file string, part string, ctype string, filename string, disposition string, content string, subject string, sender string, sent string"
#: Attachments that are read as tables, and their separators.
TABLES = {"csv": ",", "tsv": "\t"}


#: Mails and bytes of mails that go to Python at a time: bounds what a worker holds.
BATCH_MAILS, BATCH_BYTES = "256", str(8 << 20)
#: Header lines whose parsed form a task remembers.
HEADERS = 4096


@cache
def mail_policy() -> policy.EmailPolicy:
    """The standard library's policy, which parses a header each time that it is asked for, with the last headers remembered: parts of
    many mails say the same of themselves."""
    return policy.default.clone(header_factory=lru_cache(HEADERS)(HeaderRegistry()))


def read_mail(content: bytes | None) -> EmailMessage:
    return message_from_bytes(bytes(content or b""), policy=mail_policy())


def mail_parts(files: DataFrame) -> DataFrame:
    """Parts of message files(file, content): a message is parsed where it lies, by the standard library.

    part is the part's path in the message, two digits a level, so its order is the message's. A mail inside a mail is one part
    without content. content: texts, and attached tables. Mails go to Python in small batches; the session keeps this setting.
    """
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_MAILS)
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def leaves(message, path: str) -> Iterator[tuple]:
        if message.get_content_type() != "message/rfc822" and message.is_multipart():
            for k, part in enumerate(message.iter_parts()):
                yield from leaves(part, f"{path}.{k:02d}" if path else f"{k:02d}")
        else:
            yield path or "00", message

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"], strict=True):
                message = read_mail(content)
                heads = message.get("subject"), message.get("from"), message.get("date")
                for path, part in leaves(message, ""):
                    name = part.get_filename()
                    data, body = part.get_payload(decode=True), None
                    if data is not None and (part.get_content_maintype() == "text" or (name or "").lower().rpartition(".")[2] in TABLES):
                        try:
                            body = data.decode(part.get_content_charset() or "utf-8", "replace")
                        except LookupError:
                            body = data.decode("utf-8", "replace")
                    rows.append((file, path, part.get_content_type(), name, part.get_content_disposition(), body, *heads))
            yield pd.DataFrame(rows, columns=["file", "part", "ctype", "filename", "disposition", "content", "subject", "sender", "sent"])

    return files.select("file", "content").mapInPandas(parse, MAIL)


def is_attached(parts: DataFrame) -> Column:
    """Whether a part is an attachment: it says so, or it has a name and is no text; a mail inside the mail is none."""
    named = F.coalesce(parts["filename"], F.lit("")) != ""
    said = (F.coalesce(parts["disposition"], F.lit("")) == "attachment") | (named & ~F.coalesce(parts["ctype"], F.lit("")).startswith("text/"))
    return said & (F.coalesce(parts["ctype"], F.lit("")) != "message/rfc822")


def mail_bodies(parts: DataFrame, strip_html) -> DataFrame:
    """file, subject, sender, sent, body, attachments: the plain parts joined, or all HTML parts as text where there is none."""
    attached = is_attached(parts)
    joined = lambda kind, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~attached & (F.col("ctype") == kind), F.struct("part", value.alias("v"))))), lambda x: x["v"]), "\n")
    got = parts.groupBy("file").agg(
        *[F.first(c).alias(c) for c in ("subject", "sender", "sent")], joined("text/plain", F.col("content")).alias("plain"), joined("text/html", strip_html(F.col("content"))).alias("html"),
        F.count_if(attached).alias("attachments"),
    )
    return got.select("file", "subject", "sender", "sent", F.coalesce(F.nullif(F.trim("plain"), F.lit("")), F.trim("html")).alias("body"), "attachments")


def mail_lines(bodies: DataFrame) -> DataFrame:
    """file, line_no, line: subject, sender and date, then the body's lines."""
    heads = [F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in (("Subject", "subject"), ("From", "sender"), ("Date", "sent"))]
    return bodies.select("file", F.posexplode(F.concat(F.array(*heads), F.split(F.coalesce("body", F.lit("")), "\\R"))).alias("line_no", "line"))


def attached_cells(parts: DataFrame) -> DataFrame:
    """file (the mail's), part, row_id, col, value of attached delimited tables; the text of a part fits a row."""
    rows = parts.where(is_attached(parts)).select("file", "part", F.lower(F.regexp_extract("filename", r"[^.]+$", 0)).alias("ext"), F.col("content").alias("text"))
    each = [text_cells(rows.where(F.col("ext") == ext).drop("ext"), sep) for ext, sep in TABLES.items()]
    return reduce(DataFrame.unionByName, each)
