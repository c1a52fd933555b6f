"""Rules over texts, names and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourloom.functions.dates import FULL_MONTHS, MONTHS

#: Words that are no names, and markers of timesheets.
NO_NAMES = (
    *MONTHS, "sept", *FULL_MONTHS, "timesheet", "time sheet", "timesheets", "monthly timesheet", "monthly", "time", "sheet", "ts", "month", "approved", "signed",
    "final", "copy",
)
LEADS = ("time sheet ", "timesheet ", "timesheets ", "ts ")
MONTH_WORD = r"\b(" + "|".join((*MONTHS, "sept", *FULL_MONTHS)) + r")\b"
EDGES = r"^[ \-·,]+|[ \-·,]+$"


def clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def html_to_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or tags, four entities read, white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " "))


def is_invoice(text: Column, file_name: Column) -> Column:
    """Billing rather than hours: the word and two points, or an invoice's file name and any sign."""
    t = F.lower(F.coalesce(text, F.lit("")))
    point = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    score = (
        point(t.rlike(r"invoice\s*#|invoice\s*(no|number)\b"), 2) + point(t.contains("bill to"), 2)
        + point(t.contains("amount due") | t.contains("total due") | t.contains("balance due"), 2)
        + point(t.contains("rate") & t.contains("amount") & t.contains("$"), 1)
    )
    word, named = t.contains("invoice"), F.lower(F.coalesce(file_name, F.lit(""))).rlike(r"[-_ ]inv[-_ ]?[0-9]")
    return (word & (score >= 2)) | (named & (word | (score >= 1)))


def client_from_path(path: Column) -> Column:
    """The top folder's name without timesheet words, years and months; null at top level or when nothing is left."""
    top = F.regexp_replace(F.split(path, "/")[0], r"[_\-]+", " ")
    top = F.regexp_replace(top, r"(?i)\b(ts|timesheet|timesheets|employees?)\b", " ")
    top = F.regexp_replace(top, r"\b20[0-9]{2}\b", " ")
    words = F.filter(F.split(F.trim(top), r"\s+"), lambda w: ~F.lower(w).isin(*MONTHS, *FULL_MONTHS))
    return F.when(path.contains("/"), clean(F.array_join(words, " ")))


def name_hint(stem: Column, companies: Sequence[str] = ()) -> Column:
    """A person's name from a file's stem: leading words of companies (lower case) and timesheets go, the rest ends at the first marker, date,
    long number, month or year; the stem itself where only a general word is left."""
    spaced = F.replace(stem, F.lit("_"), F.lit(" "))
    lead = "|".join(x.strip() + " " for x in (*LEADS, *companies))
    s = F.regexp_replace(spaced, rf"(?i)^(?:[ \-·,]*(?:{lead}))+", "")
    # Text before the first marker; one at the very start doesn't count.
    s = F.regexp_replace(s, r"(?is)^(.+?)(?: ts(?: |-|.*)|-ts.*|timesheet.*|time sheet.*).*$", "$1")
    s = F.regexp_replace(s, r"(?s)[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}.*$", "")
    s = F.regexp_replace(s, r"(?s)[0-9]{6,}.*$", "")
    s = F.regexp_replace(s, rf"(?is){MONTH_WORD}.*$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\b20[0-9]{2}\b", ""), EDGES, "")
    whole = F.regexp_replace(spaced, EDGES, "")
    return F.when((s == "") | F.lower(s).isin(*NO_NAMES, *companies), F.when(whole != "", whole).otherwise(stem)).otherwise(s)


def distinguishing_words(stem: Column, companies: Sequence[str] = ()) -> Column:
    """The last three words of a file's stem that can be parts of a name: no dates, long numbers, timesheet words, months, companies
    (lower case), words in capitals or of one or two letters."""
    s = F.regexp_replace(stem, r"[_\-]+", " ")
    s = F.regexp_replace(s, r"\b20[0-9]{2}\b|[0-9]{1,2}[/.][0-9]{1,2}(?:[/.][0-9]{2,4})?|[0-9]{5,}", " ")
    s = F.regexp_replace(s, rf"(?i)\b(timesheets?|time\s*sheet|ts|april|bi\s*monthly|{'|'.join(MONTHS)})\b", " ")
    fine = lambda w: (F.length(w) > 2) & ~(w.rlike("[A-Z]") & (F.upper(w) == w)) & ~F.lower(w).isin(*NO_NAMES, *companies)
    words = F.filter(F.split(F.trim(s), r"\s+"), fine)
    return F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3))


def canonical(value: Column) -> Column:
    """A typed time of a spreadsheet cell as text: the date alone at midnight, else the ISO form."""
    midnight = F.date_format(value, "HH:mm:ss") == "00:00:00"
    return F.when(midnight, F.date_format(value, "yyyy-MM-dd")).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"))
