"""Scalars of the document archive as column expressions.

All of them return null for null unless said otherwise; none is a UDF.
"""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

# Currency words and marks that a quantity may carry.
CURRENCY = r"(?i)\b(eur|usd|gbp|chf|tsd|mio|mrd)\b|[€$£¥%]"
# Document types, most specific first, with the words that name them.
DOC_TYPES = [
    ("audit", ["pruefbericht", "prüfbericht", "audit", "testat", "auditor"]),
    ("invoice", ["rechnung", "invoice", "faktura"]),
    ("ledger", ["hauptbuch", "ledger", "buchung", "journal"]),
    ("payroll", ["lohn", "gehalt", "payroll"]),
    ("tax", ["steuer", "tax", "umsatzsteuer", "vat"]),
    ("budget", ["budget", "forecast", "plan"]),
    ("contract", ["vertrag", "contract", "vereinbarung"]),
    ("balance_sheet", ["bilanz", "balance", "guv"]),
    ("statement", ["kontoauszug", "statement", "auszug"]),
    ("annual_report", ["geschaeftsbericht", "geschäftsbericht", "annual", "jahresabschluss"]),
]
# Names of files that only list other files.
LISTINGS = ["readme", "index", "inhalt", "uebersicht", "übersicht"]
# Words by which German and English are told apart.
GERMAN_WORDS = ["und", "der", "die", "das", "für", "nicht", "mit"]
ENGLISH_WORDS = ["the", "and", "for", "with", "not", "of"]
# What counts as a literal anchor in a query.
ANCHOR = r"\d{1,3}(?:[.,]\d{3})+|\d{5,}|\b[A-Z]{2,}[-_/]?\d+\b|\b\d{4}[-_/]\w+[-_/]\w+\b|\b\w*\d+[-_/]\d{3,}\b"


def parse_number(c: Column) -> Column:
    """Double that a cell is as a quantity, else null.

    Currency words, marks and '%' are dropped, brackets negate, blanks are
    ignored. Of two kinds of separator the last one is the decimal mark; a
    single kind groups if all groups have three digits, else it is the decimal
    mark. 'Mio' and the like are dropped without scaling.
    """
    s = F.trim(F.regexp_replace(c, CURRENCY, ""))

    def read(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(t, r"^\((.*)\)$", "$1"), "[  ]", "")
        sign = F.when(t.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)
        drop = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))

        def digits(b: Column) -> Column:
            comma, dot = F.locate(",", F.reverse(b)), F.locate(".", F.reverse(b))
            text = (
                F.when((comma > 0) & (dot > 0), F.when(comma < dot, F.replace(drop(b, "."), F.lit(","), F.lit("."))).otherwise(drop(b, ",")))
                .when(b.rlike(r"^[+-]?\d{1,3}([.]\d{3})+$"), drop(b, "."))
                .when(b.rlike(r"^[+-]?\d{1,3}(,\d{3})+$"), drop(b, ","))
                .otherwise(F.replace(b, F.lit(","), F.lit(".")))
            )
            plain = F.when(text.rlike(r"^[+-]?(\d+[.]?\d*|[.]\d+)$"), text)
            return F.when(b.rlike(r"^[+-]?[\d.,\s]+$"), plain.try_cast("double"))

        return sign * let(body, digits)

    return let(s, read)


def parse_date(c: Column) -> Column:
    """ISO text of the date a cell begins with, else null; days only checked to be 1 to 31.

    Y-M-D, D.M.Y, D/M/Y, Y/M/D of at least eight characters, years 1900 to 2200.
    """

    def read(s: Column) -> Column:
        ymd = F.regexp_extract(s, r"^(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2})", 1)
        dmy = F.regexp_extract(s, r"^(\d{1,2}[.]\d{1,2}[.]\d{4}|\d{1,2}/\d{1,2}/\d{4})", 1)
        part = F.split(F.when(ymd != "", ymd).otherwise(dmy), "[-/.]")
        y, m, d = F.when(ymd != "", part[0]).otherwise(part[2]), part[1], F.when(ymd != "", part[2]).otherwise(part[0])
        fits = y.cast("int").between(1900, 2200) & m.cast("int").between(1, 12) & d.cast("int").between(1, 31)
        iso = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.when((F.length(s) >= 8) & ((ymd != "") | (dmy != "")), F.when(fits, iso))

    return let(F.trim(c), read)


def period_range(period: str | None) -> tuple[str, str] | None:
    """Inclusive ISO range of 'YYYY', 'Qn YYYY', 'YYYY-Qn' or 'YYYY-M'; None if it reads as none of them."""
    p = (period or "").strip().upper().replace("_", "-")
    if re.fullmatch(r"\d{4}", p):
        year, first, last = int(p), 1, 12
    elif m := re.fullmatch(r"Q([1-4])[ \-/]*(\d{4})|(\d{4})[ \-/]*Q([1-4])", p):
        year, quarter = int(m[2] or m[3]), int(m[1] or m[4])
        first, last = 3 * quarter - 2, 3 * quarter
    elif (m := re.fullmatch(r"(\d{4})-(\d{1,2})", p)) and 1 <= int(m[2]) <= 12:
        year, first = int(m[1]), int(m[2])
        last = first
    else:
        return None
    if year < 1:
        return None
    return f"{year:04d}-{first:02d}-01", f"{year:04d}-{last:02d}-{calendar.monthrange(year, last)[1]:02d}"


def norm_cell(c: Column) -> Column:
    """Cell on one line without surrounding blanks; null gives ''."""
    return F.coalesce(F.trim(F.replace(c.cast("string"), F.lit("\n"), F.lit(" "))), F.lit(""))


def row_text(headers: Column, cells: Column) -> Column:
    """'header: cell | ...' over the filled cells; a missing header is 'Spalte n'."""
    name = lambda i: F.coalesce(F.nullif(F.try_element_at(headers, (i + 1).cast("int")), F.lit("")), F.format_string("Spalte %d", (i + 1).cast("int")))
    parts = F.transform(cells, lambda cell, i: F.when(cell != "", F.concat(name(i), F.lit(": "), cell)))
    return F.array_join(F.array_compact(parts), " | ")


def markdown_table(headers: Column, rows: Column, limit: int = 40) -> Column:
    """Markdown of an array of cell arrays: header, rule, at most ``limit`` rows, a line naming the rest."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.when(F.size(headers) > 0, F.array(line(headers), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(headers))))).otherwise(F.array().cast("array<string>"))
    rest = F.when(F.size(rows) > limit, F.array(F.format_string("… %d weitere Zeilen / more rows", (F.size(rows) - limit).cast("int")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(F.slice(rows, 1, limit), line), rest), "\n")


def guess_lang(text: Column) -> Column:
    """'de' if German marks and words strictly outnumber English words, else 'en'; '' if empty."""
    low = F.lower(text)
    times = lambda w: F.regexp_count(low, F.lit(w))
    words = lambda ws: sum((times(f" {w} ") for w in ws), F.lit(0))
    score = times("[äöüß]") * 2 + words(GERMAN_WORDS)
    return F.when(text.isNull() | (text == ""), "").when(score > words(ENGLISH_WORDS), "de").otherwise("en")


def infer_doc_type(name: Column, sample: Column) -> Column:
    """Type by the first matching word list, in the file name before the first 400 characters of text."""

    def first(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, keys in reversed(DOC_TYPES):
            out = F.when(c.rlike("|".join(keys)), kind).otherwise(out)
        return out

    low = F.lower(name)
    lists = F.when(low.rlike("|".join(LISTINGS)), "other")
    return F.coalesce(first(low), lists, first(F.lower(F.left(sample, F.lit(400)))), F.lit("other"))


def infer_year(name: Column, sample: Column) -> Column:
    """First standing year 19xx or 20xx in the name, else in the first 600 characters; '' if none."""
    pick = lambda c: F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    return F.coalesce(pick(name), pick(F.left(sample, F.lit(600))), F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def element_id(doc_id: Column, ordinal: Column) -> Column:
    """First 16 digits of the document's hash, ':' and the ordinal in five digits."""
    return F.concat(F.left(doc_id, F.lit(16)), F.lit(":"), F.lpad(ordinal.cast("string"), 5, "0"))


def query_terms(query: Column, limit: int = 32) -> Column:
    """The first ``limit`` tokens of more than one character, lower case without accents, repeats kept."""
    from .text import fold_accents

    found = F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(F.slice(F.filter(found, lambda t: F.length(t) > 1), 1, limit), lambda t: fold_accents(F.lower(t)))


def has_literal_anchor(query: Column) -> Column:
    """Whether a query holds a figure, code or number that names something; null counts as no."""
    return F.coalesce(query.rlike(ANCHOR), F.lit(False))


def format_amount(c: Column) -> Column:
    """German notation: whole numbers without decimals, else two; '—' for null."""
    swap = lambda s: F.translate(s, ",.", ".,")
    return F.when(c.isNull(), "—").when(c == F.round(c, 0), swap(F.format_number(c, 0))).otherwise(swap(F.format_number(c, 2)))


def format_bytes(c: Column) -> Column:
    """KB below one MB, else MB with one decimal."""
    return F.when(c < 1024 * 1024, F.format_string("%.0f KB", F.bround(c / 1024.0))).otherwise(F.format_string("%.1f MB", c / (1024.0 * 1024)))


def html_text(html: Column, limit: int | None = 4000) -> Column:
    """Text of a page: tags to blanks, white space collapsed, trimmed, at most ``limit`` characters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))
    return t if limit is None else F.left(t, F.lit(limit))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three '...' if something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def text_blocks(text: Column, limit: int = 1200) -> Column:
    """Paragraphs of a text put together up to ``limit`` characters, as an array; a heading begins a new block.

    Null and blank texts give an empty array; a longer paragraph stays whole.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("size"))

    def add(acc: Column, p: Column) -> Column:
        new = (acc["cur"] != "") & (p.startswith("#") | (acc["size"] + F.length(p) > limit))
        done = F.when(new, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        cur = F.when(new | (acc["cur"] == ""), p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), cur.alias("cur"), F.when(new, F.length(p)).otherwise(acc["size"] + F.length(p)).alias("size"))

    return F.aggregate(paragraphs, empty, add, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def join_parts(parts: Column) -> Column:
    """Text of a list of parts, nulls and empties left out."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")
