"""Scalars by which answers are held against their sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

# Dates that are no figures.
DATES = (
    r"(?i)\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\s*"
    r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|"
    r"January|February|March|May|June|July|October|December)\b"
)
# Phrases by which an answer says that it has none.
REFUSALS = [
    "nicht enthalten", "keine angaben", "nicht vorhanden", "liegt nicht vor", "kein hinweis", "nicht verfügbar", "nicht gefunden", "enthält keine",
    "does not contain", "not contain", "no information", "not available", "not found", "cannot", "could not find", "no data", "unable to",
    "nicht abgedeckt", "keine informationen", "nicht dokumentiert", "nicht beziffert", "keine umsatzdaten", "keine daten", "nicht ableiten",
    "liegen keine", "keine prognose", "keine planungsdaten", "rein spekulativ", "unmöglich macht", "no revenue data", "not documented",
    "cannot be quantified", "beyond the archive", "outside the archive",
]
# Cues that a sentence compares periods.
COMPARISONS = [
    "vorjahr", "vergleich", "verglichen", "gegenüber", "gegenueber", "zuvor", "vorperiode", "im jahr 2023", "(31.12.2023", "2023)", "anstieg von",
    "previous year", "prior year", "compared", "versus", " vs", "year-on-year", "yoy", "up from", "grew from", "increase from",
]
AMOUNT = "decimal(38,6)"


def strip_dates(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), DATES, " ")


def to_decimal(text: Column) -> Column:
    """Exact figure of German or English notation; null if it is none.

    Of two kinds of separator the last is the decimal mark. A single separator
    is one if one or two digits follow; groups of three with a tail of two
    ('16.180.000.00') read the last dot as one; else separators group.
    """

    def read(s: Column) -> Column:
        comma, dot = F.locate(",", F.reverse(s)), F.locate(".", F.reverse(s))
        bare = lambda x: F.regexp_replace(x, "[.,]", "")
        tail = F.regexp_extract(s, r"[.,](\d+)$", 1)
        head = F.regexp_replace(s, r"[.,]\d+$", "")
        out = (
            F.when((comma > 0) & (dot > 0), F.when(comma < dot, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit(""))))
            .when(s.rlike(r"^[^.,]*[.,]\d{1,2}$"), F.replace(s, F.lit(","), F.lit(".")))
            .when(s.rlike(r"^\d+([.]\d{3})+[.]\d{2}$"), F.concat(bare(head), F.lit("."), tail))
            .otherwise(bare(s))
        )
        return F.when(out.rlike(r"^[+-]?\d+([.]\d+)?$"), out.try_cast(AMOUNT))

    return let(F.regexp_replace(F.trim(text), "[.,]+$", ""), read)


def numbers_in(text: Column, minimum: float = 1000) -> Column:
    """Distinct figures of at least ``minimum`` outside dates, sorted; empty for null."""
    found = F.regexp_extract_all(strip_dates(text), F.lit(r"\d[\d.,]*\d|\d"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, to_decimal), lambda d: d.isNotNull() & (F.abs(d) >= F.lit(minimum).cast(AMOUNT)))))


def contains_value(text: Column, variants: Column) -> Column:
    """Whether a text states a value in any of its spellings, by figure or literally."""
    low = F.lower(F.coalesce(text, F.lit("")))
    targets = F.filter(F.transform(variants, to_decimal), lambda d: d.isNotNull())
    literal = F.exists(variants, lambda v: F.contains(low, F.lower(v)))
    return (low != "") & (F.coalesce(F.arrays_overlap(targets, numbers_in(text, 0)), F.lit(False)) | literal)


def _any_of(text: Column, phrases: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def looks_like_refusal(text: Column) -> Column:
    return _any_of(text, REFUSALS)


def derivable(value: Column, grounded: Column, tolerance: float = 0.02) -> Column:
    """Whether a figure is grounded, or within the tolerance of a sum or difference of two grounded ones."""
    v = value.cast("double")
    near = lambda c: (c != 0) & (F.abs(v - c) <= tolerance * F.abs(c))
    known = F.filter(F.transform(grounded, lambda g: g.cast("double")), lambda g: g != 0)
    pair = F.exists(known, lambda a: F.exists(known, lambda b: near(a - b) | near(a + b)))
    return F.coalesce(F.array_contains(grounded, value), F.lit(False)) | F.coalesce(pair, F.lit(False))


def misattributed(report: Column, anchors: Column, competing: Column, correct: Column) -> Column:
    """Whether a sentence about the asked thing states a competing figure and no correct one, without comparing.

    Null if anchors, competing or correct figures are missing.
    """
    sentences = F.split(F.coalesce(report, F.lit("")), r"(?<=[.!?;:])\s+|\n+")

    def wrong(s: Column) -> Column:
        about = F.exists(anchors, lambda a: F.contains(F.lower(s), F.lower(a)))
        other = F.exists(competing, lambda c: contains_value(s, F.array(c)))
        return about & other & ~contains_value(s, correct) & ~_any_of(s, COMPARISONS)

    empty = lambda a: a.isNull() | (F.size(a) == 0)
    return F.when(~(empty(anchors) | empty(competing) | empty(correct)), F.exists(sentences, wrong))
