"""Which column of which fact table a request means, decided over the catalogue as a DataFrame."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: roles whose columns are no quantities that add up, and why
UNSUMMABLE = {
    "balance": "every row is the state after a booking; only the last one is the balance",
    "identifier": "a number that names something has no sum",
    "rate": "shares of different wholes do not add up without their weights",
    "period": "years, quarters and the like say when, not how much",
    "date": "days have no sum",
    "label": "words have no sum",
}
OPERATIONS = ("count", "sum", "average", "min", "max", "distinct", "breakdown", "closing")
ALIASES = {"avg": "average", "mean": "average"}
NO_MATCH = 99
CATALOGUE = "array<struct<name:string,raw:string,role:string,kind:string>>"


def plain_name(name: str) -> str:
    """Catalogue spelling of a name typed by a user."""
    s = unicodedata.normalize("NFKD", name or "").replace("ß", "ss")
    return re.sub(r"[^0-9a-z]", "", s.lower())


def closeness(requested: str, name: Column) -> Column:
    """0 the same, 1 one begins the other, 2 one holds the other, 3 a word of three letters in common, else NO_MATCH."""
    want = plain_name(requested)
    if not want:
        return F.lit(NO_MATCH)
    w = F.lit(want)
    both = lambda test: F.coalesce((name != "") & (test(name, w) | test(w, name)), F.lit(False))
    words = sorted(set(re.findall("[a-z]{3,}", want)))
    shared = F.arrays_overlap(F.regexp_extract_all(name, F.lit("([a-z]{3,})"), F.lit(1)), F.array(*map(F.lit, words))) if words else F.lit(False)
    return F.when(name == w, 0).when(both(F.startswith), 1).when(both(F.contains), 2).when(shared, 3).otherwise(NO_MATCH)


def with_columns(fact_tables: DataFrame) -> DataFrame:
    """The catalogue with ``columns`` as nested rows, whether it came as JSON text (column_json) or nested."""
    if "columns" in fact_tables.columns:
        return fact_tables
    return fact_tables.withColumn("columns", F.coalesce(F.from_json("column_json", CATALOGUE), F.array().cast(CATALOGUE)))


def first_of(columns: Column, test) -> Column:
    """First column of a table's list that passes the test, null if none."""
    return F.try_element_at(F.filter(columns, test), F.lit(1))


def closest(columns: Column, requested: str) -> tuple[Column, Column]:
    """(closeness, columns that reach it) of a table's list."""
    best = F.coalesce(F.array_min(F.transform(columns, lambda c: closeness(requested, c["name"]))), F.lit(NO_MATCH))
    return best, F.when(best < NO_MATCH, F.filter(columns, lambda c: closeness(requested, c["name"]) == best))


def signature(columns: Column) -> Column:
    """What kind of record a table's rows are: its sorted column names."""
    return F.array_join(F.array_sort(F.transform(columns, lambda c: c["name"])), "|")
