"""Parsed tables into fact tables, facts and attribute-value cells.

A payload is one parsed table: headers and rows of cells. Property sheets (two
columns, keys down the page) become one row first; then rows and headers are
exploded to cells, and roles, totals and labels are grouped aggregates over
them, so a table of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.archive import parse_date, parse_number
from ..functions.text import norm_col
from ..session import cut

PAYLOAD = (
    "table_uid string, doc_id string, source string, table_id string, sheet string, page int, doc_type string, year string, headers array<string>, "
    "rows array<struct<row:int,locator:string,cells:array<string>>>, n_rows_total int, n_rows_seen int, n_rows_indexed int"
)
# Column names by which a role is announced; the first pattern that fits wins.
ROLE_NAMES = [
    ("balance", "saldo|kontostand|endbestand|anfangsbestand|bestand|balance|runningtotal|laufend|kumuliert|cumulative|closing|opening"),
    ("rate", "prozent|percent|proz|(?<!um)satz$|quote|^rate|kurs$|marge|anteilin"),
    ("period", "^jahr|^year|geschaeftsjahr|^monat|^month|^quartal|^quarter|^periode|^period|^kw$|^woche|^week"),
    ("identifier", "nummer|^nr|nr$|number|^id$|beleg|konto|iban|bic|referenz|reference|kennzeichen|ustid|steuernummer|code$|kostenstelle"),
]
# Labels of rows that restate other rows; the second list only in tables without a date column.
TOTAL_LABELS = (
    r"(?i)^\s*(summe|zwischensumme|gesamtsumme|gesamt|insgesamt|total|subtotal|sum|bilanzsumme|ergebnis|betriebsergebnis|ebit|ebitda|"
    r"jahresueberschuss|jahresergebnis|grand total|net total|saldo)\b"
)
SUMMARY_LABELS = (
    r"(?i)^\s*(nettobetrag|nettosumme|bruttobetrag|rechnungsbetrag|gesamtbetrag|endbetrag|zu zahlen|zahlbetrag|umsatzsteuer|mehrwertsteuer|mwst|"
    r"net amount|gross amount|amount due|vat|tax total)\b"
)
#: share of filled cells that must read as a number or date
MOST = 0.6


def column_role(name: Column, n_num: Column, n_date: Column, n_values: Column) -> tuple[Column, Column]:
    """(role, kind) of a column from its catalogue name and what its cells read as."""
    n = F.greatest(n_values, F.lit(1))
    numeric, dated = n_num / n >= MOST, n_date / n >= MOST
    hint = F.lit(None).cast("string")
    for role, pattern in reversed(ROLE_NAMES):
        hint = F.when(name.rlike(pattern), role).otherwise(hint)
    role = (
        F.when(dated, "date")
        .when(hint == "balance", F.when(numeric, "balance").otherwise("label"))
        .when(hint.isNotNull(), hint)
        .when(numeric, "amount")
        .otherwise("label")
    )
    return role, F.when(numeric, "number").when(dated, "date").otherwise("text")


def unique_names(names: Column) -> Column:
    """Names of a list made unique: a repeat gets the least number from 2 that is free."""

    def add(used: Column, name: Column) -> Column:
        free = F.array_min(F.filter(F.sequence(F.lit(2), F.size(used) + 2), lambda k: ~F.array_contains(used, F.concat(name, k.cast("string")))))
        return F.concat(used, F.array(F.when(F.array_contains(used, name), F.concat(name, free.cast("string"))).otherwise(name)))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def is_property_sheet(headers: Column, rows: Column) -> Column:
    """Two columns, at least three keys, nearly all different, values partly numbers."""
    cell = lambda r, i: F.trim(F.coalesce(F.try_element_at(r["cells"], F.lit(i)), F.lit("")))
    keys = F.filter(F.transform(rows, lambda r: cell(r, 1)), lambda k: k != "")
    values = F.filter(F.transform(rows, lambda r: cell(r, 2)), lambda v: v != "")
    numbers = F.size(F.filter(values, lambda v: parse_number(v).isNotNull()))
    return (F.size(headers) == 2) & (F.size(keys) >= 3) & (F.size(F.array_distinct(keys)) > F.size(keys) * 0.9) & (numbers > 0) & (numbers < F.size(values))


def stand_up(payloads: DataFrame) -> DataFrame:
    """Property sheets turned into one row whose columns are their keys; adds ``layout``."""
    cell = lambda r, i: F.trim(F.coalesce(F.try_element_at(r["cells"], F.lit(i)), F.lit("")))
    filled = F.filter("rows", lambda r: cell(r, 1) != "")
    ends = [F.coalesce(F.element_at("rows", i)["locator"], F.lit("")) for i in (1, -1)]
    span = F.when((ends[0] != "") & (ends[1] != "") & (ends[0] != ends[1]), F.concat(ends[0], F.lit("–"), ends[1])).otherwise(ends[0])
    one = F.struct(F.element_at("rows", 1)["row"].alias("row"), span.alias("locator"), F.transform(filled, lambda r: cell(r, 2)).alias("cells"))
    p = payloads.where("size(headers) >= 2 and size(rows) > 0").withColumn("sheet_form", is_property_sheet(F.col("headers"), F.col("rows")))
    keep = lambda c, new: F.when(F.col("sheet_form"), new).otherwise(F.col(c)).alias(c)
    return p.select(
        "table_uid", "doc_id", "source", "table_id", "sheet", "page", "doc_type", "year", keep("headers", F.transform(filled, lambda r: cell(r, 1))), keep("rows", F.array(one)),
        keep("n_rows_total", F.lit(1)), keep("n_rows_seen", F.lit(1)), keep("n_rows_indexed", F.least("n_rows_indexed", F.lit(1))), F.when(F.col("sheet_form"), "keyvalue_record").otherwise("records").alias("layout"),
    )


def cells_of(payloads: DataFrame) -> DataFrame:
    """table_uid, row, locator, ordinal, pos, name, raw, text, num, date: every cell under a header, empty ones with text ''."""
    key = lambda h, i: F.coalesce(F.nullif(norm_col(h), F.lit("")), F.format_string("spalte%d", (i + 1).cast("int")))
    named = payloads.withColumn("headers", F.transform("headers", lambda h: F.trim(F.coalesce(h, F.lit(""))))).withColumn("names", unique_names(F.transform("headers", key)))
    rows = named.select("table_uid", "layout", "names", "headers", F.posexplode("rows").alias("ordinal", "r"))
    cells = rows.select("table_uid", "layout", "ordinal", F.col("r.row").alias("row"), F.col("r.locator").alias("locator"), F.col("r.cells").alias("cells"), F.posexplode(F.arrays_zip("names", "headers")).alias("pos", "h"))
    text = F.trim(F.coalesce(F.try_element_at("cells", F.col("pos") + 1), F.lit("")))
    read = cells.select("table_uid", "layout", "ordinal", "row", "locator", "pos", F.col("h.names").alias("name"), F.col("h.headers").alias("raw"), text.alias("text"))
    return read.withColumn("num", parse_number(F.col("text"))).withColumn("date", parse_date(F.col("text")))


def running_balances(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """table_uid, name of amount columns that behave as running balances.

    At least four values, and against some other amount column at least three
    rows of which four in five are the row before plus that column. The row
    before is joined by its number, so no task holds a whole table.
    """
    amounts = columns.where("role = 'amount' and kind = 'number'").select("table_uid", "pos", "name")
    v = cells.join(amounts, ["table_uid", "pos", "name"]).select("table_uid", "ordinal", "name", "num")
    enough = v.groupBy("table_uid", "name").agg(F.count("num").alias("n")).where("n >= 4").select("table_uid", "name")
    now = v.where("num is not null")
    before = now.select("table_uid", "name", (F.col("ordinal") + 1).alias("ordinal"), F.col("num").alias("prev"))
    step = now.join(enough, ["table_uid", "name"]).join(before, ["table_uid", "name", "ordinal"])
    other = now.select("table_uid", "ordinal", F.col("name").alias("other"), F.col("num").alias("delta"))
    tested = step.join(other, ["table_uid", "ordinal"]).where("name <> other")
    fit = tested.groupBy("table_uid", "name", "other").agg(F.count("*").alias("tested"), F.count_if(F.abs(F.col("prev") + F.col("delta") - F.col("num")) <= 0.01).alias("hits"))
    return fit.where("tested >= 3 and hits / tested >= 0.8").select("table_uid", "name").distinct()


def extract(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fact_tables, facts, fact_values) of parsed tables.

    Tables with fewer than two headers or no rows give nothing, blank rows no
    fact, empty cells no value. Totals are facts of row_kind 'total'. Fact ids
    are hashes of table and row, the same on every run.
    """
    flat = stand_up(payloads)
    cells = cut(cells_of(flat), "cells")  # read by every step below
    flat = cut(flat.drop("headers", "rows"), "tables")
    counted = cells.groupBy("table_uid", "pos", "name", "raw").agg(F.count("num").alias("n_num"), F.count("date").alias("n_date"), F.count_if(F.col("text") != "").alias("n_values"))
    role, kind = column_role(F.col("name"), F.col("n_num"), F.col("n_date"), F.col("n_values"))
    columns = counted.withColumn("role", role).withColumn("kind", kind)
    found = running_balances(cells, columns).withColumn("found", F.lit(True))
    columns = cut(columns.join(found, ["table_uid", "name"], "left").withColumn("role", F.when(F.col("found"), "balance").otherwise(F.col("role"))).drop("found"), "columns")
    per = columns.groupBy("table_uid").agg(
        F.sort_array(F.collect_list(F.struct("pos", "name", "raw", "role", "kind", "n_num", "n_date", "n_values"))).alias("columns"), F.bool_or(F.col("role") == "date").alias("has_date")
    )
    labelled = columns.where("role in ('label', 'identifier')").select("table_uid", "pos", F.lit(True).alias("names_row"))
    marked = cells.where("text <> ''").join(labelled, ["table_uid", "pos"], "left").join(per.select("table_uid", "has_date"), "table_uid")
    names = F.coalesce("names_row", F.lit(False))
    total = names & (F.col("text").rlike(TOTAL_LABELS) | ~F.col("has_date") & F.col("text").rlike(SUMMARY_LABELS)) & (F.col("layout") == "records")
    label = F.left(F.coalesce(F.min_by(F.when(names, F.col("text")), F.when(names, F.col("pos"))), F.lit("")), F.lit(200))
    fact_id = F.xxhash64("table_uid", "ordinal")
    facts = marked.groupBy("table_uid", "ordinal").agg(F.first("row").alias("row"), F.first("locator").alias("locator"), F.when(F.bool_or(total), "total").otherwise("data").alias("row_kind"), label.alias("label"))
    head = flat.select("table_uid", "doc_id", "source", "doc_type", "year", "layout")
    facts = facts.join(head, "table_uid").select(
        fact_id.alias("id"), "table_uid", "doc_id", "source", "row", F.coalesce("locator", F.lit("")).alias("locator"), "doc_type", "year", "row_kind", F.when((F.col("label") == "") & (F.col("layout") == "keyvalue_record"), F.col("source")).otherwise(F.col("label")).alias("label")
    )
    values = cells.where("text <> ''").select(fact_id.alias("fact_id"), "table_uid", F.col("name").alias("col"), "text", "num", "date")
    counts = facts.groupBy("table_uid").agg(F.count_if(F.col("row_kind") == "data").cast("int").alias("n_rows"), F.count_if(F.col("row_kind") == "total").cast("int").alias("n_total_rows"))
    tables = (
        flat.join(per.select("table_uid", F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["raw"].alias("raw"), c["role"].alias("role"), c["kind"].alias("kind"))).alias("columns")), "table_uid")
        .join(counts, "table_uid", "left")
        .fillna(0, ["n_rows", "n_total_rows"])
    )
    return tables, facts, values


def frame_columns(df: DataFrame, table_uid: str, id_col: str, roles: dict[str, str], label: str | None = None, source: str | None = None, uid_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, head) of an ordinary typed table taken as a fact table.

    rows: table_uid, id, row, locator, label and a struct cell_<column> of text,
    num and date per column of roles. head: the one row that all its tables have
    in the catalogue, without table_uid, doc_id and counts.
    """
    types = dict(df.dtypes)
    numeric = {c for c in roles if types[c].startswith(("int", "bigint", "double", "float", "decimal", "smallint"))}
    dated = {c for c in roles if types[c].startswith(("date", "timestamp"))}
    kind = lambda c: "number" if c in numeric else "date" if c in dated else "text"
    uid = F.concat(F.lit(table_uid + "/"), F.col(uid_col).cast("string")) if uid_col else F.lit(table_uid)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    cell = lambda c: F.struct(
        (iso(c) if c in dated else F.col(c).cast("string")).alias("text"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"), (iso(c) if c in dated else F.lit(None).cast("string")).alias("date")
    )
    rows = df.select(
        uid.alias("table_uid"), F.xxhash64(uid, F.col(id_col)).alias("id"), F.col(id_col).cast("int").alias("row"), F.concat(F.lit("row "), F.col(id_col).cast("string")).alias("locator"),
        (F.col(label).cast("string") if label else F.lit("")).alias("label"), *[cell(c).alias(f"cell_{c}") for c in roles],
    )
    columns = F.array(*[F.struct(F.lit(c.replace("_", "")).alias("name"), F.lit(c).alias("raw"), F.lit(r).alias("role"), F.lit(kind(c)).alias("kind")) for c, r in roles.items()])
    none = lambda t: F.lit(None).cast(t)
    head = df.sparkSession.range(1).select(
        F.lit(source or table_uid).alias("source"), none("string").alias("sheet"), none("int").alias("page"), F.lit("ledger").alias("doc_type"), none("string").alias("year"), F.lit(0).alias("n_total_rows"), F.lit("records").alias("layout"), columns.alias("columns")
    )
    return rows, head


def facts_of_frame(df: DataFrame, table_uid: str, id_col: str, roles: dict[str, str], label: str | None = None, source: str | None = None, uid_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fact_tables, facts, fact_values) of an ordinary typed table, without reading text back.

    roles names the columns to take over and their roles. With uid_col every
    value of that column is a table of its own (table_uid/value).
    """
    rows, head = frame_columns(df, table_uid, id_col, roles, label, source, uid_col)
    cells = F.array(*[F.struct(F.lit(c.replace("_", "")).alias("col"), f"cell_{c}.text", f"cell_{c}.num", f"cell_{c}.date") for c in roles])
    values = rows.select(F.col("id").alias("fact_id"), "table_uid", F.explode(cells).alias("c")).select("fact_id", "table_uid", "c.*").where("text is not null")
    facts = rows.select("id", "table_uid", "row", "locator", F.lit("data").alias("row_kind"), "label")
    counted = rows.groupBy("table_uid").agg(F.count("*").cast("int").alias("n"))
    tables = counted.join(F.broadcast(head)).select("table_uid", F.col("table_uid").alias("doc_id"), "source", "sheet", "page", "doc_type", "year", F.col("n").alias("n_rows"), F.col("n").alias("n_rows_indexed"), F.col("n").alias("n_rows_total"), F.col("n").alias("n_rows_seen"), "n_total_rows", "layout", "columns")  # one row
    return tables, facts, values
