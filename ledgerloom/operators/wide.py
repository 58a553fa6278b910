"""Attribute–value rows into wide tables with typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key, norm_col, strip
from ..functions.values import read_amount, read_date
from ..session import cut
from .skew import salted_join

CATALOGUE = "array<struct<name:string,raw:string,role:string,kind:string>>"


def catalogue(fact_tables: DataFrame) -> DataFrame:
    """table_uid, col, kind: one row per column of a table.

    Of several deliveries of a table the latest wins; a name listed twice keeps
    its last kind. Rows without table_uid or readable catalogue give nothing.
    """
    cols = fact_tables.select(key(F.col("table_uid")).alias("table_uid"), "loaded_at", F.posexplode(F.from_json("column_json", CATALOGUE)).alias("pos", "c"))
    return (
        cols.where("table_uid is not null and c.name is not null")
        .groupBy("table_uid", F.col("c.name").alias("col"))
        .agg(F.max_by("c.kind", F.struct("loaded_at", "pos")).alias("kind"))
    )


def cells(fact_values: DataFrame, columns: DataFrame) -> DataFrame:
    """fact_id, table_uid, col, kind, loaded_at, text, number, day, filled: one row per delivered cell.

    col is in catalogue spelling; number and day are the typed value, else what
    the text reads as. Cells of unknown tables or columns, without fact_id, and
    empty cells (blank text, no num, no date) are left out.
    """
    raw = fact_values.select(
        "fact_id", key(F.col("table_uid")).alias("table_uid"), norm_col(F.col("col")).alias("col"), F.nullif(strip(F.col("text")), F.lit("")).alias("text"), "num", F.nullif(strip(F.col("date")), F.lit("")).alias("date"), "loaded_at"
    ).where("fact_id is not null and (text is not null or num is not null or date is not null)")
    joined = salted_join(raw.withColumn("__k", F.concat_ws("\u0001", "table_uid", "col")), columns.select(F.concat_ws("\u0001", "table_uid", "col").alias("__k"), "kind"), "__k", "fact_id")
    number = F.when(F.col("kind") == "number", F.coalesce("num", read_amount(F.col("text"))))
    day = F.when(F.col("kind") == "date", F.coalesce(F.col("date").try_cast("date"), read_date(F.col("date")), read_date(F.col("text"))))
    return joined.select("fact_id", "table_uid", "col", "kind", "loaded_at", "text", number.alias("number"), day.alias("day"))


def cell_issues(fact_values: DataFrame, fact_tables: DataFrame) -> DataFrame:
    """fact_id, col, issue: cells that cannot be placed as they stand.

    'mistyped': a number or date cell with a value that reads as neither.
    'conflict': readable values of one cell differ. Repeated deliveries of the
    same value are no conflict.
    """
    c = cells(fact_values, catalogue(fact_tables))
    readable = F.when(F.col("kind") == "number", F.col("number").isNotNull()).when(F.col("kind") == "date", F.col("day").isNotNull()).otherwise(True)
    of_text = F.when(~F.col("kind").isin("number", "date") | F.col("kind").isNull(), F.col("text"))
    per = c.groupBy("fact_id", "col").agg(
        F.bool_or(~readable).alias("mistyped"),
        (F.min("number").isNotNull() & (F.min("number") != F.max("number")) | F.min("day").isNotNull() & (F.min("day") != F.max("day")) | F.min(of_text).isNotNull() & (F.min(of_text) != F.max(of_text))).alias("conflict"),
    )
    named = lambda flag: F.when(F.col(flag), F.lit(flag))
    return per.select("fact_id", "col", F.explode(F.array_compact(F.array(named("mistyped"), named("conflict")))).alias("issue"))


def kinds_of_tables(columns: DataFrame) -> DataFrame:
    """table_uid, table_kind, signature: tables of the same typed columns are of one kind, named by the hash of the list."""
    named = F.concat(F.col("col"), F.lit(":"), F.coalesce("kind", F.lit("text")))
    per = columns.where("col <> ''").groupBy("table_uid").agg(F.array_join(F.sort_array(F.collect_set(named)), "|").alias("signature"))
    return per.select("table_uid", F.left(F.md5("signature"), F.lit(12)).alias("table_kind"), "signature")


def attributes(columns: DataFrame, max_attributes: int = 20_000) -> list[tuple[str, str]]:
    """(column, kind) over the whole catalogue, sorted; raises beyond max_attributes.

    An attribute that has several kinds in different tables comes out once per kind.
    """
    rows = columns.where("col <> ''").select("col", F.coalesce("kind", F.lit("text")).alias("kind")).distinct().orderBy("col", "kind").limit(max_attributes + 1).collect()
    if len(rows) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes in one schema; wide_tables gives one per kind of table")
    return [(r.col, r.kind) for r in rows]


def pivot(cells: DataFrame, found: list[tuple[str, str]], block: int = 400) -> DataFrame:
    """fact_id, table_uid, n_cells and a typed column per attribute, one conditional aggregate each.

    Of duplicate cells the latest readable value wins, ties go to the larger
    value. More than ``block`` attributes are aggregated in blocks, each over
    its own cells, and joined by fact.
    """
    names = [n for n, _ in found]
    kind_of = F.coalesce("kind", F.lit("text"))

    def one(name: str, kind: str) -> Column:
        v = F.col({"number": "number", "date": "day"}.get(kind, "text"))
        mine = (F.col("col") == name) & (kind_of == kind) & v.isNotNull()
        out = f"{name}__{kind}" if names.count(name) > 1 or name in ("fact_id", "table_uid", "n_cells") else name
        return F.max_by(v, F.when(mine, F.struct("loaded_at", v.alias("v")))).alias(out)

    by = ["fact_id", "table_uid"]
    out = cells.groupBy(*by).agg(F.count("*").alias("n_cells"), *[one(n, k) for n, k in found[:block]])
    for a in range(block, len(found), block):
        part = found[a : a + block]
        out = out.join(cells.where(F.col("col").isin(*[n for n, _ in part])).groupBy(*by).agg(*[one(n, k) for n, k in part]), by, "left")
    return out


def wide_table(fact_values: DataFrame, fact_tables: DataFrame, max_attributes: int = 20_000, block: int = 400) -> DataFrame:
    """One row per fact of any table, one typed column per attribute (number double, date date, else string).

    The attribute list and types are discovered first from the catalogue. Of
    duplicate cells the latest readable value wins, ties go to the larger
    value. Facts without any readable cell do not come out. An attribute of
    several kinds gets a column per kind, with the kind as suffix; so does a
    clash with fact_id, table_uid or n_cells. The schema of a frame has its
    columns on the driver: beyond max_attributes this raises, and
    ``wide_tables`` is the way.
    """
    columns = catalogue(fact_tables)
    found = attributes(columns, max_attributes)
    c = cells(fact_values, columns)
    return pivot(cut(c, "cells") if len(found) > block else c, found, block)


def wide_tables(fact_values: DataFrame, fact_tables: DataFrame, block: int = 400) -> dict[str, DataFrame]:
    """table_kind -> one row per fact of the tables of that kind, with the columns of that kind only.

    Kinds are those of ``kinds_of_tables``; the rows are as in ``wide_table``.
    The cells are read and typed once for all kinds and written by kind. An
    empty catalogue gives no frames.
    """
    columns = catalogue(fact_tables)
    kinds = cut(kinds_of_tables(columns), "kinds")
    listed = {r.table_kind: r.signature for r in kinds.groupBy("table_kind").agg(F.min("signature").alias("signature")).collect()}  # one row a schema
    c = cut(cells(fact_values, columns).join(kinds.select("table_uid", "table_kind"), "table_uid").sortWithinPartitions("table_kind"), "cells")
    typed = lambda signature: [tuple(x.rsplit(":", 1)) for x in signature.split("|")]
    return {k: pivot(c.where(F.col("table_kind") == k), typed(s), block) for k, s in sorted(listed.items())}
