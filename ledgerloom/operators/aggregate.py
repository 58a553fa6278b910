"""Exact aggregation over attribute-value facts.

Every request is one plan: the catalogue decides which column of which table is
meant, fact values are cut to those columns and turned into one row per fact by
a single conditional aggregation, and the result is grouped per table. Sums and
counts cover every matching row; totals are left out; an operation that no
matching column allows is refused with the columns that do.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.archive import parse_number, period_range
from ..plans.columns import ALIASES, NO_MATCH, OPERATIONS, UNSUMMABLE, closest, first_of, signature, with_columns
from ..session import cut
from .extract import frame_columns, facts_of_frame

MONEY = "decimal(38,4)"
EMPTY = "(leer)"
LISTED = 25


@dataclass(frozen=True)
class Request:
    """The closed vocabulary of a query; empty text means not given."""

    operation: str
    column: str = ""
    source: str = ""
    doc_type: str = ""
    year: str = ""
    where_column: str = ""
    where_value: str = ""
    period: str = ""
    exact: bool = False  # where_value must be the whole text

    @property
    def op(self) -> str:
        op = self.operation.strip().lower()
        return ALIASES.get(op, op)


@dataclass
class Result:
    """Answer with its provenance. Frames stay distributed; lists are bounded."""

    ok: bool
    operation: str
    value: float | int | None = None
    error: str = ""
    refused: bool = False
    role: str = ""
    column: str = ""
    alternatives: list[str] = field(default_factory=list)
    matched_rows: int = 0
    scanned_rows: int = 0
    totals_excluded: int = 0
    n_documents: int = 0
    n_tables: int = 0
    per_table: DataFrame | None = None
    groups: list[dict] = field(default_factory=list)
    groups_truncated: int = 0
    closing: DataFrame | None = None
    overlap: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    available: DataFrame | None = None


class FactStore:
    """Facts of any number of tables: catalogue, facts, values and optionally documents.

    Rows delivered twice count once: a fact by its id, of the deliveries of a
    table the latest, of the values of a cell the greatest.
    """

    def __init__(self, fact_tables: DataFrame, facts: DataFrame, fact_values: DataFrame, documents: DataFrame | None = None):
        t = with_columns(fact_tables).where("table_uid is not null")
        if "loaded_at" in t.columns:
            latest = Window.partitionBy("table_uid").orderBy(F.col("loaded_at").desc_nulls_last())
            t = t.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
        self.tables = t
        self.facts = facts.withColumnsRenamed({"row_no": "row", "fact_id": "id"}).where("id is not null and table_uid is not null").select("id", "table_uid", "row", "locator", "row_kind", "label").dropDuplicates(["id"])
        self.values = fact_values.where("fact_id is not null").select("fact_id", "table_uid", "col", "text", "num", "date")
        self.documents = documents

    # ── scope and columns ────────────────────────────────────────────────────

    def scope(self, r: Request, among: DataFrame | None = None) -> DataFrame:
        """Tables in scope, of all or ``among`` some: source contains (any case), type and year equal."""
        t = self.tables if among is None else among
        if r.source:
            t = t.where(F.contains(F.lower("source"), F.lower(F.lit(r.source))))
        if r.doc_type:
            t = t.where(F.col("doc_type") == r.doc_type)
        return t.where(F.col("year") == r.year) if r.year else t

    def matched(self, r: Request, among: DataFrame | None = None) -> DataFrame:
        """Tables in scope with ``near`` and the closest ``columns`` for the request, their filter columns and why they are skipped."""
        near, candidates = closest(F.col("columns"), r.column) if r.column else (F.lit(0), F.lit(None).cast("array<struct<name:string,raw:string,role:string,kind:string>>"))
        t = self.scope(r, among).withColumn("near", near).withColumn("candidates", candidates).where(F.col("near") < NO_MATCH)
        t = t.withColumn("measure", F.try_element_at("candidates", F.lit(1)))
        found = closest(F.col("columns"), r.where_column)[1] if r.where_column and r.where_value else F.lit(None).cast(t.schema["columns"].dataType)
        role = lambda name: first_of(F.col("columns"), lambda c: c["role"] == name)
        t = t.withColumn("where_col", F.try_element_at(found, F.lit(1))).withColumn("date_col", role("date")).withColumn("amount_col", role("amount"))
        skip: Column = F.lit(None).cast("string")
        if r.period:
            skip = F.when(F.col("date_col").isNull(), "no date column") if period_range(r.period) else F.lit(f"'{r.period}' is not a period (try '2025', 'Q3 2025' or '2025-07')")
        if r.where_column and r.where_value:
            skip = F.when(F.col("where_col").isNull(), f"no column like '{r.where_column}'").otherwise(skip)
        return t.withColumn("skip", skip)

    def resolve(self, r: Request) -> DataFrame:
        """Only the tables that match as closely as the closest one."""
        t = self.matched(r)
        if not r.column:
            return t
        best = t.agg(F.min("near").alias("near")).first().near
        return t.where(F.col("near") == F.lit(NO_MATCH if best is None else best))

    # ── rows ─────────────────────────────────────────────────────────────────

    def rows(self, r: Request, tables: DataFrame) -> DataFrame:
        """One row per matching fact: table_uid, id, row, locator, num, text, day, amount.

        Facts without the measure stay, with nulls.
        """
        use = tables.where("skip is null").select(
            "table_uid", F.col("measure.name").alias("m"), F.col("where_col.name").alias("w"), F.col("where_col.kind").alias("wk"), F.col("date_col.name").alias("d"), F.col("amount_col.name").alias("a")
        )
        # only the columns in question leave the scan: a hot table spreads over its columns, and further by AQE where it is skewed
        wanted = use.select("*", F.explode(F.array_distinct(F.array_compact(F.array("m", "w", "d", "a")))).alias("col"))
        mine = self.values.join(wanted, ["table_uid", "col"])
        pick = lambda flag, value: F.max(F.when(F.col("col") == F.col(flag), F.col(value)))
        cells = mine.groupBy("fact_id").agg(
            pick("m", "num").alias("num"), pick("m", "text").alias("text"), pick("w", "num").alias("wnum"), pick("w", "text").alias("wtext"), pick("d", "date").alias("day"), pick("a", "num").alias("amount")
        )
        out = self.facts.where("row_kind = 'data'").join(use.select("table_uid", "wk"), "table_uid").join(cells, F.col("id") == F.col("fact_id"), "left")
        return self._passing(r, out)

    @staticmethod
    def _passing(r: Request, out: DataFrame) -> DataFrame:
        """The rows that pass the filters of a request; of rows with their cells and the kind wk of the filter column."""
        if r.where_column and r.where_value:
            low = F.lower("wtext")
            want = F.lower(F.lit(r.where_value))
            text = (low == want) if r.exact else ((low == want) | F.contains(low, want))
            number = parse_number(F.lit(r.where_value))
            out = out.where(F.when((F.col("wk") == "number") & number.isNotNull(), F.col("wnum") == number).otherwise(text))
        if r.period and (span := period_range(r.period)):
            out = out.where(F.col("day").between(*span))
        return out.select("table_uid", "id", "row", "locator", "num", "text", "day", "amount")

    @staticmethod
    def _value(op: str) -> Column:
        total = F.sum(F.col("num").cast(MONEY))
        return {
            "count": F.count("*").cast("double"),
            "sum": F.round(total, 2).cast("double"),
            "average": F.round(total / F.count("num"), 2).cast("double"),
            "min": F.min("num"),
            "max": F.max("num"),
            "distinct": F.count_distinct(F.nullif("text", F.lit(""))).cast("double"),
        }[op]

    def per_table(self, r: Request, tables: DataFrame) -> DataFrame:
        """table_uid, source, sheet, column, role, rows_total, rows_matched, rows_indexed, totals_excluded, value."""
        value = self._value("count" if r.op in ("breakdown", "closing") else r.op)
        agg = self.rows(r, tables).groupBy("table_uid").agg(F.count("*").alias("rows_matched"), value.alias("value"), F.sum(F.col("num").cast(MONEY)).alias("num_sum"), F.count("num").alias("num_count"))
        t = tables.where("skip is null").join(agg, "table_uid", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        value = F.coalesce("value", F.lit(0.0)) if r.op in ("count", "distinct", "breakdown") else F.col("value")
        return t.select(
            "table_uid", "source", "sheet", "doc_id", F.coalesce("measure.raw", F.lit("")).alias("column"), F.coalesce("measure.role", F.lit("")).alias("role"), F.coalesce("layout", F.lit("records")).alias("layout"),
            signature(F.col("columns")).alias("signature"), F.col("n_rows").alias("rows_total"), zero("rows_matched").alias("rows_matched"), F.col("n_rows_indexed").alias("rows_indexed"),
            F.col("n_total_rows").alias("totals_excluded"), (zero("n_rows_total") > zero("n_rows_seen")).alias("capped"), value.alias("value"), "num_sum", "num_count",
        )

    def total(self, r: Request, tables: DataFrame) -> DataFrame:
        """matched_rows, value over the rows of all tables together (a pooled mean, distinct across tables)."""
        return self.rows(r, tables).agg(F.count("*").alias("matched_rows"), self._value(r.op).alias("value"))

    def breakdown(self, r: Request, tables: DataFrame) -> DataFrame:
        """key, n_rows, total: rows per text of the column and the sum of each table's first amount column.

        Facts without the column count under '(leer)' without a sum.
        """
        blank = F.coalesce(F.nullif("text", F.lit("")), F.lit(EMPTY))
        money = F.sum(F.when(F.col("text").isNotNull(), F.col("amount").cast(MONEY)))
        return self.rows(r, tables).groupBy(F.trim(blank).alias("key")).agg(F.count("*").alias("n_rows"), F.round(money, 2).cast("double").alias("total"))

    def closing(self, r: Request, tables: DataFrame) -> DataFrame:
        """table_uid, value, day, locator: last value of the column per table, by date and then row; never the largest, never added up."""
        last = F.max_by(F.struct("num", "day", "locator"), F.struct("day", "row"))
        per = self.rows(r, tables).where("num is not null").groupBy("table_uid").agg(last.alias("c"))
        return per.select("table_uid", F.col("c.num").alias("value"), "c.day", "c.locator")

    # ── reports ──────────────────────────────────────────────────────────────

    def available_columns(self) -> DataFrame:
        return self.tables.select("source", "sheet", F.explode("columns").alias("c")).select("source", "sheet", F.col("c.raw").alias("column"), F.col("c.role").alias("role"))

    def stats(self) -> DataFrame:
        """n_tables, n_rows: tables and data rows."""
        rows = self.facts.where("row_kind = 'data'").agg(F.count("*").alias("n_rows"))
        return self.tables.agg(F.count("*").alias("n_tables")).join(rows)

    def documents_without_rows(self, doc_type: str, covered: DataFrame) -> DataFrame:
        """Documents of the type that contributed no table."""
        return self.documents.where(F.col("doc_type") == doc_type).join(covered.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "source")

    def shared_identifiers(self, tables: DataFrame) -> DataFrame:
        """text, n_tables: identifier values that stand in more than one of the tables."""
        ids = tables.select("table_uid", F.explode("columns").alias("c")).where("c.role = 'identifier'").select("table_uid", F.col("c.name").alias("col"))
        seen = self.values.join(ids, ["table_uid", "col"]).where("text <> ''").select("text", "table_uid").distinct()
        return seen.groupBy("text").agg(F.count("*").alias("n_tables")).where("n_tables > 1")

    # ── the request ──────────────────────────────────────────────────────────

    def aggregate(self, operation: str, **scope) -> Result:
        """Run one request. Errors, refusals and warnings are part of the result, never exceptions."""
        r = Request(operation, **scope)
        op = r.op
        if op not in OPERATIONS:
            return Result(False, op, error=f"unknown operation '{operation}'; one of {', '.join(OPERATIONS)}")
        if self.scope(r).isEmpty():
            return Result(False, op, error="no table matches that scope", available=self.available_columns())
        if op != "count" and not r.column:
            return Result(False, op, error=f"'{op}' needs a column", available=self.available_columns())
        tables = self.resolve(r)
        seen = tables.groupBy(F.col("measure.role").alias("role"), "skip").agg(F.count("*").alias("n"), F.count_if(F.size("candidates") > 1).alias("many"), F.min("measure.raw").alias("raw")).orderBy("skip", "role").collect()
        roles = {x.role for x in seen}
        if not seen:
            return Result(False, op, error=f"no column like '{r.column}' in the tables of that scope", available=self.available_columns())
        if op in ("sum", "average") and all(role in UNSUMMABLE for role in roles):
            return self._refused(r, tables)
        if op == "closing":
            return self._closed(r, tables, seen)
        per = cut(self.per_table(r, tables), "per_table")
        facts = per.agg(
            F.count("*").alias("n"), F.sum("rows_matched").alias("matched"), F.sum("rows_total").alias("scanned"), F.sum("totals_excluded").alias("excluded"), F.count_distinct("doc_id").alias("docs"),
            F.count_distinct("signature").alias("shapes"), F.sum("num_sum").alias("num_sum"), F.sum("num_count").alias("num_count"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if("capped").alias("capped"), F.count_if(F.col("layout") == "keyvalue").alias("sheets"), F.count_if(F.col("rows_indexed") < F.col("rows_total") + F.col("totals_excluded")).alias("thin"),
        ).first()
        warnings = self._skipped(r, tables, seen)
        if not facts.n:
            return Result(False, op, error="the filter could not be applied to any table in scope - this is NOT a count of zero", warnings=warnings)
        out = Result(True, op, matched_rows=facts.matched or 0, scanned_rows=facts.scanned or 0, totals_excluded=facts.excluded or 0, n_documents=facts.docs, n_tables=facts.n, per_table=per, warnings=warnings)
        out.column = min((x.raw for x in seen if x.raw and x.skip is None), default="")
        if op == "breakdown":
            groups = self.breakdown(r, tables)
            out.value = groups.count()
            out.groups = [g.asDict() for g in groups.orderBy(F.desc("n_rows"), "key").limit(LISTED).collect()]
            out.groups_truncated = max(0, out.value - LISTED)
            return out
        if op == "distinct":
            out.value = int(self.total(r, tables).first().value or 0)
        elif op in ("sum", "average"):
            pooled = None if facts.num_sum is None else facts.num_sum if op == "sum" else facts.num_sum / facts.num_count
            out.value = None if pooled is None else float(pooled.quantize(Decimal("0.01"), ROUND_HALF_UP))
        else:
            out.value = {"count": out.matched_rows, "min": facts.least, "max": facts.most}[op]
        if facts.capped:
            warnings.append(f"{facts.capped} table(s) exceeded the row cap: this figure is a LOWER BOUND")
        if op in ("sum", "average") and facts.n > 1:
            warnings.append(f"this figure COMBINES {facts.n} tables; check in the per-table figures that they measure the same")
        if op in ("sum", "average") and (other := sorted(roles - {"amount"})):
            warnings.append(f"some matched columns are not amounts ({', '.join(other)})")
        if op == "count" and facts.sheets:
            warnings.append(f"{facts.sheets} table(s) are property sheets: their ROWS ARE FIELDS, NOT RECORDS; there are {facts.docs} documents")
        if facts.shapes > 1:
            warnings.append(f"these {facts.n} tables have DIFFERENT columns, so their rows are not of one kind")
        if op != "count" and (many := sum(x.many for x in seen)):
            warnings.append(f"in {many} table(s) several columns match '{r.column}'; the first was taken")
        if facts.thin:
            out.notes.append(f"{facts.thin} table(s) have more rows than are searchable; this figure covers all of them")
        if r.doc_type and self.documents is not None:
            missing = self.documents_without_rows(r.doc_type, per)
            out.overlap["documents_without_rows"] = [x.source for x in missing.orderBy("source").limit(LISTED).collect()]
        if facts.n > 1:
            out.overlap["identifiers_in_multiple_tables"] = [x.text for x in self.shared_identifiers(tables).orderBy("text").limit(LISTED).collect()]
        return out

    def _skipped(self, r: Request, tables: DataFrame, seen: list) -> list[str]:
        """Reasons for which tables were left out, each with their number."""
        why: dict[str, int] = {}
        for x in seen:
            if x.skip is not None:
                why[x.skip] = why.get(x.skip, 0) + x.n
        out = [f"{n} table(s) skipped: {reason}" for reason, n in why.items()]
        if r.column and (n := self.matched(r).count() - sum(x.n for x in seen)):
            out.append(f"{n} table(s) matched '{r.column}' only loosely and are NOT included")
        return out

    def _refused(self, r: Request, tables: DataFrame) -> Result:
        first = tables.orderBy("source", "sheet", "table_uid").limit(1)
        t = first.first()
        role = t.measure.role
        out = Result(False, r.op, refused=True, role=role, column=t.measure.raw, error=UNSUMMABLE[role], alternatives=[c.raw for c in t.columns if c.role == "amount"])
        if role == "balance":
            out.closing = self.closing(r, first)
        return out

    def _closed(self, r: Request, tables: DataFrame, seen: list) -> Result:
        got = self.closing(r, tables).join(tables.select("table_uid", "source", "sheet", F.col("measure.raw").alias("column"), F.col("measure.role").alias("role")), "table_uid")
        got = cut(got, "closing")
        n = got.count()
        warnings = self._skipped(r, tables, seen)
        if not n:
            return Result(False, "closing", error="no closing value could be read for that column", warnings=warnings)
        if n > 1:
            warnings.append(f"{n} tables have this column; closing values of different accounts must not be added")
        for x in got.where("role not in ('balance', 'amount')").select("role").distinct().collect():
            warnings.append(f"a last value of a {x.role} column is not a closing balance")
        first = got.orderBy("source", "sheet", "table_uid").first()
        return Result(True, "closing", value=first.value, column=first.column, matched_rows=n, n_tables=n, closing=got, warnings=warnings)


class FrameStore(FactStore):
    """An ordinary typed table as a fact table: requests read its columns as they are, without attribute-value rows.

    Takes the arguments of ``facts_of_frame`` and gives the same results as a
    FactStore over what that returns. Which column is meant is decided over the
    one-row catalogue; the rows are then a projection of the table, so an
    aggregate is one scan of the columns in question and one partial
    aggregation.
    """

    def __init__(self, df: DataFrame, table_uid: str, id_col: str, roles: dict[str, str], label: str | None = None, source: str | None = None, uid_col: str | None = None, documents: DataFrame | None = None):
        super().__init__(*facts_of_frame(df, table_uid, id_col, roles, label, source, uid_col), documents)
        self.base, self.head = frame_columns(df, table_uid, id_col, roles, label, source, uid_col)
        self.raw = {c.replace("_", ""): c for c in roles}

    def resolve(self, r: Request) -> DataFrame:
        """All tables have the same columns, so one row of the catalogue decides for all."""
        return self.matched(r)

    def rows(self, r: Request, tables: DataFrame) -> DataFrame:
        mine = FactStore.matched(self, r, self.head).where("skip is null").select(F.col("measure.name").alias("m"), "where_col", F.col("date_col.name").alias("d"), F.col("amount_col.name").alias("a")).first()
        none = F.lit(None)
        cell = lambda name, field: self.base[f"cell_{self.raw[name]}"][field] if name else none
        if mine is None:
            m = w = d = a = None
        else:
            m, w, d, a = mine.m, mine.where_col and mine.where_col.name, mine.d, mine.a
        out = self.base.select(
            "table_uid", "id", "row", "locator", cell(m, "num").cast("double").alias("num"), cell(m, "text").cast("string").alias("text"), cell(w, "num").cast("double").alias("wnum"), cell(w, "text").cast("string").alias("wtext"),
            cell(d, "date").cast("string").alias("day"), cell(a, "num").cast("double").alias("amount"), F.lit(mine.where_col.kind if w else None).cast("string").alias("wk"),
        )
        return self._passing(r, out if mine is not None else out.where("false"))
