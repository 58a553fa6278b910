"""Results as text: the answer first, then its provenance in bounded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import Result

TABLES_SHOWN, AVAILABLE_SHOWN = 8, 12
DOCUMENTS_LISTED, TABLES_LISTED = 1000, 25


def amount(v) -> str:
    """German notation; '—' for nothing."""
    if v is None:
        return "—"
    text = f"{int(v):,}" if float(v).is_integer() else f"{v:,.2f}"
    return text.translate(str.maketrans(",.", ".,"))


def render(r: Result) -> str:
    """Text of a result. Tables are listed by the rows they contributed, the rest is summed up."""
    lines = []
    if r.refused:
        lines += [f"REFUSED: {r.operation} of \"{r.column}\" ({r.role}): {r.error}"]
        if r.alternatives:
            lines.append("columns that can be added up: " + ", ".join(r.alternatives))
        if r.closing is not None and (c := r.closing.first()):
            lines.append(f"closing value: {amount(c.value)}" + (f" on {c.day}" if c.day else "") + f" ({c.locator})")
    elif not r.ok:
        lines.append(f"ERROR: {r.error}")
        if r.available is not None:
            lines += [f"  {x.source}: {x.column} [{x.role}]" for x in r.available.orderBy("source", "column").limit(AVAILABLE_SHOWN).collect()]
    else:
        lines.append(f"{r.operation}" + (f" of \"{r.column}\"" if r.column else "") + f" = {amount(r.value)}")
        lines.append(f"rows matched {r.matched_rows} of {r.scanned_rows}, totals excluded {r.totals_excluded}, tables {r.n_tables}, documents {r.n_documents}")
        lines += [f"  {g['key']}: {g['n_rows']} rows, {amount(g['total'])}" for g in r.groups]
        if r.groups_truncated:
            lines.append(f"  … {r.groups_truncated} more groups")
        if r.per_table is not None:
            shown = r.per_table.orderBy(F.desc("rows_matched"), "source", "table_uid").limit(TABLES_SHOWN).collect()
            lines += [f"  {t.source}" + (f" ({t.sheet})" if t.sheet else "") + f": {t.rows_matched} of {t.rows_total} rows, {amount(t.value)}" for t in shown]
            if r.n_tables > len(shown):
                lines.append(f"  … {r.n_tables - len(shown)} more tables with {r.matched_rows - sum(t.rows_matched for t in shown)} rows")
        if r.closing is not None:
            lines += [f"  {t.source}: {amount(t.value)}" + (f" on {t.day}" if t.day else "") for t in r.closing.orderBy("source", "table_uid").limit(TABLES_SHOWN).collect()]
    lines += [f"WARNING: {w}" for w in r.warnings] + [f"note: {n}" for n in r.notes]
    for what, found in r.overlap.items():
        if found:
            lines.append(f"{what.replace('_', ' ')}: " + ", ".join(found))
    return "\n".join(lines)


def inventory_text(inventory: DataFrame, stats, tables: DataFrame, doc_type: str = "", year: str = "", envelope: int = 20_000) -> str:
    """The documents of an inventory as text, then the tables that can be counted, with the roles of their columns.

    Lists are bounded; what is left out is counted in a last line.
    """
    n = inventory.count()
    if not n:
        return f"no document of type '{doc_type}' and year '{year}'; without these filters everything is listed"
    lines = [f"{stats.n_documents} documents, {stats.n_chunks} passages in the archive; {n} listed by these filters"]
    if stats.beyond_envelope:
        lines.append(f"WARNING: beyond {envelope} passages the first hit may be of the wrong type of document: compare its file name with the question before quoting a figure")
    status = "parse_status" in inventory.columns
    shown = inventory.limit(DOCUMENTS_LISTED).collect()
    for d in shown:
        mark = f" [!{d.parse_status}]" if status and d.parse_status not in (None, "ok") else ""
        lines.append(f"- {d.source} | {d.doc_type or 'other'} | {d.year or 'no year'} | {d.n_chunks} passages{mark}")
    if n > len(shown):
        lines.append(f"... {n - len(shown)} more documents")
    if status and not inventory.where("parse_status <> 'ok'").isEmpty():
        lines.append("note: documents marked [!partial] or [!error] could not be read completely")
    mine = tables.join(inventory.select("source").distinct(), "source", "left_semi")
    m = mine.count()
    if m:
        lines.append(f"{m} tables can be counted or added up exactly:")
        for t in mine.orderBy("source", "table_uid").limit(TABLES_LISTED).collect():
            where = t.sheet or (f"page {t.page}" if t.page else "")
            lines.append(f"- {t.source}" + (f" ({where})" if where else "") + f": {t.n_rows} rows | " + ", ".join(f"{c.raw} [{c.role}]" for c in t.columns))
        if m > TABLES_LISTED:
            lines.append(f"... {m - TABLES_LISTED} more tables; narrow by type or year")
        lines.append("an [amount] can be added up; of a [balance] ask for the closing value; [identifier] and [period] only label rows")
    return "\n".join(lines)
