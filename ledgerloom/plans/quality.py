"""Registered queries on the archive's own records: orphans, wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import Reference, orphan_references
from ..operators.wide import catalogue, cell_issues, kinds_of_tables, wide_table, wide_tables
from ..session import table


def archive_references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    """The references of the archive's tables."""
    t = lambda n: table(spark, sf_dir, n)
    facts = t("facts")
    return [
        Reference("chunks", t("chunks"), "doc_id", "loaded_at", t("archive_docs"), "doc_id", "ingested_at", "deleted_at"),
        Reference("facts", facts, "table_uid", "loaded_at", t("fact_tables"), "table_uid", "loaded_at", "deleted_at"),
        Reference("fact_values", t("fact_values"), "fact_id", "loaded_at", facts, "id", "loaded_at"),
        Reference("audit_log", t("audit_log"), "thread_id", "created_at", t("threads"), "thread_id", "created_at", "deleted_at"),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(archive_references(spark, sf_dir)).select("child_table", "ref_key", "period", "state")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan keys and references per table, month and state."""
    return orphan_references(archive_references(spark, sf_dir)).groupBy("child_table", "period", "state").agg(F.count("*").alias("n_keys"), F.sum("n_refs").alias("n_refs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_issues(table(spark, sf_dir, "fact_values"), table(spark, sf_dir, "fact_tables"))


def p6_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attribute list with types that the wide table is built from."""
    return catalogue(table(spark, sf_dir, "fact_tables")).groupBy("col", "kind").agg(F.count("*").alias("n_tables"))


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per fact; dates as the timestamp of their midnight, as the comparison with SQL reads them."""
    wide = wide_table(table(spark, sf_dir, "fact_values"), table(spark, sf_dir, "fact_tables"))
    return wide.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "date" else F.col(c) for c, k in wide.dtypes])


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of tables with their typed columns, tables and wide rows: each kind's rows have the columns of that kind only."""
    tables = table(spark, sf_dir, "fact_tables")
    kinds = kinds_of_tables(catalogue(tables)).groupBy("table_kind", "signature").agg(F.count("*").alias("n_tables"))
    per = [w.agg(F.count("*").alias("n_facts"), F.sum("n_cells").alias("n_cells")).select(F.lit(k).alias("table_kind"), F.lit(len(w.columns) - 3).alias("n_columns"), "n_facts", "n_cells") for k, w in wide_tables(table(spark, sf_dir, "fact_values"), tables).items()]
    if not per:
        return kinds.selectExpr("signature", "n_tables", "0 n_columns", "0L n_facts", "0L n_cells")
    rows = per[0]
    for more in per[1:]:
        rows = rows.unionByName(more)
    return kinds.join(rows, "table_kind").select("signature", "n_tables", "n_columns", "n_facts", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p6_found": p6_found, "p6_catalogue": p6_catalogue, "p6_wide": p6_wide, "p6_kinds": p6_kinds}

_BLANKS = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"
_KEY = "nullif(lower(trim({c}, " + _BLANKS + ")), '')"


def _child(name: str, ref: str, at: str) -> str:
    return f"select '{name}' child_table, {_KEY.format(c=f'cast({ref} as varchar)')} ref_key, strftime({at}, '%Y-%m') period, {at} happened from {name}"


def _parent(name: str, parent: str, key: str, since: str, deleted: str) -> str:
    return f"select '{name}' child_table, {_KEY.format(c=f'cast({key} as varchar)')} ref_key, min({since}) since, bool_and({deleted}) gone from {parent} group by 1, 2"


_ORPHANS = f"""
with child as ({_child('chunks', 'doc_id', 'loaded_at')} union all {_child('facts', 'table_uid', 'loaded_at')}
  union all {_child('fact_values', 'fact_id', 'loaded_at')} union all {_child('audit_log', 'thread_id', 'created_at')}),
parent as ({_parent('chunks', 'archive_docs', 'doc_id', 'ingested_at', 'deleted_at is not null')}
  union all {_parent('facts', 'fact_tables', 'table_uid', 'loaded_at', 'deleted_at is not null')}
  union all {_parent('fact_values', 'facts', 'id', 'loaded_at', 'false')}
  union all {_parent('audit_log', 'threads', 'thread_id', 'created_at', 'deleted_at is not null')}),
graded as (select c.child_table, c.ref_key, c.period, case when p.gone is null then 'missing' when p.gone then 'deleted' when p.since > c.happened then 'late' end state
  from child c left join parent p on p.child_table = c.child_table and p.ref_key = c.ref_key where c.ref_key is not null)
"""

_CATALOGUE = f"""
with cat as (select table_uid, col, arg_max(kind, (loaded_at, pos)) kind from (
  select {_KEY.format(c='table_uid')} table_uid, loaded_at, c.name col, c.kind kind, pos from (
    select table_uid, loaded_at, unnest(cols) c, generate_subscripts(cols, 1) pos from (
      select table_uid, loaded_at, from_json(column_json, '[{{"name":"VARCHAR","raw":"VARCHAR","role":"VARCHAR","kind":"VARCHAR"}}]') cols from fact_tables)))
  where table_uid is not null and col is not null group by 1, 2)"""

_CELLS = f"""{_CATALOGUE},
raw as (select fact_id, {_KEY.format(c='table_uid')} table_uid,
    regexp_replace(strip_accents(replace(lower(col), 'ß', 'ss')), '[^0-9a-z]', '', 'g') col, loaded_at,
    nullif(trim("text", {_BLANKS}), '') txt, num, nullif(trim("date", {_BLANKS}), '') d from fact_values),
known as (select r.*, c.kind from raw r join cat c on c.table_uid = r.table_uid and c.col = r.col
  where fact_id is not null and (txt is not null or num is not null or d is not null)),
marked as (select *, regexp_replace(regexp_replace(regexp_replace(txt, '^([+-]?|[(]) *(EUR|€) *', '\\1', 'i'), ' *(EUR|€) *([)]?)$', '\\2', 'i'), '^[(]([^()+-]*)[)]$', '-\\1') s from known),
bare as (select *, case when s like '-%' then -1.0 else 1.0 end sign, trim(regexp_replace(s, '^[+-] *', '')) b from marked),
typed as (select fact_id, table_uid, loaded_at, col, kind, txt,
  case when kind = 'number' then coalesce(num, cast(sign * case
    when regexp_matches(b, '^[0-9]+$') then try_cast(b as double)
    when regexp_matches(b, '^[1-9][0-9]{{0,2}}([.][0-9]{{3}})+(,[0-9]+)?$') then try_cast(replace(replace(b, '.', ''), ',', '.') as double)
    when regexp_matches(b, '^[1-9][0-9]{{0,2}}(,[0-9]{{3}})+([.][0-9]+)?$') then try_cast(replace(b, ',', '') as double)
    when regexp_matches(b, '^[1-9][0-9]{{0,2}}( [0-9]{{3}})+([.,][0-9]+)?$') then try_cast(replace(replace(b, ' ', ''), ',', '.') as double)
    when regexp_matches(b, '^[0-9]*[.,][0-9]+$') then try_cast(replace(b, ',', '.') as double) end as double)) end number,
  case when kind = 'date' then coalesce(try_cast(d as date), case
    when regexp_matches(txt, '^([0-9]+-[0-9]+-[0-9]+|[0-9]+/[0-9]+/[0-9]+)') and regexp_matches(txt, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}( [0-9:]+)?$')
      then try_cast(replace(regexp_extract(txt, '^[0-9/-]+'), '/', '-') as date)
    when regexp_matches(txt, '^([0-9]+/[0-9]+/|[0-9]+[.][0-9]+[.])[0-9]{{4}}( [0-9:]+)?$')
      then try_cast(regexp_replace(txt, '^([0-9]+).([0-9]+).([0-9]{{4}}).*$', '\\3-\\2-\\1') as date) end) end dy
  from bare)"""

#: columns of the archive's tables by type, for the SQL of the wide table only
_COLUMNS = {
    "number": "2023eur 2024eur abweichung amounteur betrageur geschaftsjahr ist2025eur laufzeitmonate monatsrateeur nettobetrageur plan2025eur prixunitaireeur quantite saldoeur version",
    "dy": "beginn buchungsdatum datum echeance ende falligam valuedate",
    "txt": "belegnr belegnummer bezeichnung counterparty designation dokumenttyp konto kunde kundigung partner position posten quartal rechnungsnummer reference status strasse vertragsnummer verwendungszweck wahrung",
}
_WIDE = ", ".join(f"""cast(arg_max({v}, (loaded_at, {v})) filter (col = '{n}' and {v} is not null) as {'timestamp' if v == 'dy' else 'double' if v == 'number' else 'varchar'}) \"{n}\"""" for v, names in _COLUMNS.items() for n in names.split())

ORACLE = {
    "p2_found": _ORPHANS + "select distinct child_table, ref_key, period, state from graded where state is not null",
    "p2_report": _ORPHANS
    + """, keyed as (select child_table, ref_key, period, bool_or(state = 'missing') m, bool_or(state = 'deleted') d, bool_or(state = 'late') l, count(*) n from graded group by 1, 2, 3)
select child_table, period, case when m then 'missing' when d then 'deleted' else 'late' end state, count(*) n_keys, cast(sum(n) as bigint) n_refs from keyed where m or d or l group by 1, 2, 3""",
    "p6_found": _CELLS
    + """, per as (select fact_id, col,
  bool_or(case when kind = 'number' then number is null when kind = 'date' then dy is null else false end) mistyped,
  count(distinct number) > 1 or count(distinct dy) > 1 or count(distinct case when kind not in ('number', 'date') then txt end) > 1 conflict
  from typed group by 1, 2)
select fact_id, col, 'mistyped' issue from per where mistyped union all select fact_id, col, 'conflict' from per where conflict""",
    "p6_wide": _CELLS + f" select fact_id, table_uid, count(*) n_cells, {_WIDE} from typed group by 1, 2",
    "p6_kinds": _CELLS
    + """, sig as (select table_uid, string_agg(col || ':' || coalesce(kind, 'text'), '|' order by col || ':' || coalesce(kind, 'text')) signature, count(*) n_columns from cat where col <> '' group by 1),
per as (select signature, count(*) n_facts, sum(n) n_cells from (select fact_id, table_uid, count(*) n from typed group by 1, 2) join sig using (table_uid) group by 1)
select signature, count(*) n_tables, any_value(n_columns) n_columns, any_value(n_facts) n_facts, cast(any_value(n_cells) as bigint) n_cells from sig join per using (signature) group by 1""",
    "p6_catalogue": _CATALOGUE + " select col, kind, count(*) n_tables from cat group by 1, 2",
}
