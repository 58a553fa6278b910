"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import archive as A
from ..functions import grounding as G
from ..functions.text import key, norm_col
from ..operators import records as R
from ..operators.aggregate import FactStore, FrameStore, Request
from ..operators.extract import column_role, running_balances
from ..operators.metrics import first_ranks, retrieval_metrics
from ..operators.retrieval import bm25_topk, dense_topk, dense_topk_many, fuse
from ..session import table
from ..streaming.sessions import illegal_changes, last_status, sessions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (t, spark, sf_dir) under its name, t loading tables, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n), spark, sf_dir)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ── exact aggregation over an ordinary table taken as a fact table ───────────

ORDER_ROLES = {"o_custkey": "identifier", "o_orderstatus": "label", "o_totalprice": "amount", "o_orderdate": "date", "o_orderpriority": "label"}


def orders_store(t, **more) -> FactStore:
    return FrameStore(t("orders"), "orders", "o_orderkey", ORDER_ROLES, label="o_orderpriority", **more)


_F = {"where_column": "o_orderstatus", "where_value": "F", "period": "Q3 1996"}
_FSQL = "from orders where lower(o_orderstatus) = 'f' and o_orderdate >= '1996-07-01' and o_orderdate < '1996-10-01'"


def _total(t, op: str) -> DataFrame:
    s = orders_store(t)
    r = Request(op, column="" if op == "count" else "o_orderpriority" if op == "distinct" else "totalprice", **_F)
    return s.total(r, s.resolve(r)).select("matched_rows", F.col("value").alias("result"))


for _op, _expr in {"count": "count(*)", "sum": "round(sum(cast(o_totalprice as decimal(38,4))), 2)", "average": "round(sum(cast(o_totalprice as decimal(38,4))) / count(*), 2)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "distinct": "count(distinct o_orderpriority)"}.items():

    def _make(op: str):
        return lambda spark, sf_dir: _total(lambda n: table(spark, sf_dir, n), op)

    QUERIES[f"agg_{_op}"] = _make(_op)
    ORACLE[f"agg_{_op}"] = f"select count(*) matched_rows, cast({_expr} as double) result {_FSQL}"


@query("select o_orderpriority as \"key\", count(*) n_rows, cast(round(sum(cast(o_totalprice as decimal(38,4))), 2) as double) total from orders group by 1")
def agg_breakdown(t, spark, sf_dir):
    s = orders_store(t)
    r = Request("breakdown", column="orderpriority")
    return s.breakdown(r, s.resolve(r))


@query("select 'orders/' || o_custkey table_uid, arg_max(o_totalprice, (cast(o_orderdate as date), o_orderkey)) result, cast(max(cast(o_orderdate as date)) as varchar) \"day\" from orders group by o_custkey")
def agg_closing(t, spark, sf_dir):
    s = orders_store(t, uid_col="o_custkey")
    r = Request("closing", column="totalprice")
    return s.closing(r, s.resolve(r)).select("table_uid", F.col("value").alias("result"), "day")


@query("select 'orders/' || o_orderpriority table_uid, count(*) rows_matched, cast(round(sum(cast(o_totalprice as decimal(38,4))), 2) as double) result from orders group by 1")
def agg_per_table(t, spark, sf_dir):
    s = orders_store(t, uid_col="o_orderpriority")
    r = Request("sum", column="o_totalprice")
    return s.per_table(r, s.resolve(r)).select("table_uid", "rows_matched", F.col("value").alias("result"))


@query("select count(*) matched_rows, cast(round(sum(cast(o_totalprice as decimal(38,4))), 2) as double) result from orders where o_custkey = 7")
def where_number(t, spark, sf_dir):
    s = orders_store(t)
    r = Request("sum", column="totalprice", where_column="custkey", where_value="7")
    return s.total(r, s.resolve(r)).select("matched_rows", F.col("value").alias("result"))


@query("select count(*) matched_rows, cast(round(sum(cast(o_totalprice as decimal(38,4))), 2) as double) result from orders where contains(lower(o_orderpriority), 'urgent')")
def where_contains(t, spark, sf_dir):
    s = orders_store(t)
    r = Request("sum", column="totalprice", where_column="orderpriority", where_value="URGENT")
    return s.total(r, s.resolve(r)).select("matched_rows", F.col("value").alias("result"))


# ── the archive's own facts ──────────────────────────────────────────────────

_CELLS = """vals as (select fact_id, regexp_replace(replace(strip_accents(lower(col)), 'ß', 'ss'), '[^0-9a-z]', '', 'g') c, max(num) num, max("text") txt, max("date") d from fact_values where fact_id is not null group by 1, 2),
cat as (select * from (select table_uid, source, doc_id, n_rows, n_total_rows, from_json(column_json, '[{"name":"VARCHAR","raw":"VARCHAR","role":"VARCHAR","kind":"VARCHAR"}]') cols, row_number() over (partition by table_uid order by loaded_at desc) rn from fact_tables where table_uid is not null) where rn = 1),
f as (select id, any_value(lower(trim(table_uid))) table_uid, any_value(row_kind) row_kind, any_value(row_no) row_no from facts where id is not null and trim(table_uid) <> '' group by id)"""


def archive_store(t) -> FactStore:
    """The archive's facts with keys and column names in catalogue spelling."""
    values = t("fact_values").withColumn("col", norm_col(F.col("col")))
    facts = t("facts").withColumn("table_uid", key(F.col("table_uid")))
    return FactStore(t("fact_tables"), facts, values, t("archive_docs"))


@query(
    f"with {_CELLS}, m as (select table_uid, list_filter(cols, lambda x: starts_with(x.name, 'betrag'))[1].name c from cat), per as (select m.table_uid, count(*) rows_matched, "
    "cast(round(sum(cast(v.num as decimal(38,4))), 2) as double) result from m join f on f.table_uid = m.table_uid and f.row_kind = 'data' left join vals v on v.fact_id = f.id and v.c = m.c where m.c is not null group by 1) "
    "select m.table_uid, coalesce(rows_matched, 0) rows_matched, result from m left join per on per.table_uid = m.table_uid where m.c is not null"
)
def archive_sum_per_table(t, spark, sf_dir):
    s = archive_store(t)
    r = Request("sum", column="Betrag")
    return s.per_table(r, s.resolve(r)).select("table_uid", "rows_matched", F.col("value").alias("result"))


@query(
    f"with {_CELLS}, m as (select table_uid, list_filter(cols, lambda x: x.name = 'status')[1].name c, list_filter(cols, lambda x: x.role = 'amount')[1].name a from cat) "
    "select trim(coalesce(nullif(v.txt, ''), '(leer)')) as \"key\", count(*) n_rows, cast(round(sum(case when v.txt is not null then cast(w.num as decimal(38,4)) end), 2) as double) total "
    "from m join f on f.table_uid = m.table_uid and f.row_kind = 'data' left join vals v on v.fact_id = f.id and v.c = m.c left join vals w on w.fact_id = f.id and w.c = m.a where m.c is not null group by 1"
)
def archive_breakdown(t, spark, sf_dir):
    s = archive_store(t)
    r = Request("breakdown", column="Status")
    return s.breakdown(r, s.resolve(r))


@query(
    f"with {_CELLS}, m as (select table_uid, list_filter(cols, lambda x: x.role = 'date')[1].name d from cat where contains(lower(source), 'bilanz') and len(list_filter(cols, lambda x: x.name = '2024eur')) > 0) "
    "select m.table_uid, count(v.num) n_values, max(v.num) greatest from m join f on f.table_uid = m.table_uid and f.row_kind = 'data' left join vals v on v.fact_id = f.id and v.c = '2024eur' group by 1"
)
def scope_contains(t, spark, sf_dir):
    s = archive_store(t)
    r = Request("max", column="2024 (EUR)", source="BILANZ")
    return s.rows(r, s.resolve(r)).groupBy("table_uid").agg(F.count("num").alias("n_values"), F.max("num").alias("greatest"))


@query(
    f"with {_CELLS}, m as (select table_uid, list_filter(cols, lambda x: x.role = 'date')[1].name d from cat where len(list_filter(cols, lambda x: x.name = 'saldoeur')) > 0), "
    "r as (select m.table_uid, f.row_no, v.num, w.d \"day\" from m join f on f.table_uid = m.table_uid and f.row_kind = 'data' join vals v on v.fact_id = f.id and v.c = 'saldoeur' left join vals w on w.fact_id = f.id and w.c = m.d where v.num is not null) "
    "select table_uid, arg_max(num, (coalesce(\"day\", ''), row_no)) result, max(\"day\") \"day\", count(*) n from r group by 1"
)
def archive_closing_days(t, spark, sf_dir):
    """Closing balance per table, the day it is of, and how many values the column has."""
    s = archive_store(t)
    r = Request("closing", column="Saldo (EUR)")
    tables = s.resolve(r)
    n = s.rows(r, tables).where("num is not null").groupBy("table_uid").agg(F.count("*").alias("n"))
    return s.closing(r, tables).join(n, "table_uid").select("table_uid", F.col("value").alias("result"), "day", "n")


@query(
    f"with {_CELLS}, ids as (select table_uid, unnest(list_transform(list_filter(cols, lambda x: x.role = 'identifier'), lambda x: x.name)) c from cat) "
    "select v.\"text\", count(distinct v.table_uid) n_tables from fact_values v join ids on ids.table_uid = v.table_uid and ids.c = regexp_replace(replace(strip_accents(lower(v.col)), 'ß', 'ss'), '[^0-9a-z]', '', 'g') where v.\"text\" <> '' and fact_id is not null group by 1 having count(distinct v.table_uid) > 1"
)
def identifier_overlap(t, spark, sf_dir):
    s = archive_store(t)
    return s.shared_identifiers(s.tables)


@query("select distinct doc_id, source from archive_docs a where doc_type = 'invoice' and not exists (select 1 from fact_tables f where f.doc_id = a.doc_id)")
def docs_without_rows(t, spark, sf_dir):
    s = archive_store(t)
    return s.documents_without_rows("invoice", s.tables).distinct()


@query("select distinct list_aggregate(list_sort(list_transform(from_json(column_json, '[{\"name\":\"VARCHAR\"}]'), lambda x: x.name)), 'string_agg', '|') signature from fact_tables")
def column_signatures(t, spark, sf_dir):
    from .columns import signature, with_columns

    return with_columns(t("fact_tables")).select(signature(F.col("columns")).alias("signature")).distinct()


@query(
    "with v as (select table_uid, regexp_replace(replace(strip_accents(lower(col)), 'ß', 'ss'), '[^0-9a-z]', '', 'g') c, num, \"date\" d, \"text\" x from fact_values), "
    "p as (select table_uid, c, count(num) n_num, count(d) n_date, count(nullif(trim(x), '')) n_values from v group by 1, 2), h as (select *, case when regexp_matches(c, 'saldo|kontostand|endbestand|anfangsbestand|bestand|balance|runningtotal|laufend|kumuliert|cumulative|closing|opening') then 'balance' "
    "when regexp_matches(c, 'prozent|percent|proz|quote|^rate|kurs$|marge|anteilin') or c like '%satz' and c not like '%umsatz' then 'rate' when regexp_matches(c, '^jahr|^year|geschaeftsjahr|^monat|^month|^quartal|^quarter|^periode|^period|^kw$|^woche|^week') then 'period' "
    "when regexp_matches(c, 'nummer|^nr|nr$|number|^id$|beleg|konto|iban|bic|referenz|reference|kennzeichen|ustid|steuernummer|code$|kostenstelle') then 'identifier' end hint, n_num / greatest(n_values, 1) >= 0.6 numeric, n_date / greatest(n_values, 1) >= 0.6 dated from p) "
    "select table_uid, c col, n_num, n_date, n_values, case when dated then 'date' when hint = 'balance' then case when numeric then 'balance' else 'label' end when hint is not null then hint when numeric then 'amount' else 'label' end as role, case when numeric then 'number' when dated then 'date' else 'text' end kind from h"
)
def column_profile(t, spark, sf_dir):
    per = t("fact_values").groupBy("table_uid", norm_col(F.col("col")).alias("col")).agg(F.count("num").alias("n_num"), F.count("date").alias("n_date"), F.count(F.nullif(F.trim("text"), F.lit(""))).alias("n_values"))
    role, kind = column_role(F.col("col"), F.col("n_num"), F.col("n_date"), F.col("n_values"))
    return per.withColumn("role", role).withColumn("kind", kind)


@query("with e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) n, sum(cast(value as decimal(38,6))) over (partition by user_id order by event_id) s from events), p as (select user_id, count(*) n from e group by 1 having count(*) >= 4) select 'u' || user_id table_uid, 'stand' as \"name\" from p")
def running_balance_detect(t, spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t("events").withColumn("ordinal", F.row_number().over(w)).withColumn("stand", F.sum(F.col("value").cast("decimal(38,6)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    uid = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("table_uid")
    cells = e.select(uid, "ordinal", F.inline(F.array(F.struct(F.lit(0).alias("pos"), F.lit("betrag").alias("name"), F.col("value").alias("num")), F.struct(F.lit(1).alias("pos"), F.lit("stand").alias("name"), F.col("stand").alias("num")))))
    columns = cells.select("table_uid", "pos", "name").distinct().withColumn("role", F.lit("amount")).withColumn("kind", F.lit("number"))
    return running_balances(cells, columns).where("name = 'stand'")


# ── scalars over whole tables ────────────────────────────────────────────────

_NUM = """case when not regexp_matches(b, '^[+-]?[0-9.,]+$') then null
 when b like '%,%' and b like '%.%' then case when instr(reverse(b), ',') < instr(reverse(b), '.') then replace(replace(b, '.', ''), ',', '.') else replace(b, ',', '') end
 when regexp_matches(b, '^[+-]?[0-9]{1,3}([.][0-9]{3})+$') then replace(b, '.', '') when regexp_matches(b, '^[+-]?[0-9]{1,3}(,[0-9]{3})+$') then replace(b, ',', '') else replace(b, ',', '.') end"""


@query(
    "with s as (select distinct \"text\" x, trim(regexp_replace(\"text\", '\\b(eur|usd|gbp|chf|tsd|mio|mrd)\\b|[€$£¥%]', '', 'gi')) c from fact_values where \"text\" is not null), "
    "k as (select x, case when regexp_matches(c, '^[(].*[)]$') then -1.0 else 1.0 end g, regexp_replace(regexp_replace(c, '^[(](.*)[)]$', '\\1'), '[  ]', '', 'g') b from s) "
    f"select x, cast(g * try_cast(case when regexp_matches(n, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') then n end as double) as double) n from (select *, {_NUM} n from k)"
)
def parse_number_grid(t, spark, sf_dir):
    return t("fact_values").where("text is not null").select(F.col("text").alias("x")).distinct().select("x", A.parse_number(F.col("x")).alias("n"))


@query(
    "with s as (select distinct \"text\" x, trim(\"text\") c from fact_values where \"text\" is not null), p as (select x, c, regexp_extract(c, '^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})') a, regexp_extract(c, '^([0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})') b from s), "
    "q as (select x, c, case when a <> '' then string_split_regex(a, '[-/]') when b <> '' then list_reverse(string_split_regex(b, '[./]')) end l from p) "
    "select x, case when length(c) >= 8 and cast(l[1] as int) between 1900 and 2200 and cast(l[2] as int) between 1 and 12 and cast(l[3] as int) between 1 and 31 then l[1] || '-' || lpad(l[2], 2, '0') || '-' || lpad(l[3], 2, '0') end d from q"
)
def parse_date_grid(t, spark, sf_dir):
    return t("fact_values").where("text is not null").select(F.col("text").alias("x")).distinct().select("x", A.parse_date(F.col("x")).alias("d"))


@query("select doc_id, left(trim(regexp_replace(regexp_replace(\"text\", '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 4000) body from documents")
def html_strip(t, spark, sf_dir):
    return t("documents").select("doc_id", A.html_text(F.col("text")).alias("body"))


@query(
    "with n as (select doc_id, len(regexp_extract_all(lower(\"text\"), '[äöüß]')) * 2 + " + " + ".join(f"len(regexp_extract_all(lower(\"text\"), ' {w} '))" for w in A.GERMAN_WORDS) + " de, "
    + " + ".join(f"len(regexp_extract_all(lower(\"text\"), ' {w} '))" for w in A.ENGLISH_WORDS) + " en, \"text\" x from documents) select doc_id, case when x is null or x = '' then '' when de > en then 'de' else 'en' end as guess from n"
)
def lang_guess(t, spark, sf_dir):
    return t("documents").select("doc_id", A.guess_lang(F.col("text")).alias("guess"))


@query("select source, case " + " ".join(f"when regexp_matches(lower(source), '{'|'.join(k)}') then '{n}'" for n, k in A.DOC_TYPES) + " else 'other' end kind, coalesce(nullif(regexp_extract(source, '\\b((?:19|20)[0-9]{2})\\b', 1), ''), '') yr from (select distinct source from archive_docs)")
def doc_type_and_year(t, spark, sf_dir):
    none = F.lit("")
    return t("archive_docs").select("source").distinct().select("source", A.infer_doc_type(F.col("source"), none).alias("kind"), A.infer_year(F.col("source"), none).alias("yr"))


@query(
    "select doc_id, case when regexp_matches(lower(n), 'readme|index|inhalt|uebersicht|übersicht') then 'other' " + " ".join(f"when regexp_matches(lower(left(coalesce(x, ''), 400)), '{'|'.join(k)}') then '{d}'" for d, k in A.DOC_TYPES) + " else 'other' end kind, coalesce(nullif(regexp_extract(left(coalesce(x, ''), 600), '\\b((?:19|20)[0-9]{2})\\b', 1), ''), '') yr "
    "from (select doc_id, case when doc_id % 9 = 0 then 'index.md' else 'datei.md' end n, \"text\" x from documents)"
)
def doc_type_from_text(t, spark, sf_dir):
    """Type and year from the text where the name tells neither; files that only list others are 'other'."""
    name = F.when(F.col("doc_id") % 9 == 0, "index.md").otherwise("datei.md")
    return t("documents").select("doc_id", A.infer_doc_type(name, F.coalesce("text", F.lit(""))).alias("kind"), A.infer_year(name, F.coalesce("text", F.lit(""))).alias("yr"))


@query("select o_custkey, string_agg(o_comment, chr(10) order by o_orderkey) body from (select o_custkey, o_orderkey, case when o_orderkey % 4 > 1 then o_orderpriority end o_comment from orders) where o_comment is not null group by 1")
def text_parts(t, spark, sf_dir):
    """Texts put together from lists of parts, of which some are null or empty."""
    part = F.when(F.col("o_orderkey") % 4 > 1, F.col("o_orderpriority")).when(F.col("o_orderkey") % 4 == 0, "")
    per = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", part.alias("p")))).alias("p"))
    return per.select("o_custkey", A.join_parts(F.transform("p", lambda x: x["p"])).alias("body")).where("body <> ''")


@query("select item_id, regexp_matches(question, '\\d{1,3}(?:[.,]\\d{3})+|\\d{5,}|\\b[A-Z]{2,}[-_/]?\\d+\\b|\\b\\d{4}[-_/]\\w+[-_/]\\w+\\b|\\b\\w*\\d+[-_/]\\d{3,}\\b') anchored from eval_items")
def literal_anchors(t, spark, sf_dir):
    return t("eval_items").select("item_id", A.has_literal_anchor(F.col("question")).alias("anchored"))


@query("select o_orderkey, case when o_totalprice = round(o_totalprice, 0) then replace(format('{:,}', cast(o_totalprice as bigint)), ',', '.') else translate(format('{:,.2f}', o_totalprice), ',.', '.,') end shown from orders")
def format_amounts(t, spark, sf_dir):
    return t("orders").select("o_orderkey", A.format_amount(F.col("o_totalprice")).alias("shown"))


@query("select item_id, " + " or ".join(f"contains(lower(passage), '{m}')" for m in G.REFUSALS) + " refuses from eval_items")
def refusals(t, spark, sf_dir):
    return t("eval_items").select("item_id", G.looks_like_refusal(F.col("passage")).alias("refuses"))


@query()
def text_blocks(t, spark, sf_dir):
    """Blocks of every document; a fold that SQL cannot state, tested against the reader of text files."""
    return t("documents").select("doc_id", F.posexplode(A.text_blocks(F.col("text"))).alias("nr", "block"))


@query("select \"text\" x, trim(regexp_replace(replace(\"text\", chr(10), ' '), '^ +| +$', '', 'g')) cell, case when length(\"text\") > 12 then left(\"text\", 9) || '...' else \"text\" end clipped from (select distinct \"text\" from fact_values where \"text\" is not null)")
def cell_texts(t, spark, sf_dir):
    return t("fact_values").where("text is not null").select(F.col("text").alias("x")).distinct().select("x", A.norm_cell(F.col("x")).alias("cell"), A.clip(F.col("x"), 12).alias("clipped"))


# ── documents and passages ───────────────────────────────────────────────────


@query("select sha256(\"text\") doc_id, min(cast(doc_id as varchar)) path, count(*) n_files from documents where \"text\" is not null group by 1")
def content_dedup(t, spark, sf_dir):
    return R.by_content(t("documents").where("text is not null").withColumn("path", F.col("doc_id").cast("string")), "text", "path")


@query("with n as (select doc_id, count(*) n from chunks where doc_id is not null group by 1) select a.doc_id, a.source, a.doc_type, coalesce(n.n, 0) n_chunks from (select * from (select *, row_number() over (partition by doc_id order by ingested_at desc) k from archive_docs) where k = 1 and \"year\" = '2024') a left join n on n.doc_id = a.doc_id")
def inventory(t, spark, sf_dir):
    docs = R.latest(t("archive_docs"), ["doc_id"], F.desc("ingested_at"))
    return R.inventory(docs, t("chunks"), year="2024").select("doc_id", "source", "doc_type", "n_chunks")


@query("select (select count(*) from archive_docs) n_documents, (select count(*) from chunks) n_chunks, (select count(embedding) from chunks) n_embedded, (select count(*) > 20000 from chunks) beyond_envelope, (select count(distinct doc_type) from archive_docs) n_types, (select count(distinct nullif(\"year\", '')) from archive_docs) n_years")
def index_stats(t, spark, sf_dir):
    s = R.index_stats(t("archive_docs"), t("chunks"))
    return s.select("n_documents", "n_chunks", "n_embedded", "beyond_envelope", F.expr("size(filter(doc_types, x -> x.doc_type is not null))").cast("long").alias("n_types"), F.size("years").cast("long").alias("n_years"))


@query("select doc_id, case when bool_or(kind = 'notice' and id % 3 = 0) then 'error' when bool_or(kind = 'notice') then 'partial' else 'ok' end status from chunks group by 1")
def parse_status(t, spark, sf_dir):
    return R.parse_status(t("chunks").select("doc_id", "kind", F.when(F.col("id") % 3 == 0, "parse_error").alias("reason")))


@query("select id, source, locator from (select id, source, locator, row_number() over (partition by source, locator, left(\"text\", 80) order by id) n from (select distinct id, source, locator, \"text\" from chunks)) where n = 1")
def evidence_dedup(t, spark, sf_dir):
    return R.dedup_evidence(t("chunks").select("id", "source", "locator", "text").distinct(), "id").select("id", "source", "locator")


@query("select 'new' as \"change\", count(*) n from (select distinct doc_id from archive_docs where ingested_at >= '2024-02-01') where doc_id not in (select doc_id from archive_docs where ingested_at < '2024-02-01') union all select 'unchanged', count(*) from (select distinct doc_id from archive_docs where ingested_at >= '2024-02-01') where doc_id in (select doc_id from archive_docs where ingested_at < '2024-02-01') union all select 'gone', count(*) from (select distinct doc_id from archive_docs where ingested_at < '2024-02-01') where doc_id not in (select doc_id from archive_docs where ingested_at >= '2024-02-01')")
def incremental_diff(t, spark, sf_dir):
    d = t("archive_docs")
    split = F.col("ingested_at") >= F.lit("2024-02-01").cast("timestamp_ntz")
    parts = R.changed(d.where(split).select("doc_id").distinct(), d.where(~split).select("doc_id").distinct(), "doc_id")
    out = [p.agg(F.count("*").alias("n")).select(F.lit(n).alias("change"), "n") for n, p in zip(("new", "unchanged", "gone"), parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("with n as (select doc_id, count(*) n from chunks group by 1), d as (select distinct doc_id from archive_docs), s as (select d.doc_id, coalesce(n.n, 0) n_chunks from d left join n on n.doc_id = d.doc_id), t as (select distinct doc_id from archive_docs where doc_type = 'budget'), r as (select s.*, md5('7:' || doc_id) h from s where doc_id not in (select doc_id from t)), u as (select *, sum(n_chunks) over (order by h, doc_id rows unbounded preceding) run from r) select doc_id, n_chunks from s where doc_id in (select doc_id from t) union all select doc_id, n_chunks from u where run <= 600 - (select coalesce(sum(n_chunks), 0) from s where doc_id in (select doc_id from t))")
def subset_envelope(t, spark, sf_dir):
    docs = t("archive_docs")
    return R.padded_subset(docs, t("chunks"), docs.where("doc_type = 'budget'"), 600, "7")


# ── ranking ──────────────────────────────────────────────────────────────────

_LEN = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"with q as (select embedding from embeddings where vec_id = 0) select vec_id, round({_LEN}, 9) score, row_number() over (order by {_LEN} desc, vec_id) as \"rank\" from embeddings e, q order by {_LEN} desc, vec_id limit 50")
def dense_ranking(t, spark, sf_dir):
    e = t("embeddings")
    q = e.where("vec_id = 0").first().embedding
    return dense_topk(e, q, 50, id_col="vec_id").select(F.col("id").alias("vec_id"), F.round("score", 9).alias("score"), "rank")


QUERY = "Rechnung Prozent balance EUR"
_BM25 = """with tok as (select doc_id id, regexp_extract_all(strip_accents(lower(coalesce("text", ''))), '[\\p{L}\\p{N}]+') w from documents),
c as (select id, len(w) l, len(list_filter(w, lambda x: x = 'rechnung')) a, len(list_filter(w, lambda x: x = 'prozent')) b, len(list_filter(w, lambda x: x = 'balance')) d, len(list_filter(w, lambda x: x = 'eur')) e from tok),
s as (select count(*) n, avg(l) m, count(*) filter (a > 0) fa, count(*) filter (b > 0) fb, count(*) filter (d > 0) fd, count(*) filter (e > 0) fe from c),
z as (select id, """ + " + ".join(f"greatest(ln((n - f{x} + 0.5) / (f{x} + 0.5)), 1e-6) * {x} * 2.2 / ({x} + 1.2 * (0.25 + 0.75 * l / m))" for x in "abde") + " score from c, s where a + b + d + e > 0)"


@query(_BM25 + " select id, round(score, 9) score, row_number() over (order by score desc, id) as \"rank\" from z order by score desc, id limit 50")
def bm25_ranking(t, spark, sf_dir):
    return bm25_topk(t("documents"), QUERY, 50, id_col="doc_id").select("id", F.round("score", 9).alias("score"), "rank")


@query(
    _BM25 + f", q as (select embedding from embeddings where vec_id = 0), dn as (select vec_id id, row_number() over (order by {_LEN} desc, vec_id) r from embeddings e, q), lx as (select id, row_number() over (order by score desc, id) r from z), "
    "p as (select id, 1.0 / (60 + r) s, r dr, null lr from dn where r <= 50 union all select id, 0.25 / (60 + r), null, r from lx where r <= 50), g as (select id, sum(s) sc, max(dr) dr, max(lr) lr from p group by 1) "
    "select id, round(sc, 6) score, dr is not null in_dense, lr is not null in_lexical from g order by sc desc, dr nulls last, lr nulls last, id limit 20"
)
def rrf_ranking(t, spark, sf_dir):
    e = t("embeddings")
    dense = dense_topk(e, e.where("vec_id = 0").first().embedding, 50, id_col="vec_id")
    return fuse(dense, bm25_topk(t("documents"), QUERY, 50, id_col="doc_id"), 20, 0.25).select("id", "score", "in_dense", "in_lexical")


@query(
    f"with q as (select * from embeddings where vec_id % 100 = 0), r as (select q.vec_id query_id, q.label ql, e.label el, row_number() over (partition by q.vec_id order by {_LEN} desc, e.vec_id) r from embeddings e join q on q.vec_id <> e.vec_id), m as (select query_id, any_value(ql) kind, min(r) filter (ql = el and r <= 50) rk from r group by 1) "
    "select coalesce(cast(kind as varchar), 'all') kind, count(*) n, round(avg(case when rk = 1 then 1.0 else 0.0 end), 6) hit_at_1, round(avg(case when rk <= 6 then 1.0 else 0.0 end), 6) recall_at_k, round(avg(case when rk <= 6 then 1.0 / rk else 0.0 end), 6) mrr from m group by grouping sets ((kind), ())"
)
def retrieval_quality(t, spark, sf_dir):
    """Queries are the rows whose id is divisible by 100, against all rows, in blocks of queries."""
    e = t("embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("string").alias("kind"))
    hits = dense_topk_many(e, q, 50, id_col="vec_id").withColumnRenamed("query", "query_id")
    named = hits.join(e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("source")), "id")
    ranks = first_ranks(named, q.select("query_id", "kind", F.col("kind").alias("expect_source")))
    return retrieval_metrics(ranks)


# ── sessions and jobs ────────────────────────────────────────────────────────


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) > interval 1 hour then 1 else 0 end b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) n from g) select user_id \"user\", min(ts) started, max(ts) last_seen, count(*) n_events from s group by user_id, n")
def session_ttl(t, spark, sf_dir):
    return sessions(t("events"))


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, max(ts) ts from events group by 1")
def status_last_value(t, spark, sf_dir):
    return last_status(t("events"), "user_id", "ts", "event_type", "event_id")


@query("select thread_id, status, created_at from threads order by created_at desc, thread_id limit 100")
def registry_recent(t, spark, sf_dir):
    return R.recent_jobs(t("threads").select("thread_id", "status", "created_at"))


@query("select nullif(lower(trim(thread_id)), '') thread, count(distinct id) n, min(created_at) first_at, max(created_at) last_at from audit_log where trim(thread_id) <> '' group by 1")
def audit_by_thread(t, spark, sf_dir):
    return t("audit_log").withColumn("thread", key(F.col("thread_id"))).where("thread is not null").dropDuplicates(["id"]).groupBy("thread").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query("with l as (select event_id, user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts, event_id) b from events), m as (select event_id, case event_type when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'awaiting_review' end s, case b when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' when null then null else case when b is null then null else 'awaiting_review' end end b from l) select event_id, s as status from m where not coalesce(b is null and s = 'running' or b = 'running' or b = 'awaiting_review' or b = s, false)")
def status_violations(t, spark, sf_dir):
    s = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("awaiting_review")
    return illegal_changes(t("events").withColumn("status", s), "user_id", "ts", "status", "event_id").select("event_id", "status")


@query("select id, action, actor from audit_log where coalesce(thread_id <> (select min(thread_id) from threads), true)")
def scrub_thread(t, spark, sf_dir):
    first = t("threads").agg(F.min("thread_id").alias("m")).first().m
    return R.scrub({"audit_log": t("audit_log")}, first)["audit_log"].select("id", "action", "actor")
