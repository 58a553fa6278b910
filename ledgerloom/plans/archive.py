"""Registered queries of extraction, of requests with their accounting, of retrieval under filters and of summaries, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import archive as A
from ..functions import grounding as G
from ..operators import metrics as M
from ..operators import records as R
from ..operators.extract import extract
from ..operators.retrieval import bm25_stored, folded_tokens, postings, search_or_unfiltered
from ..session import cut
from ..sources.files import describe, elements_of, payloads_of
from ..streaming.sessions import accepted_uploads
from .engine import archive_store, orders_store, query


def german(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


def payload(df: DataFrame, uid: Column, source: Column, headers: list[str], rows: Column) -> DataFrame:
    """Table payloads as the readers of files give them."""
    n = F.size(rows)
    return df.select(
        uid.alias("table_uid"), uid.alias("doc_id"), source.alias("source"), uid.alias("table_id"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("page"), F.lit("ledger").alias("doc_type"),
        F.lit("2024").alias("year"), F.array(*map(F.lit, headers)).alias("headers"), rows.alias("rows"), n.alias("n_rows_total"), n.alias("n_rows_seen"), n.alias("n_rows_indexed"),
    )


def row(n: Column, *cells: Column) -> Column:
    return F.struct(n.cast("int").alias("row"), F.format_string("Zeile %d", n.cast("int")).alias("locator"), F.array(*cells).alias("cells"))


# ── parsed tables into facts ─────────────────────────────────────────────────


def order_lists(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The orders of each customer as a list in German notation that ends with a total, extracted."""
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "dd.MM.yyyy").alias("d"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    listed = o.select("o_custkey", "o_totalprice", row(nth, F.col("d"), german(F.col("o_totalprice")), german(F.col("o_totalprice") * 2), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("r"))
    per = listed.groupBy("o_custkey").agg(F.sort_array(F.collect_list("r")).alias("r"), F.sum(F.col("o_totalprice").cast("decimal(38,4)")).cast("double").alias("s"))
    total = row(F.size("r") + 1, F.lit(""), german(F.col("s")), german(F.col("s") * 2), F.lit("Summe"), F.lit(""))
    uid = F.concat(F.lit("liste/"), F.col("o_custkey").cast("string"))
    return extract(payload(per, uid, uid, ["Auftragsdatum", "Betrag (EUR)", "Betrag (EUR)", "Status", "Beleg-Nr."], F.concat("r", F.array(total))))


_SIGN = "'auftragsdatum:date:date|betrageur:amount:number|betrageur2:amount:number|status:label:text|belegnr:identifier:number'"


@query(f"select 'liste/' || o_custkey table_uid, 'records' layout, count(*) n_rows, 1 n_total_rows, {_SIGN} signature from orders group by o_custkey")
def extract_tables(t, spark, sf_dir):
    """Roles, kinds, names made unique, data and total rows of every list."""
    one = F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["role"], c["kind"]))
    return order_lists(t)[0].select("table_uid", "layout", F.col("n_rows").cast("long").alias("n_rows"), "n_total_rows", F.array_join(one, "|").alias("signature"))


@query("select 'liste/' || o_custkey table_uid, row_number() over (partition by o_custkey order by o_orderkey) \"row\", 'data' row_kind, o_orderstatus as \"label\" from orders union all select 'liste/' || o_custkey, count(*) + 1, 'total', 'Summe' from orders group by o_custkey")
def extract_facts(t, spark, sf_dir):
    """Every row as a fact, totals marked, named by its first label."""
    return order_lists(t)[1].select("table_uid", F.col("row").cast("long").alias("row"), "row_kind", "label")


@query(
    "with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) n from orders), v as (select o_custkey, n, unnest(['auftragsdatum', 'betrageur', 'betrageur2', 'status', 'belegnr']) col, "
    "unnest([null, round(o_totalprice, 2), round(o_totalprice * 2, 2), null, cast(o_orderkey as double)]) num, unnest([strftime(o_orderdate, '%Y-%m-%d'), null, null, null, null]) d from o "
    "union all select o_custkey, count(*) + 1, unnest(['betrageur', 'betrageur2', 'status']), unnest([round(cast(sum(cast(o_totalprice as decimal(38,4))) as double), 2), round(cast(sum(cast(o_totalprice as decimal(38,4))) as double) * 2, 2), null]), null from o group by o_custkey) "
    "select 'liste/' || o_custkey table_uid, col, count(*) n_cells, count(num) n_num, count(d) n_date, round(sum(num), 2) total, max(d) last_day from v group by 1, 2"
)
def extract_values(t, spark, sf_dir):
    """The typed cells of every column of every list."""
    v = order_lists(t)[2].groupBy("table_uid", "col").agg(F.count("*").alias("n_cells"), F.count("num").alias("n_num"), F.count("date").alias("n_date"), F.round(F.sum(F.col("num").cast("decimal(38,4)")).cast("double"), 2).alias("total"), F.max("date").alias("last_day"))
    return v


@query(
    "select 'blatt/' || s_suppkey table_uid, 'keyvalue_record' layout, 1 n_rows, 'name:label:text|telefon:label:text|saldoeur:balance:number|nation:label:text' signature, s_name as \"label\", 'Zeile 1–Zeile 4' locator, round(s_acctbal, 2) balance from supplier"
)
def extract_sheets(t, spark, sf_dir):
    """Property sheets, keys down the page, stood up to one fact each."""
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = [("Name", F.col("s_name")), ("Telefon", F.concat(F.lit("Tel. "), F.col("s_suppkey").cast("string"))), ("Saldo (EUR)", german(F.col("s_acctbal"))), ("Nation", F.col("n_name"))]
    uid = F.concat(F.lit("blatt/"), F.col("s_suppkey").cast("string"))
    tables, facts, values = extract(payload(s, uid, uid, ["Feld", "Wert"], F.array(*[row(F.lit(n), F.lit(k), v) for n, (k, v) in enumerate(pairs, 1)])))
    one = F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["role"], c["kind"]))
    balance = values.where("col = 'saldoeur'").select("table_uid", F.col("num").alias("balance"))
    return tables.select("table_uid", "layout", "n_rows", F.array_join(one, "|").alias("signature")).join(facts.select("table_uid", "label", "locator"), "table_uid").join(balance, "table_uid")


@query("with e as (select user_id, count(*) n from events group by 1) select 'konto/' || user_id table_uid, case when n >= 4 then 'balance' else 'amount' end as role, n n_rows from e")
def extract_balances(t, spark, sf_dir):
    """Statements whose last column turns out to be a running balance."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t("events").withColumn("cent", F.round(F.col("value") * 100).cast("long") + 1).withColumn("stand", F.sum("cent").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.select("user_id", row(F.row_number().over(w), F.lit("Zahlung"), german(F.col("cent") / 100), german(F.col("stand") / 100)).alias("r"))
    uid = F.concat(F.lit("konto/"), F.col("user_id").cast("string"))
    tables, _, _ = extract(payload(e.groupBy("user_id").agg(F.sort_array(F.collect_list("r")).alias("r")), uid, uid, ["Zweck", "Umsatz", "Stand"], F.col("r")))
    return tables.select("table_uid", F.element_at("columns", 3)["role"].alias("role"), F.col("n_rows").cast("long").alias("n_rows"))


@query(
    "with f as (select n_name, count(*) n from supplier join nation on n_nationkey = s_nationkey group by 1), g as (select n_name, count(*) m from customer join nation on n_nationkey = c_nationkey group by 1) "
    "select 'Bestand-' || n_name || '-2024.csv' source, 'lieferantennrnummer:identifier:number|stand:amount:number' signature, n n_rows, 'Zeile 2' first_row, 'other' doc_type, '2024' as \"year\" from f where n > 0 "
    "union all select 'Bestand-' || n_name || '-2024.csv', 'kundennr:identifier:number|segment:label:text', m, 'Zeile ' || (n + 4), 'other', '2024' from f join g using (n_name)"
)
def csv_archive(t, spark, sf_dir):
    """Files of two blocks, parsed from their bytes: blocks split at empty lines, line numbers kept, type and year from the name."""
    line = lambda *c: F.array_join(F.array(*c), ";")
    block = lambda df, key, text: df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias("lines"))
    s = block(t("supplier"), "s_nationkey", line(F.lpad(F.col("s_suppkey").cast("string"), 9, "1"), german(F.col("s_acctbal"))))
    c = block(t("customer"), "c_nationkey", line(F.lpad(F.col("c_custkey").cast("string"), 9, "1"), F.col("c_mktsegment")))
    text = F.concat_ws("\n", F.lit("Lieferanten-Nr. (Nummer);Stand"), "s", F.lit(""), F.lit("Kunden-Nr.;Segment"), "c")
    files = s.select("s_nationkey", F.col("lines").alias("s")).join(c.select(F.col("c_nationkey").alias("s_nationkey"), F.col("lines").alias("c")), "s_nationkey").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    files = files.select(F.concat(F.lit("Bestand-"), "n_name", F.lit("-2024.csv")).alias("path"), text.cast("binary").alias("content"))
    parsed = cut(elements_of(files), "elements")
    tables, facts, _ = extract(payloads_of(parsed, describe(parsed)))
    one = F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["role"], c["kind"]))
    first = facts.groupBy("table_uid").agg(F.min_by("locator", "row").alias("first_row"))
    return tables.join(first, "table_uid").select("source", F.array_join(one, "|").alias("signature"), F.col("n_rows").cast("long").alias("n_rows"), "first_row", "doc_type", "year")


# ── requests with their accounting ───────────────────────────────────────────

_REQUESTS = [
    ("count", {}), ("count", {"period": "Q3 1996"}), ("count", {"where_column": "orderstatus", "where_value": "F"}), ("sum", {"column": "totalprice"}), ("average", {"column": "totalprice"}), ("min", {"column": "totalprice"}),
    ("max", {"column": "totalprice", "period": "1996-07"}), ("distinct", {"column": "orderstatus"}), ("breakdown", {"column": "orderstatus"}), ("sum", {"column": "custkey"}), ("average", {"column": "orderdate"}),
    ("median", {"column": "totalprice"}), ("sum", {"column": "xyz"}), ("count", {"period": "soon"}), ("count", {"source": "nowhere"}), ("sum", {}),
]


def _asked() -> str:
    d, p = "cast(sum(cast(o_totalprice as decimal(38,4))) as double)", "o_orderpriority"
    good = lambda n, op, value, where="true", warn=0: f"select {n} nr, '{op}' op, true ok, false refused, cast({value} as double) result, count(*) matched, (select count(*) from orders) scanned, (select count(distinct {p}) from orders) n_tables, {warn} n_warnings from orders where {where}"
    bad = lambda n, op, refused=False, warn=0: f"select {n}, '{op}', false, {str(refused).lower()}, null, 0, 0, 0, {warn}"
    price = f"round({d}, 2)"
    mean = "round(sum(cast(o_totalprice as decimal(38,4))) / count(*), 2)"
    return " union all ".join(
        [
            good(0, "count", "count(*)"), good(1, "count", "count(*)", "o_orderdate >= '1996-07-01' and o_orderdate < '1996-10-01'"), good(2, "count", "count(*)", "o_orderstatus = 'F'"), good(3, "sum", price, warn=1), good(4, "average", mean, warn=1), good(5, "min", "min(o_totalprice)"),
            good(6, "max", "max(o_totalprice)", "o_orderdate >= '1996-07-01' and o_orderdate < '1996-08-01'"), good(7, "distinct", "count(distinct o_orderstatus)"), good(8, "breakdown", "count(distinct o_orderstatus)"), bad(9, "sum", True), bad(10, "average", True),
            bad(11, "median"), bad(12, "sum"), bad(13, "count", warn=1), bad(14, "count"), bad(15, "sum"),
        ]
    )


@query(_asked())
def request_accounting(t, spark, sf_dir):
    """Requests over five tables: values, what was scanned and matched, refusals, errors, filters that do not apply, warnings."""
    s = orders_store(t, uid_col="o_orderpriority")
    rows = []
    for n, (op, scope) in enumerate(_REQUESTS):
        r = s.aggregate(op, **scope)
        rows.append((n, r.operation, r.ok, r.refused, None if r.value is None else float(r.value), r.matched_rows, r.scanned_rows, r.n_tables, len(r.warnings)))
    return spark.createDataFrame(rows, "nr int, op string, ok boolean, refused boolean, result double, matched bigint, scanned bigint, n_tables bigint, n_warnings int")


@query("select distinct source, sheet, c.raw as \"column\", c.role as role from (select source, sheet, unnest(from_json(column_json, '[{\"name\":\"VARCHAR\",\"raw\":\"VARCHAR\",\"role\":\"VARCHAR\",\"kind\":\"VARCHAR\"}]')) c from (select *, row_number() over (partition by table_uid order by loaded_at desc) n from fact_tables where table_uid is not null) where n = 1)")
def available_columns(t, spark, sf_dir):
    return archive_store(t).available_columns().distinct()


@query("select (select count(distinct table_uid) from fact_tables) n_tables, count(*) n_rows from (select id, any_value(row_kind) k from facts where id is not null and trim(table_uid) <> '' group by 1) where k = 'data'")
def fact_stats(t, spark, sf_dir):
    return archive_store(t).stats()


# ── retrieval under filters ──────────────────────────────────────────────────

_WORDS = "Rechnung Lager Zahlung"
_HITS = """tok as (select id, regexp_extract_all(strip_accents(lower(coalesce("text", ''))), '[\\p{{L}}\\p{{N}}]+') w from p where {where}),
c as (select id, len(w) l, len(list_filter(w, lambda x: x = 'rechnung')) a, len(list_filter(w, lambda x: x = 'lager')) b, len(list_filter(w, lambda x: x = 'zahlung')) d from tok),
s as (select count(*) n, avg(l) m, count(*) filter (a > 0) fa, count(*) filter (b > 0) fb, count(*) filter (d > 0) fd from c),
z as (select id, """ + " + ".join(f"greatest(ln((n - f{x} + 0.5) / (f{x} + 0.5)), 1e-6) * {x} * 2.2 / ({x} + 1.2 * (0.25 + 0.75 * l / m))" for x in "abd") + " score from c, s where a + b + d > 0)"
_PASSAGES = "p as (select id, any_value(\"text\") as \"text\", any_value(doc_type) doc_type, any_value(\"year\") as \"year\" from chunks group by 1), "


def passages(t) -> DataFrame:
    return t("chunks").groupBy("id").agg(*[F.min(c).alias(c) for c in ("text", "doc_type", "year", "source", "locator", "kind")], F.max("embedding").alias("embedding"))


@query("with " + _PASSAGES + _HITS.format(where="doc_type = 'invoice' and \"year\" = '2024'") + " select id, row_number() over (order by score desc, id) as \"rank\", false unfiltered from z order by score desc, id limit 10")
def search_filtered(t, spark, sf_dir):
    """Hits of the lexical channel under filters on type and year, which apply inside the ranker."""
    hits, dropped = search_or_unfiltered(passages(t), _WORDS, None, k=10, depth=50, doc_type="invoice", year="2024", channel="lexical")
    return hits.select("id", "rank", F.lit(dropped).alias("unfiltered"))


@query("with " + _PASSAGES + _HITS.format(where="true") + " select id, row_number() over (order by score desc, id) as \"rank\", true unfiltered from z order by score desc, id limit 10")
def search_fallback(t, spark, sf_dir):
    """A filter that nothing passes is dropped, and the hits say so."""
    hits, dropped = search_or_unfiltered(passages(t), _WORDS, None, k=10, depth=50, doc_type="none such", channel="lexical")
    return hits.select("id", "rank", F.lit(dropped).alias("unfiltered"))


@query("with " + _PASSAGES + _HITS.format(where="doc_type = 'invoice'") + " select id, round(score, 9) score, row_number() over (order by score desc, id) as \"rank\" from z order by score desc, id limit 50")
def bm25_from_postings(t, spark, sf_dir):
    """The same ranking from a stored index: postings by term and the lengths of the passages that pass the filter."""
    p = passages(t).select("id", "text", "doc_type")
    index = cut(postings(p).repartitionByRange("term").sortWithinPartitions("term"), "postings")
    lengths = p.where("doc_type = 'invoice'").select("id", F.size(folded_tokens(F.col("text"))).alias("n_tokens"))
    return bm25_stored(index, lengths, _WORDS, 50).select("id", F.round("score", 9).alias("score"), "rank")


# ── scalars ──────────────────────────────────────────────────────────────────


@query("select s_suppkey id, 'Name: ' || s_name || case when s_suppkey % 3 = 0 then '' else ' | Spalte 2: ' || s_nationkey || 'x' end || ' | Saldo: ' || cast(s_suppkey as varchar) line from supplier")
def row_lines(t, spark, sf_dir):
    phone = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.col("s_nationkey").cast("string"), F.lit("x")))
    return t("supplier").select(F.col("s_suppkey").alias("id"), A.row_text(F.array(F.lit("Name"), F.lit(""), F.lit("Saldo")), F.array(F.col("s_name"), phone, F.col("s_suppkey").cast("string"))).alias("line"))


@query(
    "with r as (select c_nationkey k, '| ' || c_custkey || ' | ' || c_mktsegment || ' |' line, row_number() over (partition by c_nationkey order by c_custkey) n, count(*) over (partition by c_nationkey) m from customer) "
    "select k, '| Nr | Segment |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) order by n) filter (n <= 5) || case when any_value(m) > 5 then chr(10) || '… ' || (any_value(m) - 5) || ' weitere Zeilen / more rows' else '' end md from r group by k"
)
def markdown_tables(t, spark, sf_dir):
    rows = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", F.array(F.col("c_custkey").cast("string"), "c_mktsegment").alias("cells")))).alias("r"))
    return rows.select("k", A.markdown_table(F.array(F.lit("Nr"), F.lit("Segment")), F.transform("r", lambda x: x["cells"]), 5).alias("md"))


@query("select doc_id, case when b < 1048576 then cast(cast(round_even(b / 1024.0, 0) as bigint) as varchar) || ' KB' else format('{:.1f} MB', b / 1048576.0) end as shown, left(sha256('x' || doc_id), 16) || ':' || lpad(cast(b as varchar), 5, '0') element from (select doc_id, coalesce(strlen(\"text\"), 0) * (1 + doc_id % 2 * 3000) b from documents)")
def sizes_and_elements(t, spark, sf_dir):
    """Sizes as shown and ids of elements."""
    b = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * (1 + F.col("doc_id") % 2 * 3000)
    digest = F.sha2(F.concat(F.lit("x"), F.col("doc_id").cast("string")), 256)
    return t("documents").select("doc_id", A.format_bytes(b).alias("shown"), A.element_id(digest, b).alias("element"))


_TO_DECIMAL = """list_transform(list_transform(@, lambda x: regexp_replace(x, '[.,]+$', '')), lambda s: try_cast(case
 when s like '%,%' and s like '%.%' then case when instr(reverse(s), ',') < instr(reverse(s), '.') then replace(replace(s, '.', ''), ',', '.') else replace(s, ',', '') end
 when regexp_matches(s, '^[^.,]*[.,][0-9]{1,2}$') then replace(s, ',', '.')
 when regexp_matches(s, '^[0-9]+([.][0-9]{3})+[.][0-9]{2}$') then replace(regexp_replace(s, '[.][0-9]+$', ''), '.', '') || '.' || regexp_extract(s, '[.]([0-9]+)$', 1)
 else regexp_replace(s, '[.,]', '', 'g') end as decimal(38,6)))"""
_DATES = G.DATES.replace("(?i)", "").replace("'", "''")
_FIGURES = _TO_DECIMAL.replace("@", "regexp_extract_all(regexp_replace(coalesce(\"text\", ''), '" + _DATES + "', ' ', 'gi'), '[0-9][0-9.,]*[0-9]|[0-9]')")


@query(
    "with f as (select doc_id, list_filter(list_distinct(" + _FIGURES + "), lambda d: d is not null and abs(d) >= 1000) n from documents) select doc_id, len(n) n_figures, cast(list_max(n) as double) greatest from f"
)
def numbers_in_text(t, spark, sf_dir):
    """Figures of at least 1,000 in a text, dates left out."""
    return t("documents").select("doc_id", G.numbers_in(F.col("text")).alias("n")).select("doc_id", F.size("n").alias("n_figures"), F.array_max("n").cast("double").alias("greatest"))


@query(
    "select o_orderkey, o_orderkey % 3 <> 2 stated, o_orderkey % 2 = 0 derived, case when o_orderkey % 5 = 0 then 'unknown' when o_orderkey % 4 = 0 then 'true' else 'false' end misattributed from orders"
)
def answers_against_sources(t, spark, sf_dir):
    """Whether an answer states a value, in German or English notation; whether a figure can be derived; whether it takes another thing's figure."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice") + 1000
    text = F.concat(F.lit("Der Betrag ist "), F.when(key % 3 == 0, german(price)).when(key % 3 == 1, F.format_number(price, 2)).otherwise(german(price + 7)), F.lit(" EUR."))
    known = F.array(price.cast("decimal(38,6)"), (price * 3).cast("decimal(38,6)"))
    other = F.when(key % 2 == 0, price * 4).otherwise(price * 9).cast("decimal(38,6)")
    wrong = F.concat(F.lit("Die Miete beträgt "), german(F.when(key % 4 == 0, price * 2).otherwise(price)), F.lit(" EUR. Die Heizung kostet "), german(price * 2), F.lit(" EUR."))
    correct = F.when(key % 5 != 0, F.array(german(price)))
    return t("orders").select(
        "o_orderkey", G.contains_value(text, F.array(F.format_number(price, 2))).alias("stated"), G.derivable(other, known).alias("derived"), F.coalesce(G.misattributed(wrong, F.array(F.lit("Miete")), F.array(german(price * 2)), correct).cast("string"), F.lit("unknown")).alias("misattributed")
    )


@query("select o_orderkey, list_sort(list_filter(['1000', '2000', '3000'], lambda x: x <> cast(o_orderkey % 3 + 1 as varchar) || '000' and x <> '3000')) ungrounded from orders")
def ungrounded_figures(t, spark, sf_dir):
    """Figures of a report that neither the sources nor the question hold: number sets by difference."""
    n = lambda c: G.numbers_in(c)
    report = F.lit("Es waren 1.000, 2.000 und 3.000 Stück am 01.01.2024.")
    source = F.concat(F.lit("Bestand "), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit(".000"))
    left = F.array_except(F.array_except(n(report), n(source)), n(F.lit("Sind es 3.000?")))
    return t("orders").select("o_orderkey", F.array_sort(F.transform(left, lambda d: d.cast("bigint").cast("string"))).alias("ungrounded"))


# ── evaluation ───────────────────────────────────────────────────────────────


def _cases(t) -> DataFrame:
    k = F.col("o_orderkey")
    answerable = k % 7 != 0
    return t("orders").select(
        F.col("o_orderpriority").alias("kind"), F.when(answerable, k % 3 != 0).alias("answer_hit"), F.when(answerable, k % 11 == 0).alias("misattributed"), F.when(answerable & (k % 5 != 0), k % 2 == 0).alias("retrieval_hit"),
        F.when(answerable, k % 4).alias("ungrounded_count"), F.when(~answerable, k % 2 == 1).alias("refusal_correct"), (k % 100 / 100).alias("relevancy"), F.when(k % 3 == 0, k % 10 / 10).alias("faithfulness"),
    )


@query(
    "with a as (select * from orders where o_orderkey % 7 <> 0), m as (select 'answer_accuracy' metric, count(*) filter (o_orderkey % 3 <> 0) hits, count(*) \"of\" from a union all select 'misattributed_rate', count(*) filter (o_orderkey % 11 = 0), count(*) from a "
    "union all select 'ungrounded_cases', count(*) filter (o_orderkey % 4 > 0), count(*) from a union all select 'retrieval_hit_rate', count(*) filter (o_orderkey % 5 <> 0 and o_orderkey % 2 = 0), count(*) filter (o_orderkey % 5 <> 0) from a "
    "union all select 'refusal_correct', count(*) filter (o_orderkey % 2 = 1), count(*) from orders where o_orderkey % 7 = 0) select metric, hits, \"of\", round(hits / \"of\", 6) as \"share\" from m"
)
def grounding_summary(t, spark, sf_dir):
    return M.grounding_summary(_cases(t))


@query("select o_orderpriority kind, count(*) n, round(avg(case when o_orderkey % 7 <> 0 and o_orderkey % 3 <> 0 then 1.0 else 0 end), 6) answer_hit, round(avg(case when o_orderkey % 7 <> 0 and o_orderkey % 11 = 0 then 1.0 else 0 end), 6) misattributed from orders group by 1")
def answer_summary(t, spark, sf_dir):
    return M.answer_summary(_cases(t), ["answer_hit", "misattributed"], ["kind"])


@query("select 'relevancy' metric, count(*) n, round(avg(o_orderkey % 100 / 100), 6) mean, 0.4 target, avg(o_orderkey % 100 / 100) >= 0.4 reached from orders union all select 'faithfulness', count(*), round(avg(o_orderkey % 10 / 10), 6), 0.9, avg(o_orderkey % 10 / 10) >= 0.9 from orders where o_orderkey % 3 = 0")
def judge_means(t, spark, sf_dir):
    return M.metric_means(_cases(t), {"relevancy": 0.4, "faithfulness": 0.9})


_SUB = "select doc_id, n_chunks from (select *, sum(n_chunks) over (order by h, doc_id rows unbounded preceding) run from (select *, md5('3:' || doc_id) h from s where doc_id not in (select doc_id from {kept}) {apart})) where run <= {size} - (select sum(n_chunks) from s where doc_id in (select doc_id from {kept}))"
_WANT, _NEAR, _REST = "select doc_id, n_chunks from s where doc_id in (select doc_id from t)", "select doc_id, n_chunks from s where doc_id in (select doc_id from u)", "and doc_id not in (select doc_id from c)"


@query(
    "with d as (select distinct doc_id from archive_docs), n as (select doc_id, count(*) n from chunks group by 1), s as (select d.doc_id, coalesce(n, 0) n_chunks from d left join n using (doc_id)), "
    "t as (select distinct doc_id from archive_docs where doc_type = 'budget'), c as (select distinct doc_id from archive_docs where doc_type = 'statement' and doc_id not in (select doc_id from t)), u as (select * from t union all select * from c), "
    f"g as (select 'targets-only' condition, * from ({_WANT}) union all select 'confusable-only', * from ({_NEAR}) union all select 'disjoint@max', * from (select doc_id, n_chunks from s where doc_id not in (select doc_id from c)) "
    f"union all select 'disjoint@some', * from ({_WANT} union all {_SUB.format(kept='t', apart=_REST, size='(select sum(n_chunks) / 2 from s)')}) union all select 'both@some', * from ({_NEAR} union all {_SUB.format(kept='u', apart='', size='(select sum(n_chunks) / 2 from s)')})) "
    "select condition, count(*) n_docs, cast(sum(n_chunks) as bigint) n_chunks from g group by 1"
)
def evaluation_conditions(t, spark, sf_dir):
    """The archives on which retrieval is compared: targets alone, with what is easily confused, padded with the rest."""
    d = t("archive_docs")
    half = d.select("doc_id").distinct().join(t("chunks"), "doc_id").count() // 2
    grid = R.evaluation_conditions(d.select("doc_id").distinct(), t("chunks"), d.where("doc_type = 'budget'"), d.where("doc_type = 'statement'"), {"some": half}, "3")
    return grid.groupBy("condition").agg(F.count("*").alias("n_docs"), F.sum("n_chunks").alias("n_chunks"))


@query("select id, action, created_at from (select distinct id, action, created_at from audit_log where thread_id = (select min(thread_id) from threads))")
def audit_trail(t, spark, sf_dir):
    """The log of one job, each entry once, in the order of the ids."""
    first = t("threads").agg(F.min("thread_id").alias("m")).first().m
    return R.audit_trail(t("audit_log"), first).select("id", "action", "created_at")


# ── the index, sessions and what is handed on ────────────────────────────────

_PER_NATION = "with s as (select s_nationkey k, count(*) n from supplier group by 1), files as (select k, n from s)"


@query(
    _PER_NATION + ", keep as (select * from files where k % 5 <> 0) select 'first' as \"round\", (select count(*) from files) n_new, 0 n_unchanged, 0 n_pruned, (select count(*) from files) n_documents, (select sum(n) from files)::bigint n_facts "
    "union all select 'again', 0, (select count(*) from files), 0, (select count(*) from files), (select sum(n) from files)::bigint union all select 'fewer', 0, (select count(*) from keep), (select count(*) from files where k % 5 = 0), (select count(*) from keep), (select sum(n) from keep)::bigint "
    "union all select 'model', (select count(*) from keep), 0, 0, (select count(*) from keep), (select sum(n) from keep)::bigint"
)
def index_rounds(t, spark, sf_dir):
    """An index over a folder with a file per nation: built, built again unchanged, after a fifth of the files has gone, and under another embedder."""
    import uuid

    from ..session import shared_dir
    from ..sources.index import build_index, read_index

    root = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    folder = lambda k: f"{root}/files/Bestand-{k}-2024.csv"
    lines = t("supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(";", F.col("s_name"), german(F.col("s_acctbal"))))), "\n").alias("body")).collect()  # a fixture of at most 25 files
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in lines:
        out = fs.create(jvm.Path(folder(r.s_nationkey)))
        out.write(bytearray(f"Lieferant;Stand {r.s_nationkey} (EUR)\n{r.body}\n".encode()))
        out.close()

    def state(name: str, counts: dict[str, int]) -> tuple:
        index = read_index(spark, f"{root}/index")
        return (name, counts["new"], counts["unchanged"], counts["pruned"], index["documents"].count(), index["facts"].count())

    rows = [state("first", build_index(spark, f"{root}/files", f"{root}/index")), state("again", build_index(spark, f"{root}/files", f"{root}/index"))]
    for r in lines:
        if r.s_nationkey % 5 == 0:
            fs.delete(jvm.Path(folder(r.s_nationkey)), False)
    rows.append(state("fewer", build_index(spark, f"{root}/files", f"{root}/index")))
    rows.append(state("model", build_index(spark, f"{root}/files", f"{root}/index", embed_model="another")))
    fs.delete(jvm.Path(root), True)
    return spark.createDataFrame(rows, "round string, n_new bigint, n_unchanged bigint, n_pruned bigint, n_documents bigint, n_facts bigint")


@query(
    "with u as (select user_id, event_id, event_type || (event_id % 7) digest, (event_id % 10) * 1000000 n_bytes, event_id % 400 n_chunks from events), m as (select *, row_number() over (partition by user_id, digest order by event_id) = 1 f, n_bytes > 0 ok from u), "
    "r as (select *, sum(case when f and ok then 1 else 0 end) over w a, sum(case when f and ok then n_bytes else 0 end) over w b, sum(case when f and ok then n_chunks else 0 end) over w c from m window w as (partition by user_id order by event_id rows unbounded preceding)) "
    "select event_id, ok and (a <= 20 and b <= 52428800 and c <= 4000 or not f) accepted from r"
)
def upload_ceilings(t, spark, sf_dir):
    """Uploads under the ceilings of their sessions on files, bytes and passages; the same content again counts nothing."""
    k = F.col("event_id")
    u = t("events").select(F.col("user_id").alias("session_id"), "event_id", k.alias("uploaded_at"), F.concat("event_type", (k % 7).cast("string")).alias("digest"), (k % 10 * 1000000).alias("n_bytes"), (k % 400).alias("n_chunks"))
    return accepted_uploads(u).select("event_id", "accepted")


@query("with p as (select min(o_orderkey) n, o_clerk_text from (select o_orderkey, repeat('x', cast(o_orderkey % 900 as int)) o_clerk_text from orders) group by o_orderkey, o_clerk_text order by n limit 12), c as (select n, left(o_clerk_text, 700) x from p), s as (select *, sum(length(x)) over (order by n rows unbounded preceding) z from c) select n, length(x) n_chars from s where z <= 60")
def writer_budget(t, spark, sf_dir):
    """The first passages, clipped, that fit whole into a budget."""
    from ..engine import writer_passages

    ev = t("orders").select(F.col("o_orderkey").alias("n"), F.repeat(F.lit("x"), (F.col("o_orderkey") % 900).cast("int")).alias("text"))
    return writer_passages(ev, "n", 60).select("n", F.length("text").alias("n_chars"))


@query("select s_suppkey id, 'session' as scope, s_suppkey as \"rank\" from supplier where s_suppkey <= 5 union all select s_suppkey, 'knowledge_base', s_suppkey from supplier where s_suppkey between 3 and 9")
def scoped_hits(t, spark, sf_dir):
    """Session hits before archive hits, never fused."""
    s = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("rank"))
    return R.scoped_union(s.where("id <= 5"), s.where("id between 3 and 9")).select("id", "scope", "rank")


@query("select o_orderpriority expect_source, count(*) n_queries from orders group by 1 order by 2 desc, 1 limit 3")
def target_choice(t, spark, sf_dir):
    """The documents that most queries expect."""
    from ..engine import likely_targets

    return likely_targets(t("orders").select(F.col("o_orderpriority").alias("expect_source")), 3)
