"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .language import LEAST_CONFIDENCE, UNKNOWN, languages
from .leakage import find_leaks
from .mixing import AVAILABLE, mix_sources
from .nearest import nearest_vectors
from .neardup import link_counts, near_duplicates, record_groups, record_pairs
from .reading import calibration, measured, reading_profile
from .similar import similar_vectors
from .splitting import split_items


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar passages of other documents, however far, of every passage whose id is divisible by 100, against all passages."""
    return nearest_vectors(table(spark, sf_dir, "chunks"), F.col("id") % 100 == 0)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors(table(spark, sf_dir, "chunks"), least=0.9)
    return found.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every passage of kind text with its language."""
    chunks = table(spark, sf_dir, "chunks").where("kind = 'text'")
    return languages(chunks, "id", "text", "lang_hint").withColumnRenamed("id", "chunk_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p3_languages(spark, sf_dir)
    return found.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("lang") != UNKNOWN)).where("n_langs > 1 or hinted is null or hinted <> lang").select("chunk_id", "lang").distinct()


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "chunks").where("kind is null or kind <> 'notice'"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized passage."""
    return _split(spark, sf_dir).withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).where("piece = 0").select(F.col("id").alias("chunk_id"), "cut_class")


def _near(spark: SparkSession, sf_dir: str) -> list[tuple[str, tuple[DataFrame, DataFrame]]]:
    chunks = table(spark, sf_dir, "chunks").where("kind = 'text'")
    return [(n, near_duplicates(t, c, "text", threshold=0.6, size=3)) for n, t, c in (("chunks", chunks, "id"), ("documents", table(spark, sf_dir, "documents"), "doc_id"))]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (record_pairs(*got).select(F.lit(name).alias("rec_table"), "id_a", "id_b") for name, got in _near(spark, sf_dir))
    return a.unionByName(b)


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its class of equal texts (under the smallest id), its copies and its number of similar classes."""
    a, b = (link_counts(*got).withColumn("rec_table", F.lit(name)) for name, got in _near(spark, sf_dir))
    return a.unionByName(b)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the group of records that are the same but for small changes."""
    a, b = (record_groups(*got).withColumn("rec_table", F.lit(name)) for name, got in _near(spark, sf_dir))
    return a.unionByName(b)


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of a document that stands in an evaluation passage."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of the mixture."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total_tokens=AVAILABLE)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total_tokens=AVAILABLE)[1]


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading features, calibrated grade and level of every document."""
    return _profile(spark, sf_dir)


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage rank and counts of every document."""
    return measured(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_sentences", "n_long", "coverage_rank")


def p9_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the calibration and its error on grades held out."""
    return calibration(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).where("level in ('easy', 'hard')").select("doc_id", "level")


QUERIES = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours,
    "p3_found": p3_found, "p3_languages": p3_languages, "p4_found": p4_found, "p4_pieces": p4_pieces,
    "p5_found": p5_found, "p5_links": p5_links, "p5_groups": p5_groups, "p7_found": p7_found, "p7_spans": p7_spans, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_profile": p9_profile, "p9_coverage": p9_coverage, "p9_calibration": p9_calibration,
}

_EDGE = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"

_KEY = "coalesce(lower(trim(doc_id, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))), '')"


def _near_sql(name: str, key: str, rows: str) -> str:
    """Pairs of one table by counting shared shingles."""
    return f"""select '{name}' rec_table, a.id id_a, b.id id_b from {name}_s a join {name}_s b on a.s = b.s and a.id < b.id join {name}_n x on x.id = a.id join {name}_n y on y.id = b.id
 group by a.id, b.id, x.n, y.n having count(*) >= 0.6 * (x.n + y.n - count(*)) - 1e-9"""


def _shingle_sql(name: str, key: str, rows: str) -> str:
    return f"""{name}_w as (select {key} id, regexp_extract_all(lower(any_value("text")), '[\\p{{L}}\\p{{N}}]+') w from {rows} group by 1),
 {name}_s as (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s from (select id, w, unnest(range(1, len(w) - 1)) i from {name}_w where len(w) >= 20)), {name}_n as (select id, count(*) n from {name}_s group by 1)"""


def _class_sql(name: str, key: str, rows: str) -> str:
    """Classes of equal sets, links between their representatives, and what hangs together."""
    return f"""{name}_h as (select id, md5(string_agg(s, '|' order by s)) h from {name}_s group by 1), {name}_k as (select id, min(id) over (partition by h) class_id, count(*) over (partition by h) n_copies from {name}_h),
 {name}_p as ({_near_sql(name, key, rows)}), {name}_l as (select id_a u, id_b v from {name}_p where id_a in (select class_id from {name}_k) and id_b in (select class_id from {name}_k)
  and (select any_value(h) from {name}_h where id = id_a) <> (select any_value(h) from {name}_h where id = id_b)),
 {name}_e as (select u, v from {name}_l union all select v, u from {name}_l), {name}_r as (select class_id node, class_id root from {name}_k union select e.v, r.root from {name}_r r join {name}_e e on e.u = r.node where r.root < e.v),
 {name}_g as (select node, min(root) group_id from {name}_r group by 1)"""


_NEAR = (("chunks", "id", "(select * from chunks where kind = 'text')"), ("documents", "doc_id", "documents"))

ORACLE = {
    "p1_found": f"""
with v as (select id, any_value({_KEY}) d, any_value(embedding::double[]) e from chunks where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by id),
p as (select a.id, b.id o, list_cosine_similarity(a.e, b.e) c from v a join v b on a.d <> b.d and a.id <> b.id where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select *, row_number() over (partition by id order by c desc, o) n from p)
select distinct least(id, o) chunk_id_a, greatest(id, o) chunk_id_b from r where n <= 10""",
    "p5_found": "with " + ", ".join(_shingle_sql(*x) for x in _NEAR) + " " + " union all ".join(_near_sql(*x) for x in _NEAR),
    "p5_links": "with recursive " + ", ".join(_shingle_sql(*x) + ", " + _class_sql(*x) for x in _NEAR) + " " + " union all ".join(f"select '{n}' rec_table, k.id, class_id, n_copies, (select count(*) from {n}_e e where e.u = k.class_id) n_links from {n}_k k" for n, _, _ in _NEAR),
    "p5_groups": "with recursive " + ", ".join(_shingle_sql(*x) + ", " + _class_sql(*x) for x in _NEAR) + " " + " union all ".join(f"select '{n}' rec_table, k.id, class_id, group_id, count(*) over (partition by group_id) n_group from {n}_k k join {n}_g g on g.node = k.class_id" for n, _, _ in _NEAR),
    "p7_found": """
with i as (select item_id, regexp_extract_all(replace(strip_accents(lower(passage)), 'ß', 'ss'), '[\\p{L}\\p{N}]+') w from eval_items),
d as (select doc_id, regexp_extract_all(replace(strip_accents(lower("text")), 'ß', 'ss'), '[\\p{L}\\p{N}]+') w from documents),
ir as (select distinct item_id, list_aggregate(w[k:k + 11], 'string_agg', ' ') s from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
dr as (select doc_id, list_aggregate(w[k:k + 11], 'string_agg', ' ') s from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d))
select distinct doc_id, item_id from dr join ir on dr.s = ir.s""",
    "p7_spans": """
with i as (select item_id, regexp_extract_all(replace(strip_accents(lower(passage)), 'ß', 'ss'), '[\\p{L}\\p{N}]+') w from eval_items),
d as (select doc_id, regexp_extract_all(replace(strip_accents(lower("text")), 'ß', 'ss'), '[\\p{L}\\p{N}]+') w from documents),
ir as (select distinct item_id, list_aggregate(w[k:k + 11], 'string_agg', ' ') s from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
dr as (select doc_id, k, list_aggregate(w[k:k + 11], 'string_agg', ' ') s from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)),
m as (select distinct doc_id, item_id, k from dr join ir on dr.s = ir.s),
g as (select *, sum(fresh) over (partition by doc_id, item_id order by k) n from (select *, case when k - lag(k) over (partition by doc_id, item_id order by k) <= 12 then 0 else 1 end fresh from m)),
sp as (select doc_id, item_id, min(k) a, max(k) + 11 b from g group by doc_id, item_id, n)
select sp.doc_id, item_id, cast(a - 1 as int) first_word, cast(b - a + 1 as int) n_words, list_aggregate(w[a:b], 'string_agg', ' ') span from sp join d on d.doc_id = sp.doc_id""",
    "p4_found": f"""
with long as (select id, any_value(trim("text", {_EDGE})) t from chunks where (kind is null or kind <> 'notice') and length(trim("text", {_EDGE})) > 1200 group by id),
parts as (select id, t, list_max([length(trim(x, {_EDGE})) for x in string_split_regex(regexp_replace(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), ' [|] ', chr(10), 'g'), '[\\n\\r\\f]')]) stretch,
  list_max([length(x) for x in string_split_regex(t, '\\s+')]) run from long)
select id chunk_id, case when stretch <= 1200 then 'clean' when run <= 1200 then 'word' else 'hard' end cut_class from parts""",
    "p9_coverage": """
with w as (select doc_id, unnest(regexp_extract_all(lower("text"), '[\\p{L}\\p{N}]+')) word from documents where "text" is not null),
c as (select word, count(*) n from w group by 1), r as (select word, sum(n1) over (order by n desc) rank from (select word, n, 1 n1 from c)),
d as (select doc_id, cast(rank as bigint) rank, row_number() over (partition by doc_id order by rank) k, count(*) over (partition by doc_id) m from w join r using (word)),
cov as (select doc_id, rank from d where k = ceil(0.8 * m - 1e-9)),
f as (select doc_id, len(regexp_extract_all(coalesce("text", ''), '\\S+')) n_words,
  len(list_filter(string_split_regex(regexp_replace(regexp_replace(coalesce("text", ''), '\\n[ \\t\\r]*\\n', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S'))) n_sentences,
  len(list_filter(regexp_extract_all(coalesce("text", ''), '\\S+'), lambda x: regexp_matches(x, '\\p{L}{7}'))) n_long from documents)
select f.*, cov.rank coverage_rank from f left join cov using (doc_id)""",
    "p9_found": """
with f as (select doc_id, len(regexp_extract_all(coalesce("text", ''), '\\S+')) w,
  len(list_filter(string_split_regex(regexp_replace(regexp_replace(coalesce("text", ''), '\\n[ \\t\\r]*\\n', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S'))) s,
  len(list_filter(regexp_extract_all(coalesce("text", ''), '\\S+'), lambda x: regexp_matches(x, '\\p{L}{7}'))) l from documents)
select doc_id, case when w <= 9 * s then 'easy' else 'hard' end level from f
where w >= 20 and (w <= 9 * s and l * 4 <= w or w >= 30 * s and l * 10 >= w * 3)""",
}
