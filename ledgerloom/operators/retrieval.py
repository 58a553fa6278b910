"""Dense, lexical and fused ranking of passages.

Filters apply inside each ranker. Ranking moves ids and scores only; the text
of the k hits is joined last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.archive import has_literal_anchor, query_terms
from ..functions.text import fold_accents
from ..session import cut, ship, spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, SOFT_WEIGHT = 60, 0.25


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if one is null, of no length or of another length."""
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    x, y = d(a), d(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(x, y) / norm)


def dense_topk(chunks: DataFrame, query: list[float], k: int = 50, where: Column | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, score, rank: the k passages of the greatest cosine, ties by id. Passages without a vector are left out."""
    c = chunks.where(F.col(vector_col).isNotNull())
    if where is not None:
        c = c.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = c.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).where("score is not null and not isnan(score)")
    return _ranked(scored, k)


def dense_topk_many(chunks: DataFrame, queries: DataFrame, k: int = 50, block: int = 4096, id_col: str = "id", vector_col: str = "embedding", query_col: str = "query_id") -> DataFrame:
    """query, id, score, rank: the k passages of the greatest cosine for each query, ties by id.

    queries hold query_col and vector_col; a passage whose id is the query's is
    left out. A block of queries (about ``block`` by the hash of the id, held by
    every task) is one matrix product per batch of passages, of which only k per
    query leave the task. Vectors that are null, of no length, of another
    length than the query's or not finite never meet. Scores count to twelve
    digits.
    """
    spark = chunks.sparkSession
    ship(spark)
    q = queries.select(F.col(query_col).alias("query"), F.col(vector_col).cast("array<double>").alias("v")).where("query is not null and v is not null").dropDuplicates(["query"])
    src = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    id_type, query_type = src.schema["id"].dataType.simpleString(), q.schema["query"].dataType.simpleString()
    blocks = max(1, math.ceil(q.count() / block))

    def units(ids: pa.Array, column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Ids and unit vectors by length."""
        size = np.asarray(pc.list_value_length(column))
        for dim in np.unique(size[size > 0]).tolist():
            rows = pa.array(np.flatnonzero(size == dim))
            x = np.asarray(pc.fill_null(column.take(rows).flatten(), float("nan"))).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            yield ids.take(rows).filter(pa.array(ok)), x[ok] / norm[ok, None]

    def pass_over(n: int) -> DataFrame:
        got = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toArrow().combine_chunks()
        parts = [] if not got.num_rows else list(units(got.column("query").chunk(0), got.column("v").chunk(0)))
        held = spark.sparkContext.broadcast({x.shape[1]: (ids, x) for ids, x in parts})

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x in units(batch.column("id"), batch.column("v")):
                    asked, y = held.value.get(x.shape[1], (None, None))
                    if asked is None or not len(asked) or not len(ids):
                        continue
                    s = np.round(y @ x.T, 12)
                    keep = min(len(ids), k + 1)  # one may be the query itself
                    bar = np.partition(s, len(ids) - keep, axis=1)[:, len(ids) - keep]
                    i, j = np.nonzero(s >= bar[:, None])
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[i, j])], ["query", "id", "score"])

        return src.mapInArrow(score, f"query {query_type}, id {id_type}, score double")

    found = pass_over(0)
    for n in range(1, blocks):
        found = found.unionByName(pass_over(n))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.where(F.col("id") != F.col("query")).withColumn("rank", nth).where(F.col("rank") <= k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best with their rank; the sort is a top-k, the window sees k rows."""
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def folded_tokens(text: Column) -> Column:
    """Tokens of a text as the index knows them: lower case, without accents."""
    return F.regexp_extract_all(fold_accents(F.lower(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """term, id, tf, length: the inverted index of a set of passages, with the length of each passage in tokens.

    A passage's rows follow from its text alone, so the index is kept up to
    date by replacing the rows of passages that change.
    """
    t = chunks.select(F.col(id_col).alias("id"), folded_tokens(F.col(text_col)).alias("tokens"), *keep)
    rows = t.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"), *keep)
    return rows.groupBy("term", "id", "length", *keep).agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency, kept a little above zero."""
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def bm25_topk(chunks: DataFrame, query: str, k: int = 50, where: Column | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, score, rank: BM25 of the passages that hold any query term; a repeated term counts each time.

    Statistics are those of the passages that pass the filter. The texts are
    read once: what the score needs of each passage that holds a term is
    written, then scored with the statistics. Nothing is shuffled but k rows.
    """
    spark = chunks.sparkSession
    c = chunks if where is None else chunks.where(where)
    terms = spark.range(1).select(query_terms(F.lit(query)).alias("t")).first().t
    if not terms:
        return _ranked(c.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false"), k)
    distinct = list(dict.fromkeys(terms))
    tokens = spread(c.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col))).select("id", folded_tokens(F.col(text_col)).alias("tokens"))
    met = tokens.select("id", F.size("tokens").alias("length"), F.filter("tokens", lambda x: x.isin(*distinct)).alias("met"))
    times = lambda term: F.size(F.filter("met", lambda x: x == F.lit(term)))
    counted = cut(met.select("id", "length", F.array(*map(times, distinct)).alias("tf")), "met")
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(distinct))])
    joined = counted.join(F.broadcast(stats))  # one row of statistics
    weight = lambda i: F.lit(float(terms.count(distinct[i]))) * idf(F.col("n"), F.col(f"df{i}"))
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    score = sum((weight(i) * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + norm) for i in range(len(distinct))), F.lit(0.0))
    return _ranked(joined.select("id", score.alias("score")).where("score > 0"), k)  # on the score, as a filter on tf would count it twice


def bm25_stored(index: DataFrame, lengths: DataFrame, query: str, k: int = 50) -> DataFrame:
    """id, score, rank: the same as ``bm25_topk`` from stored postings.

    index is what ``postings`` gave, lengths (id, n_tokens) of all passages that
    take part: those that pass the filter. Only the postings of the query's
    terms are read; no text is.
    """
    terms = index.sparkSession.range(1).select(query_terms(F.lit(query)).alias("t")).first().t
    if not terms:
        return _ranked(lengths.select("id", F.lit(0.0).alias("score")).where("false"), k)
    times = {t: float(terms.count(t)) for t in terms}
    met = index.where(F.col("term").isin(*times)).select("term", "id", "tf").join(lengths.select("id", F.col("n_tokens").alias("length")), "id")
    stats = lengths.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"))
    per_term = met.groupBy("term").agg(F.count("*").alias("df"))  # at most as many rows as the query has terms
    asked = F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("term"))
    joined = met.join(F.broadcast(per_term), "term").join(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    score = asked * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return _ranked(joined.groupBy("id").agg(F.sum(score).alias("score")).where("score > 0"), k)


def fuse(dense: DataFrame, lexical: DataFrame, k: int = 6, lexical_weight: float = 1.0) -> DataFrame:
    """id, score, in_dense, in_lexical, rank: weighted reciprocal ranks; ties by dense, then lexical rank."""
    side = lambda d, w, name: d.select("id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("part"), F.when(F.lit(name == "d"), F.col("rank")).alias("dense_rank"), F.when(F.lit(name == "l"), F.col("rank")).alias("lexical_rank"))
    both = side(dense, 1.0, "d").unionByName(side(lexical, lexical_weight, "l"))
    per = both.groupBy("id").agg(F.sum("part").alias("score"), F.max("dense_rank").alias("dense_rank"), F.max("lexical_rank").alias("lexical_rank"))
    by = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.asc("id")]
    top = per.orderBy(*by).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    return top.select("id", F.round("score", 6).alias("score"), F.col("dense_rank").isNotNull().alias("in_dense"), F.col("lexical_rank").isNotNull().alias("in_lexical"), "rank")


def search(chunks: DataFrame, query: str, query_vector: list[float] | None, k: int = 6, depth: int = 50, doc_type: str = "", year: str = "", channel: str = "hybrid", scope: str = "knowledge_base", index: DataFrame | None = None) -> DataFrame:
    """The k hits with their passages, by both channels or one of them ('dense', 'lexical').

    With an index of stored postings (and n_tokens in chunks) the lexical
    channel reads these instead of the texts.

    The lexical channel has full weight only if the query holds a literal
    anchor. Without a query vector the lexical channel ranks alone.
    """
    where = F.lit(True)
    if doc_type:
        where = where & (F.col("doc_type") == doc_type)
    if year:
        where = where & (F.col("year") == year)
    none = chunks.select(F.col("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    dense = dense_topk(chunks, query_vector, depth, where) if query_vector is not None and channel != "lexical" else none
    lexical = none if channel == "dense" else bm25_stored(index, chunks.where(where).select("id", "n_tokens"), query, depth) if index is not None else bm25_topk(chunks, query, depth, where)
    anchored = chunks.sparkSession.range(1).select(has_literal_anchor(F.lit(query)).alias("a")).first().a
    hits = fuse(dense, lexical, k, 1.0 if anchored or channel == "lexical" else SOFT_WEIGHT)
    kept = [c for c in chunks.columns if c not in ("embedding", "score", "rank", "scope", "in_dense", "in_lexical")]
    return chunks.select(*kept).join(F.broadcast(hits), "id").withColumn("scope", F.lit(scope)).orderBy("rank")  # at most k hits


def search_or_unfiltered(chunks: DataFrame, query: str, query_vector: list[float] | None, **args) -> tuple[DataFrame, bool]:
    """Hits under the filters; if there are none, hits without them and True."""
    hits = search(chunks, query, query_vector, **args)
    if not (args.get("doc_type") or args.get("year")) or not hits.isEmpty():
        return hits, False
    return search(chunks, query, query_vector, **{k: v for k, v in args.items() if k not in ("doc_type", "year")}), True


def artifacts(hits: DataFrame, limit: int = 1200) -> DataFrame:
    """Hits as they are handed on: eight fields, the text clipped."""
    from ..functions.archive import clip

    return hits.select("source", "locator", "kind", clip(F.col("text"), limit).alias("text"), "doc_type", "year", "score", "scope")
