"""The archive's index as Parquet folders, kept up to date by content hash.

Layout: documents, chunks, postings, fact_tables, facts, fact_values, each
partitioned by the first two digits of doc_id (postings sorted by term inside,
so a query reads the row groups of its terms), and meta with the name of the embedder. A run
parses only files whose content is not known, rewrites only the partitions they
fall into and drops documents whose file is gone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract
from ..operators.retrieval import folded_tokens, postings
from ..operators.records import by_content, changed, parse_status
from ..session import cut
from .files import describe, elements_of, list_files, passages_of, payloads_of

TABLES = ("documents", "chunks", "postings", "fact_tables", "facts", "fact_values")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _filled(spark: SparkSession, path: str) -> bool:
    """Whether a table has any partition."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(x.getPath().getName().startswith("part=") for x in fs.listStatus(p))


def read_index(spark: SparkSession, index: str) -> dict[str, DataFrame]:
    """The tables of an index; empty if there is none yet."""
    return {n: spark.read.option("mergeSchema", "true").parquet(f"{index}/{n}") for n in TABLES if _filled(spark, f"{index}/{n}")}


def index_exists(spark: SparkSession, index: str) -> bool:
    """Whether there is an index with at least one passage."""
    chunks = read_index(spark, index).get("chunks")
    return chunks is not None and not chunks.isEmpty()


def hashing_embedder(dim: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Bag-of-words vectors from hashes of the tokens, of length one: an embedder that needs no model."""

    def embed(chunks: DataFrame) -> DataFrame:
        tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        place = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter("__place", lambda p: p == i)).cast("double"))
        norm = F.sqrt(F.aggregate("__counts", F.lit(0.0), lambda s, x: s + x * x))
        vector = F.when(norm > 0, F.transform("__counts", lambda x: (x / norm).cast("float")))
        return chunks.withColumn("__place", place).withColumn("__counts", counts).withColumn("embedding", vector).drop("__place", "__counts")

    return embed


def _part(doc_id: str = "doc_id"):
    """Partition of a document; the letter keeps it a text."""
    return F.concat(F.lit("h"), F.left(doc_id, F.lit(2))).alias("part")


def _write(df: DataFrame, path: str) -> None:
    parted = df.withColumn("part", _part()).repartition("part")
    (parted.sortWithinPartitions("part", "term") if "term" in df.columns else parted).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def build_index(spark: SparkSession, folder: str, index: str, embed_model: str = "hashing-64", embed: Callable[[DataFrame], DataFrame] | None = None, rebuild: bool = False) -> dict[str, int]:
    """Bring the index in line with the folder; returns the numbers of new, unchanged and pruned documents.

    Another embedder or ``rebuild`` replaces everything. A folder that does not
    exist raises instead of pruning the whole archive.
    """
    if not _exists(spark, folder):
        raise FileNotFoundError(folder)
    files = list_files(spark, folder)
    present = by_content(files, "content", "path")
    meta = spark.read.parquet(f"{index}/meta").first().embed_model if _exists(spark, f"{index}/meta") else None
    old = read_index(spark, index)
    fresh = rebuild or meta != embed_model or "documents" not in old
    known = present.where("false").select("doc_id") if fresh else old["documents"].select("doc_id")
    new, same, gone = changed(present, known, "doc_id")
    new, same, gone = cut(new, "new"), cut(same, "same"), cut(gone, "gone")
    counts = {"new": new.count(), "unchanged": same.count(), "pruned": gone.count()}
    if fresh and old:
        fs = spark._jvm.org.apache.hadoop.fs.Path(index).getFileSystem(spark._jsc.hadoopConfiguration())
        for n in TABLES:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{n}"), True)
        old = {}
    if counts["new"] or counts["pruned"] or fresh:
        parsed = cut(elements_of(files.join(F.broadcast(new), "path", "left_semi") if counts["new"] < 1000 else files.join(new, "path", "left_semi")), "elements")
        about = describe(parsed)
        status = parse_status(parsed)
        head = parsed.groupBy("doc_id").agg(F.min("source").alias("source"), F.min("path").alias("rel_path"), F.count("*").cast("int").alias("n_elements"), F.to_json(F.sort_array(F.collect_set("reason"))).alias("parse_note"))
        now = F.current_timestamp()
        docs = head.join(about, "doc_id").join(status, "doc_id").withColumnRenamed("status", "parse_status").withColumn("ingested_at", now).withColumn("facts_at", now)
        tables, facts, values = extract(payloads_of(parsed, about))
        passages = passages_of(parsed, about)
        made = {
            "documents": docs, "chunks": (embed or hashing_embedder())(passages.withColumn("n_tokens", F.size(folded_tokens(F.col("text"))))), "postings": postings(passages, keep=("doc_id",)), "fact_tables": tables,
            "facts": facts, "fact_values": values.join(facts.select(F.col("id").alias("fact_id"), "doc_id"), "fact_id"),
        }
        touched = new.select("doc_id").union(gone.select("doc_id")).select(_part()).distinct()
        for n, df in made.items():
            out = df
            if n in old:  # the partitions to rewrite, without pruned and newly parsed documents
                kept = old[n].join(touched, "part", "left_semi").join(gone, "doc_id", "left_anti").join(new, "doc_id", "left_anti").drop("part")
                out = df.unionByName(kept, allowMissingColumns=True)
            out = cut(out, f"index-{n}")
            empty = touched.join(out.select(_part()).distinct(), "part", "left_anti").collect()  # at most 256
            if not out.isEmpty() or n not in old:
                _write(out, f"{index}/{n}")
            if n in old:
                fs = spark._jvm.org.apache.hadoop.fs.Path(index).getFileSystem(spark._jsc.hadoopConfiguration())
                for r in empty:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{n}/part={r.part}"), True)
    spark.createDataFrame([(embed_model,)], "embed_model string").coalesce(1).write.mode("overwrite").parquet(f"{index}/meta")
    return counts


def backfill_facts(documents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, fact_tables, facts, fact_values) for documents indexed before facts existed (facts_at null).

    Parses only; every such document is stamped, with or without tables.
    """
    missing = documents.where("facts_at is null").select("doc_id")
    todo = files.withColumn("doc_id", F.sha2("content", 256)).join(missing, "doc_id", "left_semi")
    parsed = elements_of(todo)
    stamped = documents.withColumn("facts_at", F.coalesce("facts_at", F.current_timestamp().cast(documents.schema["facts_at"].dataType)))
    return (stamped, *extract(payloads_of(parsed, describe(parsed))))
