"""Inventory, sets and duplicates of documents and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inventory(documents: DataFrame, chunks: DataFrame, doc_type: str = "", year: str = "") -> DataFrame:
    """Documents with their number of passages (0 if none), by type and source."""
    d = documents
    if doc_type:
        d = d.where(F.col("doc_type") == doc_type)
    if year:
        d = d.where(F.col("year") == year)
    n = chunks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return d.join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).orderBy("doc_type", "source")


def index_stats(documents: DataFrame, chunks: DataFrame, envelope: int = 20_000) -> DataFrame:
    """One row: documents, passages, embedded passages, types with counts, years, whether the archive is beyond its envelope."""
    per = documents.groupBy("doc_type").agg(F.count("*").alias("n"))
    types = per.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "doc_type", "n"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["doc_type"].alias("doc_type"), x["n"].alias("n"))).alias("doc_types"))
    docs = documents.agg(F.count("*").alias("n_documents"), F.sort_array(F.collect_set(F.nullif("year", F.lit("")))).alias("years"))
    passages = chunks.agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded"))
    return docs.join(passages).join(types).withColumn("beyond_envelope", F.col("n_chunks") > envelope)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the last by the order: an upsert."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_evidence(passages: DataFrame, order: str, prefix: int = 80) -> DataFrame:
    """First passage of each (source, locator, beginning of the text), in order."""
    w = Window.partitionBy("source", "locator", F.left("text", F.lit(prefix))).orderBy(order)
    return passages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def by_content(files: DataFrame, content_col: str, path_col: str) -> DataFrame:
    """doc_id, path, n_files: one row per content, under its first path."""
    return files.select(F.sha2(F.col(content_col).cast("binary"), 256).alias("doc_id"), F.col(path_col).alias("path")).groupBy("doc_id").agg(F.min("path").alias("path"), F.count("*").alias("n_files"))


def changed(present: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, unchanged, gone) by key: what to parse, to skip and to prune."""
    return present.join(known, key, "left_anti"), present.join(known, key, "left_semi"), known.join(present, key, "left_anti")


def scoped_union(session_hits: DataFrame, archive_hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Session hits before archive hits, each in its own order; the tiers are never fused."""
    tag = lambda d, n, s: d.withColumn("scope", F.lit(s)).withColumn("__tier", F.lit(n))
    return tag(session_hits, 0, "session").unionByName(tag(archive_hits, 1, "knowledge_base"), allowMissingColumns=True).orderBy("__tier", rank).drop("__tier")


def within_budget(df: DataFrame, size: str, order: list[Column], budget: float, keys: list[str] | None = None) -> DataFrame:
    """Rows in order while the sum of their sizes stays within the budget; a row that does not fit ends the list."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(size).over(w)).where(F.col("__sum") <= budget).drop("__sum")


def padded_subset(documents: DataFrame, chunks: DataFrame, targets: DataFrame, budget: int, seed: str = "0") -> DataFrame:
    """doc_id, n_chunks: the target documents, padded with others in the order of a seeded hash up to a number of passages.

    Only the padding is cut by a running sum, over at most as many documents
    with passages as there is room for; documents without passages come out as
    far as the sum reaches. Targets beyond the budget get no padding.
    """
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    sized = documents.select("doc_id").distinct().join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    wanted = sized.join(targets.select("doc_id").distinct(), "doc_id", "left_semi")
    used = wanted.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("used")).first().used
    rest = sized.join(wanted, "doc_id", "left_anti").withColumn("h", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("doc_id").cast("string"))))
    room = budget - used
    if room < 0:
        return wanted
    first = rest.where("n_chunks > 0").orderBy("h", "doc_id").limit(room + 1)
    pad = within_budget(first, "n_chunks", [F.col("h"), F.col("doc_id")], room)
    beyond = first.join(pad, "doc_id", "left_anti").orderBy("h", "doc_id").first()
    free = rest.where("n_chunks = 0")
    if beyond is not None:
        free = free.where((F.col("h") < beyond.h) | (F.col("h") == beyond.h) & (F.col("doc_id") < F.lit(beyond.doc_id)))
    return wanted.unionByName(pad.unionByName(free).select("doc_id", "n_chunks"))


def evaluation_conditions(documents: DataFrame, chunks: DataFrame, targets: DataFrame, confusable: DataFrame, sizes: dict[str, int], seed: str = "0") -> DataFrame:
    """condition, doc_id, n_chunks: the archives on which retrieval is compared.

    'targets-only'; 'confusable-only', the targets with what is easily taken for
    them; 'disjoint@<size>', the targets padded with the rest up to a number of
    passages; 'disjoint@max', with all of the rest; 'both@<size>', all three.
    """
    want, near = targets.select("doc_id").distinct(), confusable.select("doc_id").distinct().join(targets.select("doc_id"), "doc_id", "left_anti")
    apart = documents.join(near, "doc_id", "left_anti")
    both = want.unionByName(near)
    none = documents.where("false")
    grid = {"targets-only": (none, want, 0), "confusable-only": (none, both, 0), "disjoint@max": (apart, want, None)}
    grid |= {f"disjoint@{n}": (apart, want, size) for n, size in sizes.items()} | {f"both@{n}": (documents, both, size) for n, size in sizes.items()}
    out = None
    for name, (rest, kept, size) in grid.items():
        among = rest.select("doc_id").unionByName(kept)
        if size is None or size == 0:
            sized = among.distinct().join(chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
        else:
            sized = padded_subset(among, chunks, kept, size, seed)
        one = sized.select(F.lit(name).alias("condition"), "doc_id", "n_chunks")
        out = one if out is None else out.unionByName(one)
    return out


def audit_trail(audit: DataFrame, thread_id: str) -> DataFrame:
    """The entries of one job in the order of their ids, each once."""
    return audit.where(F.col("thread_id") == thread_id).dropDuplicates(["id"]).orderBy("id")


def recent_jobs(threads: DataFrame, limit: int = 100) -> DataFrame:
    """The latest jobs, newest first, ties by id."""
    return threads.orderBy(F.desc("created_at"), "thread_id").limit(limit)


def parse_status(kinds: DataFrame) -> DataFrame:
    """doc_id, status: 'error' if a notice is a parse error, 'partial' if there is any notice, else 'ok'."""
    notice = F.col("kind") == "notice"
    return kinds.groupBy("doc_id").agg(F.when(F.bool_or(notice & (F.coalesce(F.col("reason"), F.lit("")) == "parse_error")), "error").when(F.bool_or(notice), "partial").otherwise("ok").alias("status"))


def scrub(tables: dict[str, DataFrame], thread_id: str) -> dict[str, DataFrame]:
    """Every table that has a thread_id, without the rows of one thread; ``sources.results.scrub_files`` also rewrites the files."""
    return {n: t.where(F.coalesce(F.col("thread_id") != thread_id, F.lit(True))) if "thread_id" in t.columns else t for n, t in tables.items()}
