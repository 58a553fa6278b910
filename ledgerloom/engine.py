"""The engine as one object: search, inventory and exact aggregation over an archive, and sessions beside it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import records
from .operators.aggregate import FactStore, Result
from .operators.retrieval import artifacts, search_or_unfiltered
from .plans.render import inventory_text, render
from .sources.files import SUFFIXES, describe, elements_of, passages_of
from .sources.index import hashing_embedder, read_index
from .streaming.sessions import MAX_BYTES, MAX_CHUNKS, MAX_FILES, SessionRegistry

ENVELOPE = 20_000


def upload_error(name: str, content: bytes, max_bytes: int = MAX_BYTES) -> str | None:
    """Why an upload is refused, or None."""
    if not name.lower().endswith(SUFFIXES):
        return "unsupported format"
    if not content:
        return "empty file"
    return "file too large" if len(content) > max_bytes else None


@dataclass
class Engine:
    """Tables of an archive with its embedder. ``embed`` adds ``embedding`` to rows with ``text``."""

    spark: SparkSession
    documents: DataFrame
    chunks: DataFrame
    facts: FactStore
    embed: Callable[[DataFrame], DataFrame] = field(default_factory=hashing_embedder)
    registry: SessionRegistry = field(default_factory=SessionRegistry)
    postings: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, index: str, **more) -> Engine:
        """The engine over an index written by ``build_index``."""
        t = read_index(spark, index)
        return cls(spark, t["documents"], t["chunks"], FactStore(t["fact_tables"], t["facts"], t["fact_values"], t["documents"]), postings=t.get("postings"), **more)

    def vector(self, query: str) -> list[float] | None:
        return self.embed(self.spark.createDataFrame([(query,)], "text string")).first().embedding

    def search(self, query: str, doc_type: str = "", year: str = "", k: int = 6, channel: str = "hybrid") -> tuple[DataFrame, bool]:
        """(hits, whether the filters had to be dropped because nothing passed them)."""
        index = self.postings if "n_tokens" in self.chunks.columns else None
        return search_or_unfiltered(self.chunks, query, self.vector(query), doc_type=doc_type, year=year, k=k, channel=channel, index=index)

    def inventory(self, doc_type: str = "", year: str = "") -> DataFrame:
        return records.inventory(self.documents, self.chunks, doc_type, year)

    def list_documents(self, doc_type: str = "", year: str = "") -> str:
        """The inventory as text: documents, a warning beyond the envelope, the tables with what their columns allow."""
        return inventory_text(self.inventory(doc_type.strip(), year.strip()), self.stats().first(), self.facts.tables, doc_type, year, ENVELOPE)

    def tables_of(self, doc_type: str = "", year: str = "") -> DataFrame:
        """Columns and roles of the tables of the documents in the inventory."""
        return self.facts.available_columns().join(self.inventory(doc_type, year).select("source").distinct(), "source", "left_semi")

    def stats(self) -> DataFrame:
        return records.index_stats(self.documents, self.chunks, ENVELOPE)

    def aggregate(self, operation: str, **scope) -> Result:
        return self.facts.aggregate(operation, **scope)

    def answer(self, operation: str, **scope) -> str:
        return render(self.aggregate(operation, **scope))

    # ── sessions ─────────────────────────────────────────────────────────────

    def attach(self, session_id: str, name: str, content: bytes, now: float) -> str | None:
        """Add a file to a session; returns why it was refused, or None. The archive is not touched."""
        if (why := upload_error(name, content)) is not None:
            return why
        own = self.registry.get_or_create(session_id, now)
        if len(own) >= MAX_FILES:
            return "too many files"
        parsed = elements_of(self.spark.createDataFrame([(name, bytearray(content))], "path string, content binary"))
        passages = self.embed(passages_of(parsed, describe(parsed)))
        if sum(d.count() for d in own.values()) + passages.count() > MAX_CHUNKS:
            return "too many passages"
        doc = passages.select("doc_id").first()
        if doc is not None:
            own[doc.doc_id] = passages  # the same content again replaces itself
        return None

    def search_with_session(self, session_id: str, query: str, now: float, k: int = 6) -> DataFrame:
        """Session hits first, then those of the archive, each in its order."""
        own = self.registry.get_or_create(session_id, now)
        archive, _ = self.search(query, k=k)
        hits = archive
        if own:
            frames = list(own.values())
            mine = frames[0]
            for f in frames[1:]:
                mine = mine.unionByName(f, allowMissingColumns=True)
            session, _ = search_or_unfiltered(mine, query, self.vector(query), k=k)
            hits = records.scoped_union(session, archive)
        return hits

    def artifacts(self, hits: DataFrame) -> DataFrame:
        return artifacts(hits)


def writer_passages(evidence: DataFrame, order: str, budget: int, limit: int = 12, chars: int = 700) -> DataFrame:
    """The first passages, each clipped, that fit whole into a budget of characters."""
    top = evidence.orderBy(order).limit(limit).withColumn("text", F.left("text", F.lit(chars))).withColumn("__n", F.length("text"))
    return records.within_budget(top, "__n", [F.col(order)], budget).drop("__n")


def write_report(evidence: DataFrame, order: str, budget: int, write: Callable[[list[str]], str]) -> str:
    """What ``write`` makes of the passages; if that is empty, of half as many, each clipped to 400 characters."""
    full = [r.text for r in writer_passages(evidence, order, budget).orderBy(order).collect()]  # at most 12
    text = write(full)
    if text.strip() or not full:
        return text
    return write([r.text for r in writer_passages(evidence, order, budget, max(1, len(full) // 2), 400).orderBy(order).collect()])


def likely_targets(queries: DataFrame, n: int) -> DataFrame:
    """expect_source, n_queries: the n documents that most queries expect, ties by name."""
    return queries.groupBy("expect_source").agg(F.count("*").alias("n_queries")).orderBy(F.desc("n_queries"), "expect_source").limit(n)
