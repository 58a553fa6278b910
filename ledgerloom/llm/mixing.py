"""Mixing sources to target shares of all tokens by systematic sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import cut, ship, spread

#: as total_tokens: as many tokens as the target sources have
AVAILABLE = "available"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_name(c: Column) -> Column:
    """Spelling under which a source is known: lower case, no surrounding blanks, '_' for blanks and '-'."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s-]+", "_")


def count_tokens(documents: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str = TOKENIZER, pattern: str | None = None) -> DataFrame:
    """id, source, n_tokens under a public byte-level vocabulary; null texts have 0.

    The vocabulary file is read once by the driver and sent to the tasks (its
    size is that of the file). Without a pattern, the one that comes with the
    public vocabularies is taken; where these are not installed this raises.
    """
    ship(documents.sparkSession)
    if pattern is None:
        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            raise ValueError("give the pattern by which the vocabulary's texts are cut: no public_tokenizers here") from None
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = documents.sparkSession.sparkContext.broadcast((pattern, ranks))
    src = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        pat, table = held.value
        enc = tiktoken.Encoding("mix", pat_str=pat, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(n, pa.int64())], ["id", "source", "n_tokens"])

    return spread(src).mapInArrow(count, f"id {kind}, source string, n_tokens bigint")


def plan_repeats(available: dict[str, int], targets: list[tuple[str, float, int | None]], total: float | None = None) -> dict[str, float]:
    """Expected copies of each document of a source.

    Shares are those of the weights of the sources that have tokens. Without a
    total, the largest one is taken at which no source is repeated more often
    than it may be, so that every share is met; if no source has a cap, each
    comes out at least once. With a larger total, capped sources stay at their
    cap and the others take over in proportion to their weights.
    """
    live = {s: (w, cap) for s, w, cap in targets if w > 0 and available.get(s, 0) > 0 and (cap is None or cap > 0)}
    if not live:
        return {}
    whole = sum(w for w, _ in live.values())
    if total is None:
        capped = [cap * available[s] * whole / w for s, (w, cap) in live.items() if cap is not None]
        total = min(capped) if capped else max(available[s] * whole / w for s, (w, _) in live.items())
    out: dict[str, float] = {}
    open_, left = dict(live), float(total)
    while open_:
        whole = sum(w for w, _ in open_.values())
        full = [s for s, (w, cap) in open_.items() if cap is not None and left * w / whole > cap * available[s] * (1 + 1e-12)]
        if not full:
            return out | {s: left * w / whole / available[s] for s, (w, _) in open_.items()}
        for s in full:
            cap = open_.pop(s)[1]
            out[s] = float(cap)
            left -= cap * available[s]
    return out


def mix_sources(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_tokens: float | str | None = None, seed: int = 7, tokenizer: str = TOKENIZER, pattern: str | None = None, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of a mixture in which every source has its target share of all tokens.

    copies: source, doc_id, copy, n_tokens, one row per emitted copy. Within a
    source the documents are put in the order of their size; the running sum of
    their expected copies plus one random offset crosses an integer boundary
    for every copy. So a document has at most ceil(repeats) copies and a
    source's tokens are off its target by little more than the largest
    document. shares: source, weight, target_share, max_repeats, n_docs,
    available_tokens, repeats, n_copies, tokens, actual_share for every target,
    those without documents with zeros and target_share 0. Target names given
    twice are added up (the smaller cap holds); documents delivered twice count
    once; null sources and texts without tokens are left out. Targets are a
    small list (checked against max_sources). Without total_tokens every share
    is met, however small the mixture; with AVAILABLE the mixture is about as
    large as the target sources, those that reach their cap fall short of their
    share, and shares says by how much.
    """
    spark = documents.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null and weight is not null").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    wanted: dict[str, tuple[float, int | None]] = {}
    for r in rows:
        w, cap = wanted.get(r.source, (0.0, None))
        caps = [c for c in (cap, r.max_repeats) if c is not None]
        wanted[r.source] = (w + r.weight, min(caps) if caps else None)
    named = documents.select(F.col(id_col).alias("id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where(F.col("source").isin(*wanted) if wanted else F.lit(False))
    sized = count_tokens(named, "id", "source", "text", tokenizer, pattern).where("n_tokens > 0").groupBy("id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
    # one order over all sources, cut into parts of bounded size: no task holds a whole source
    kept = cut(sized.repartitionByRange("source", "n_tokens", F.xxhash64("id", F.lit(seed)), "id").withColumn("part", F.spark_partition_id()), "mixing")
    parts = kept.groupBy("source", "part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("n_tokens").alias("least"))
    available = {r.source: r.t for r in parts.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    if total_tokens == AVAILABLE:
        total_tokens = sum(available.values())
    repeats = plan_repeats(available, [(s, w, cap) for s, (w, cap) in wanted.items()], total_tokens)
    whole = sum(wanted[s][0] for s in repeats)
    plan = spark.createDataFrame([(s, float(w), cap, wanted[s][0] / whole if s in repeats else 0.0, repeats.get(s, 0.0)) for s, (w, cap) in wanted.items()], "source string, weight double, max_repeats int, target_share double, repeats double")
    before = parts.selectExpr("source", "part", "sum(docs) over (partition by source order by part) - docs as skip")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    numbered = (
        kept.join(before, ["source", "part"])
        .join(F.broadcast(plan), "source")
        .selectExpr("*", f"skip + row_number() over (partition by source, part order by n_tokens, xxhash64(id, {int(seed)}), id) as nth")
    )
    crossed = lambda k: F.floor(F.col("repeats") * k + offset)
    drawn = numbered.withColumn("copies", crossed(F.col("nth")) - crossed(F.col("nth") - 1)).where("copies > 0")
    copies = drawn.select("source", F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "n_tokens")
    got = drawn.groupBy("source").agg(F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    held = parts.groupBy("source").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("available_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = plan.join(held, "source", "left").join(got, "source", "left").select("source", "weight", "target_share", "max_repeats", zero("n_docs"), zero("available_tokens"), "repeats", zero("n_copies"), zero("tokens"))
    return copies, shares.selectExpr("*", "coalesce(tokens / nullif(sum(tokens) over (), 0), 0d) actual_share")
