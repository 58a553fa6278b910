"""Quality of retrieval and of answers as plain dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(hits: DataFrame, expected: DataFrame, query: str = "query_id", source: str = "source") -> DataFrame:
    """query_id, kind, rank: rank of the expected source among a query's hits, null if it is not there."""
    met = hits.join(expected.select(query, F.col("expect_source").alias(source)), [query, source]).groupBy(query).agg(F.min("rank").alias("rank"))
    return expected.select(query, "kind").join(met, query, "left")


def retrieval_metrics(ranks: DataFrame, k: int = 6) -> DataFrame:
    """kind, n, hit_at_1, recall_at_k, mrr: per kind and, as kind 'all', overall."""
    within = F.coalesce(F.col("rank") <= k, F.lit(False))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return ranks.groupingSets([["kind"], []], "kind").agg(
        F.grouping("kind").alias("__all"), F.count("*").alias("n"), share(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("hit_at_1"), share(within).alias("recall_at_k"), share(F.when(within, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")
    ).select(F.when(F.col("__all") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n", "hit_at_1", "recall_at_k", "mrr")


def answer_summary(cases: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """n and the share of cases with each flag, per group; a null flag is no hit, no cases give no rows."""
    share = lambda f: F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")), 6).alias(f)
    return cases.groupBy(*(by or [])).agg(F.count("*").alias("n"), *map(share, flags)).where("n > 0")


def grounding_summary(cases: DataFrame) -> DataFrame:
    """metric, hits, of, share: how answers held up against their sources, one row a metric.

    Cases with answer_hit are answerable, those with refusal_correct are not;
    cases with neither count nowhere. share is null where nothing counts.
    """
    answerable = F.col("answer_hit").isNotNull()
    looked = answerable & F.col("retrieval_hit").isNotNull()
    metrics = {
        "answer_accuracy": (answerable & F.col("answer_hit"), answerable),
        "misattributed_rate": (answerable & F.col("misattributed"), answerable),
        "ungrounded_cases": (answerable & (F.col("ungrounded_count") > 0), answerable),
        "retrieval_hit_rate": (looked & F.col("retrieval_hit"), looked),
        "refusal_correct": (F.col("refusal_correct"), F.col("refusal_correct").isNotNull()),
    }
    counted = cases.agg(*[F.struct(F.lit(m).alias("metric"), F.count_if(hit).alias("hits"), F.count_if(of).alias("of")).alias(m) for m, (hit, of) in metrics.items()])
    return counted.select(F.inline(F.array(*metrics))).withColumn("share", F.round(F.col("hits") / F.nullif(F.col("of"), F.lit(0)), 6))


def metric_means(scored: DataFrame, targets: dict[str, float]) -> DataFrame:
    """metric, n, mean, target, reached: mean of each score over the rows that have it, against its target."""
    rows = [F.struct(F.lit(m).alias("metric"), F.count(m).alias("n"), F.round(F.avg(m), 6).alias("mean"), F.lit(float(t)).alias("target")).alias(m) for m, t in targets.items()]
    return scored.agg(*rows).select(F.inline(F.array(*targets))).withColumn("reached", F.coalesce(F.col("mean") >= F.col("target"), F.lit(False)))
