"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: list[str], max_hot: int = 256) -> list[tuple[tuple, float]]:
    """(key, share of the rows) of keys that hold more than 1/max_hot of them: fewer than max_hot by arithmetic.

    One pass over all rows with partial aggregation; at most max_hot rows reach the driver.
    """
    seen = Observation()
    counts = df.observe(seen, F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count("*").alias("__n"))
    top = counts.orderBy(F.desc("__n")).limit(max_hot).collect()
    if not top:
        return []
    total = seen.get["n"]
    return [(tuple(r)[: len(keys)], r["__n"] / total) for r in top if r["__n"] * max_hot > total]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", max_hot: int = 256) -> DataFrame:
    """left ⋈ right on one string key whose hot values are salted.

    left rows of a hot key spread by the hash of ``spread`` over as many parts
    as their share of all shuffle partitions, at least two, so that no part is
    larger than an ordinary partition; right rows of hot keys are repeated once
    per part, all others stay single. Null keys never match. The hot keys are
    fewer than max_hot.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = {k[0]: max(2, round(share * parts)) for k, share in hot_keys(left.where(F.col(key).isNotNull()), [key], max_hot)}
    one = F.lit(1)
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col(key)), one) if hot else one
    a = left.withColumn("__salt", F.pmod(F.hash(spread), salts))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return a.join(b, [key, "__salt"], how).drop("__salt")
