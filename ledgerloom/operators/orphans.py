"""References to records that do not exist.

References of any number of child tables and keys of their parents are brought
together in one co-partitioned, sorted merge join. Both sides are reduced
before they move: a parent to the interval of its validity (from its first row
to the last deletion if every row is deleted, else open), a child to the span
of references per key and period, so a hot key costs one row per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import key


@dataclass(frozen=True)
class Reference:
    """child.ref names parent.key; the times order both, deleted may be None."""

    name: str
    child: DataFrame
    ref: str
    at: str
    parent: DataFrame
    key: str
    since: str
    deleted: str | None = None


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def orphan_references(references: list[Reference]) -> DataFrame:
    """child_table, ref_key, period, state, n_refs, first_ref, last_ref, valid_from, valid_until: orphan keys per table and month.

    state is 'missing' (no parent row), 'deleted' (every parent row deleted, so
    the validity has ended) or 'late' (the validity begins after the child row). Null and empty
    references are no cases; rows without a time have a null period and cannot
    be late; a parent without any time is never late. Repeated rows give the
    same result as one, but n_refs counts rows. Empty tables give no rows.
    """
    children = _union(
        [
            r.child.select(F.lit(r.name).alias("child_table"), key(F.col(r.ref)).alias("ref_key"), F.date_format(F.col(r.at), "yyyy-MM").alias("period"), F.col(r.at).cast("timestamp_ntz").alias("at"))
            .where("ref_key is not null")
            .groupBy("child_table", "ref_key", "period")
            .agg(F.min("at").alias("first_ref"), F.max("at").alias("last_ref"), F.count("*").alias("n_refs"))
            for r in references
        ]
    )
    parents = _union(
        [
            r.parent.select(F.lit(r.name).alias("child_table"), key(F.col(r.key)).alias("ref_key"), F.col(r.since).cast("timestamp_ntz").alias("since"), (F.col(r.deleted).cast("timestamp_ntz") if r.deleted else F.lit(None).cast("timestamp_ntz")).alias("until"))
            .where("ref_key is not null")
            .groupBy("child_table", "ref_key")
            .agg(F.lit(True).alias("known"), F.min("since").alias("valid_from"), F.when(F.count("until") == F.count("*"), F.max("until")).alias("valid_until"))
            for r in references
        ]
    )
    joined = children.join(parents.hint("merge"), ["child_table", "ref_key"], "left")
    state = F.when(F.col("known").isNull(), "missing").when(F.col("valid_until").isNotNull(), "deleted").when(F.col("valid_from") > F.col("first_ref"), "late")
    return joined.withColumn("state", state).where("state is not null").select("child_table", "ref_key", "period", "state", "n_refs", "first_ref", "last_ref", "valid_from", "valid_until")
