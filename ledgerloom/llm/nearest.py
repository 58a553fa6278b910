"""The most similar vectors of stated queries at any distance, by a hash-prefix forest.

A vector has a hash string of BITS bits in each tree: on which side of BITS
planes it lies. Every task sorts the strings of the rows it holds, one array a
tree. A query descends to the longest prefix that it shares with an entry, and
then all trees ascend together, one bit at a time: on each step the entries
under the sibling node join the candidates, in whatever tree they turn up. How
far a query ascends depends on what it holds: it stops where, by the pairs of
a sample, an entry as similar as its k-th best candidate is yet unseen with at
most a given probability, and in hard cases at the root, where nothing is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import key
from ..session import cut, ship
from .similar import unit, usable, vector_keys

BITS = 32
#: steps of the cosine in which the probability of missing an entry is told apart
STEPS = 40


class Planes:
    """The planes of all trees, and how likely a vector of a given cosine is unseen at each prefix length."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int, seed: int, probes: int = 300):
        rng = np.random.default_rng(seed)
        u = np.unique(sample, axis=0)
        if len(u) > 1:
            p, q = rng.integers(0, len(u), (2, trees * BITS))
            q = np.where(p == q, (q + 1) % len(u), q)
            self.planes = u[p] - u[q]
        else:
            self.planes = rng.standard_normal((trees * BITS, dim)).astype(np.float32)
        self.at = np.median(u @ self.planes.T, axis=0) if len(u) else np.zeros(trees * BITS, np.float32)
        self.trees = trees
        self.miss = np.ones((BITS + 1, STEPS))
        self.miss[0] = 0
        if len(u) > 1:
            own = self.strings(u)
            some = rng.permutation(len(u))[:probes]
            seen = np.zeros((STEPS, BITS + 1))
            for i in some:
                lcp = common_prefix(own, own[:, i, None]).max(0)
                s = u @ u[i]
                s[i] = np.nan
                real = np.isfinite(s)
                np.add.at(seen, (step_of(s[real]), lcp[real]), 1)
            n = seen.sum(1)
            for step in range(STEPS):
                # where there are few pairs, those of the next lower cosines count, which share less
                k = step
                got = seen[step].copy()
                while got.sum() < 50 and k:
                    k -= 1
                    got += seen[k]
                if n[: step + 1].sum():
                    self.miss[:, step] = np.concatenate([[0], np.cumsum(got)[:-1]]) / max(1, got.sum())

    def strings(self, u: np.ndarray) -> np.ndarray:
        """Hash strings, one row a tree; the first bit is the highest."""
        out = np.zeros((self.trees, len(u)), np.uint32)
        for a in range(0, len(u), 16_384):
            side = (u[a : a + 16_384] @ self.planes.T) > self.at
            packed = np.packbits(side.reshape(len(side), self.trees, BITS), axis=2)
            out[:, a : a + 16_384] = packed.view(">u4")[:, :, 0].T
        return out


def step_of(cosine: np.ndarray) -> np.ndarray:
    return np.clip(((cosine + 1) * (STEPS / 2)).astype(np.int64), 0, STEPS - 1)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that two strings have in common from the start."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def listed(ids: np.ndarray, docs: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be neighbours: each id once, of equal vectors 2k, k of one document, the smallest ids."""
    order = np.lexsort((ids, docs, keys))
    order = order[np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])])] if len(order) else order

    def nth(*columns: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
        start = np.flatnonzero(new)
        return np.arange(len(new)) - start[np.cumsum(new) - 1]

    if len(order):
        order = order[nth(keys[order], docs[order]) < k]
        order = order[np.lexsort((ids[order], keys[order]))]
        order = order[nth(keys[order]) < 2 * k]
        _, first = np.unique(ids[order], return_index=True)
        order = order[first]
    return order


class Queries:
    """Queries of a block: ids, documents, vectors, hash strings and what their k-th best is at least."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, v: np.ndarray, planes: Planes, known: tuple[np.ndarray, np.ndarray], k: int):
        self.ids, self.docs, self.v, self.u = ids, docs, v.astype(np.float64), unit(v)
        self.strings = planes.strings(self.u)
        self.bar = np.full(len(ids), -2, np.float32)
        u, d = known
        if len(u) > k:
            for a in range(0, len(ids), 4096):
                s = self.u[a : a + 4096] @ u.T
                s[self.docs[a : a + 4096, None] == d[None]] = -2
                self.bar[a : a + 4096] = np.partition(s, -k, axis=1)[:, -k]
            self.bar -= np.float32(1e-5)


def search_shard(planes: Planes, q: Queries, ids: np.ndarray, docs: np.ndarray, u: np.ndarray, k: int, loss: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, row) of candidates that may be among the k best of the shard, and how many pairs were compared."""
    strings = planes.strings(u)
    order = np.argsort(strings, axis=1)
    arrays = np.take_along_axis(strings, order, axis=1)
    bar = q.bar.copy()
    none = np.zeros(0, np.int64)
    qi, ri, si = none, none, np.zeros(0, np.float32)
    active = np.arange(len(q.ids))
    top = min(BITS, max(1, len(u).bit_length()))
    compared = 0
    for x in range(top, -1, -1):
        found = []
        for t in range(planes.trees):
            # the node of the longest prefixes first, then the sibling of each node on the way up
            level = top if x == top else x + 1
            node = q.strings[t, active] >> np.uint32(BITS - level)
            if x < top:
                node = node ^ np.uint32(1)
            by = np.argsort(node, kind="stable")
            names, first, count = np.unique(node[by], return_index=True, return_counts=True)
            prefix = arrays[t] >> np.uint32(BITS - level)
            lo, hi = np.searchsorted(prefix, names, "left"), np.searchsorted(prefix, names, "right")
            full = np.flatnonzero(hi > lo)
            small = full[(count[full] * (hi - lo)[full]) < 2048]
            for g in full[(count[full] * (hi - lo)[full]) >= 2048].tolist():
                who, rows = active[by[first[g] : first[g] + count[g]]], order[t, lo[g] : hi[g]]
                for a in range(0, len(rows), 8192):
                    part = rows[a : a + 8192]
                    s = q.u[who] @ u[part].T
                    compared += s.size
                    i, j = np.nonzero(s >= bar[who, None])
                    found.append((who[i], part[j], s[i, j]))
            if len(small):
                n = hi[small] - lo[small]
                entry = np.repeat(small, count[small] * n)
                at = np.arange(len(entry)) - np.repeat(np.cumsum(count[small] * n) - count[small] * n, count[small] * n)
                wide = hi[entry] - lo[entry]
                who, row = active[by[first[entry] + at // wide]], order[t, lo[entry] + at % wide]
                for a in range(0, len(who), 500_000):
                    i, j = who[a : a + 500_000], row[a : a + 500_000]
                    s = np.einsum("ij,ij->i", q.u[i], u[j])
                    ok = s >= bar[i]
                    found.append((i[ok], j[ok], s[ok]))
                compared += len(who)
        if found:
            i, j, s = (np.concatenate(c) for c in zip(*found))
            other = q.docs[i] != docs[j]
            qi, ri, si = np.concatenate([qi, i[other]]), np.concatenate([ri, j[other]]), np.concatenate([si, s[other]])
            _, once = np.unique(qi * len(u) + ri, return_index=True)  # met in several trees
            qi, ri, si = qi[once], ri[once], si[once]
            o = np.lexsort((-si, qi))
            qi, ri, si = qi[o], ri[o], si[o]
            head = np.searchsorted(qi, qi, "left")
            kth = np.flatnonzero(np.arange(len(qi)) - head == k - 1)
            bar[qi[kth]] = np.maximum(bar[qi[kth]], si[kth] - np.float32(1e-5))
            keep = si >= bar[qi]
            qi, ri, si = qi[keep], ri[keep], si[keep]
        active = active[planes.miss[x, step_of(bar[active])] > loss] if x else active[:0]
        if not len(active):
            break
    return qi, ri, compared


def nearest_vectors(vectors: DataFrame, queries: Column | None = None, id_col: str = "id", doc_col: str = "doc_id", vector_col: str = "embedding", k: int = 10, dim: int = 64, trees: int = 12, loss: float = 0.05, sample: int = 4096, shard_rows: int = 65_536, block: int = 65_536, seed: int = 11) -> DataFrame:
    """id, neighbour, cosine, nth: for each query row its (up to) k most similar rows of other documents, however far.

    queries says which rows ask (all if None); every usable row is indexed.
    Each block of queries (about ``block`` by the hash of the id) is a pass over
    all rows, so the cost grows with queries times rows; the forest saves what
    the data allow. Ties go to the smaller id. Rows whose vector is null, of
    another length, not finite or all zero are left out, as are null ids; a
    null or empty document is a document of its own. A row delivered twice
    counts once; extra columns are ignored; an empty table gives no rows.
    Approximate: ``loss`` is the probability at which a query gives up an entry
    as similar as its k-th best; planes and probabilities are from ``sample``
    rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(key(F.col(doc_col)), F.lit(""))).alias("doc"), F.col(vector_col).alias("v"), asks.alias("asks")).where(f"id is not null and v is not null and size(v) = {int(dim)}")
    rows_n, asked_n = src.agg(F.count("*"), F.count_if("asks")).first()
    if not asked_n:
        return spark.createDataFrame([], "id bigint, neighbour bigint, cosine double, nth int")

    def gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = df.select("id", "doc", "v").toArrow()
        batch = got.combine_chunks().to_batches()[0] if got.num_rows else pa.RecordBatch.from_pylist([], schema=got.schema)
        rows, v = usable(batch.column("v"), dim)
        ids, docs = np.asarray(batch.column("id"))[rows], np.asarray(batch.column("doc"))[rows]
        _, once = np.unique(ids, return_index=True)
        return ids[once], docs[once], v[once]

    share = min(1.0, sample / rows_n)
    picked = src.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    _, s_docs, s_v = gathered(picked if share < 1 else src)  # about ``sample`` rows
    s_u = unit(s_v)
    planes = Planes(s_u, dim, trees, seed)
    _, alone = np.unique(vector_keys(s_v), return_index=True)
    n_blocks = math.ceil(asked_n / block)

    def pass_over(n: int) -> DataFrame:
        mine = src.where("asks") if n_blocks == 1 else src.where("asks").where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == n)
        held = spark.sparkContext.broadcast((planes, Queries(*gathered(mine), planes, (s_u[alone], s_docs[alone]), k)))  # about ``block`` rows

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, q = held.value
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def shard() -> Iterator[pa.RecordBatch]:
                ids, docs, v = (np.concatenate(c) for c in zip(*kept))
                at = listed(ids, docs, vector_keys(v), k)
                ids, docs, v = ids[at], docs[at], v[at]
                u = unit(v)
                qi, ri, _ = search_shard(forest, q, ids, docs, u, k, loss)
                for a in range(0, len(qi), 200_000):
                    i, j = qi[a : a + 200_000], ri[a : a + 200_000]
                    x, y = q.v[i], v[j].astype(np.float64)
                    c = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(ids[j]), pa.array(c)], ["id", "neighbour", "cosine"])

            held_rows = 0
            for batch in batches:
                rows, v = usable(batch.column("v"), dim)
                if not len(rows):
                    continue
                kept.append((np.asarray(batch.column("id"))[rows], np.asarray(batch.column("doc"))[rows], v))
                held_rows += len(rows)
                if held_rows >= shard_rows:
                    yield from shard()
                    kept.clear()
                    held_rows = 0
            if kept:
                yield from shard()

        return src.select("id", "doc", "v").mapInArrow(search, "id bigint, neighbour bigint, cosine double")

    found = pass_over(0)
    for n in range(1, n_blocks):
        found = found.unionByName(pass_over(n))
    # the best of each shard come together by query; a row that two shards hold counts once
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    once = found.repartition("id").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    return cut(once.withColumn("nth", nth).where(F.col("nth") <= k), "nearest")
