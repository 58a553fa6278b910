"""Most similar vectors for every vector by a hash-prefix forest distributed by prefix.

The hash string of a vector in a tree is made of the turns at the tree's
splits: a node is split by a projection on the difference of two of its own
vectors at the median, so a dense cluster is told apart by further bits like
any other place. The first bits come from splits of a bounded sample and give
the leaf, one task's share; the task goes on splitting what it holds and sorts
its entries by the rest of their strings, into an array of its own per tree.
An entry descends to its place in the array, where the longest common prefixes
are, and ascends: each step takes in twice as many entries on either side, so
at least those of a prefix shorter by one bit, until what lies further out no
longer changes its best candidates, at most the whole leaf. Every row is
indexed. Candidates are found with two-byte components; all that may be among
the best k by these are then compared exactly. ``nearest`` holds the form for
stated queries without a threshold, where the trees ascend together.

Equal vectors are one entry. Of their rows at most ``2k`` are listed as
neighbours, at most k of one document: whatever document a query belongs to, k
of the listed rows belong to others if so many exist.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import key
from ..session import cut, ship, spread
from . import filters

#: document of an entry whose rows are of several documents
SEVERAL = -1


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has dim finite values, not all zero; these vectors as float32."""
    size = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten()
    v = np.asarray(flat.cast(pa.float32()).fill_null(float("nan"))).reshape(-1, dim).astype(np.float32, copy=False)
    ok = np.isfinite(v).all(1) & (v != 0).any(1)
    return rows[ok], v[ok]


def vector_keys(v: np.ndarray) -> np.ndarray:
    """64-bit key of each vector's values."""
    bits = (v + np.float32(0)).view(np.uint32).astype(np.uint64)  # -0 as 0
    h = np.zeros(len(v), np.uint64)
    for j in range(v.shape[1]):
        h = (h ^ bits[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def along(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Projection of each row on the plane of the same place, whatever rows stand beside it."""
    return np.einsum("ij,ij->i", x, planes)


class Forest:
    """The upper splits of all trees, nodes numbered as in a heap; 2^depth leaves a tree."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int, depth: int, seed: int):
        self.trees, self.depth, self.leaves = trees, depth, 1 << depth
        self.planes = np.zeros((trees, self.leaves - 1, dim), np.float32)
        self.at = np.zeros((trees, self.leaves - 1), np.float32)
        rng = np.random.default_rng(seed)
        u = np.unique(sample, axis=0)
        for t in range(trees):
            nodes = [np.arange(len(u))]
            for n in range(self.leaves - 1):
                own = nodes[n]
                if len(own) > 1:
                    p, q = rng.choice(own, 2, replace=False)
                    self.planes[t, n] = u[p] - u[q]
                    x = along(u[own], np.broadcast_to(self.planes[t, n], (len(own), dim)))
                    self.at[t, n] = np.median(x)
                    nodes += [own[x <= self.at[t, n]], own[x > self.at[t, n]]]
                else:
                    nodes += [own, own[:0]]

    def leaf(self, u: np.ndarray, t: int) -> np.ndarray:
        n = np.zeros(len(u), np.int64)
        for _ in range(self.depth):
            n = 2 * n + 1 + (along(u, self.planes[t][n]) > self.at[t][n])
        return n - (self.leaves - 1)


def in_a_row(x: np.ndarray, rng: np.random.Generator, least: int = 32) -> np.ndarray:
    """Order of the vectors after halving them again and again, down to ``least``, along differences of two members."""
    order, bounds = np.arange(len(x)), np.array([0, len(x)])
    while (size := np.diff(bounds)).max(initial=0) > least:
        p, q = (order[bounds[:-1] + (rng.random(len(size)) * size).astype(np.int64)] for _ in range(2))
        node = np.repeat(np.arange(len(size)), size)
        order = order[np.lexsort((along(x[order], (x[p] - x[q])[node]), node))]
        bounds = np.union1d(bounds, (bounds[:-1] + size // 2)[size > least])
    return order


def entry_type(dim: int) -> np.dtype:
    return np.dtype([("key", "<i8"), ("doc", "<i8"), ("v", "<i2", (dim,))])


def entries(u: np.ndarray, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    e = np.zeros(len(u), entry_type(u.shape[1]))
    most = np.abs(u).max(1)
    e["key"], e["doc"], e["v"] = keys, docs, np.rint(u * (32767 / most)[:, None])
    return e


def slack(s: np.ndarray, dim: int) -> np.ndarray:
    """What two-byte components may be off cosines: each vector turns by at most sqrt(dim) / 65534; 4e-6 for single precision."""
    turn = math.sqrt(dim) / 32767
    return turn * np.sqrt(np.maximum(0, 1 - s * s)) + turn * turn + 4e-6


def best(i: np.ndarray, j: np.ndarray, s: np.ndarray, doc: np.ndarray, k: int, dim: int) -> tuple[np.ndarray, ...]:
    """Of the candidates j of entries i with cosines s, all that may be among the k best of a row of the entry; entries with k such and the least cosine that may be.

    A row of an entry of several documents does not count candidates of its own
    document, so there the candidates of any one document do not count.
    """
    o = np.lexsort((-s, i))
    i, j, s = i[o], j[o], s[o]
    if not len(i):
        return i, j, s, i, s
    first = np.concatenate([[True], i[1:] != i[:-1]])
    head = np.flatnonzero(first)
    entry = np.cumsum(first) - 1
    count = np.arange(len(i)) - head[entry] + 1
    at = np.flatnonzero((doc[i] == SEVERAL) & (doc[j] != SEVERAL))
    if len(at):
        same = at[np.lexsort((at, doc[j[at]], i[at]))]
        start = np.concatenate([[True], (i[same][1:] != i[same][:-1]) | (doc[j[same]][1:] != doc[j[same]][:-1])])
        one = np.zeros(len(i), np.int64)
        one[same] = np.arange(len(same)) - np.flatnonzero(start)[np.cumsum(start) - 1] + 1
        count = count - (np.maximum.accumulate(one + entry * (len(i) + 1)) - entry * (len(i) + 1))
    kth = np.flatnonzero(count == k)
    full, at = np.unique(i[kth], return_index=True)
    bar = s[kth[at]]
    bar = bar - slack(bar, dim)
    least = np.full(head.size, -2.0)
    least[entry[kth[at]]] = bar
    keep = s + slack(s, dim) >= least[entry]
    return i[keep], j[keep], s[keep], full, bar


def search_leaf(e: np.ndarray, window: int, least: float, k: int, seed: int = 0, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, key of a candidate): for each entry all that may be among the ``k`` best of its rows, sought around it and further out until they stay the same."""
    e = e[np.argsort(e["key"], kind="stable")]
    start = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
    low, high = np.minimum.reduceat(e["doc"], start), np.maximum.reduceat(e["doc"], start)
    e = e[start]
    doc = np.where(low == high, low, SEVERAL)
    x = unit(e["v"])
    dim = x.shape[1]
    least = least - float(slack(np.float64(least), dim)) - 2 * dim / 32767**2
    row = in_a_row(x, np.random.default_rng(seed))
    e, doc, x = e[row], doc[row], x[row]
    n = len(e)

    def compare(rows: np.ndarray, lo: int, hi: int, inner: tuple[int, int], floor: np.ndarray) -> tuple[np.ndarray, ...]:
        """Candidates of rows among lo to hi; which rows have near entries out of inner, of whatever document."""
        s = x[rows] @ x[lo:hi].T
        own = np.arange(max(lo, rows[0]), min(hi, rows[-1] + 1))
        own = own[np.isin(own, rows)]
        s[np.searchsorted(rows, own), own - lo] = -2
        rim = (s[:, : max(0, inner[0] - lo)].max(1, initial=-2) >= floor) | (s[:, max(0, inner[1] - lo) :].max(1, initial=-2) >= floor)
        s[(doc[rows, None] == doc[None, lo:hi]) & (doc[rows, None] != SEVERAL)] = -2
        many = np.flatnonzero(((s >= floor[:, None]).sum(1) > k) & (doc[rows] != SEVERAL))
        if len(many):
            bar = np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            floor = floor.copy()
            floor[many] = np.maximum(floor[many], bar - 2 * slack(bar, dim) - 2 * dim / 32767**2)
        i, j = np.nonzero(s >= floor[:, None])
        return rows[i], j + lo, s[i, j], rows[rim]

    for a in range(0, n, block):
        rows, w = np.arange(a, min(a + block, n)), window
        lo, hi, inner = max(0, a - w), min(n, a + block + w), (max(0, a - w // 2), min(n, a + block + w // 2))
        i, j, s, rim = compare(rows, lo, hi, inner, np.full(len(rows), least, np.float32))
        while True:
            i, j, s, full, bar = best(i, j, s, doc, k, dim)
            # what stands at the rim may only be of the entry's own document: then others may stand behind it
            rows = np.union1d(i[(j < inner[0]) | (j >= inner[1])], np.setdiff1d(rim, full))
            if not len(rows) or (lo, hi) == (0, n):
                break
            floor = np.full(block, least, np.float32)
            floor[full - a] = np.maximum(least, bar - slack(bar, dim) - 2 * dim / 32767**2)
            inner, w = (lo, hi), 2 * w
            lo, hi = max(0, a - w), min(n, a + block + w)
            more = [compare(rows, *r, (r[1], r[1]), floor[rows - a]) for r in ((lo, inner[0]), (inner[1], hi)) if r[0] < r[1]]
            i, j, s = (np.concatenate([z, *(m[k] for m in more)]) for k, z in enumerate((i, j, s)))
            rim = np.concatenate([m[3] for m in more])
        if len(i):
            yield e["key"][i], e["key"][j]


def similar_vectors(vectors: DataFrame, id_col: str = "id", doc_col: str = "doc_id", vector_col: str = "embedding", k: int = 10, least: float | None = None, dim: int = 64, trees: int = 12, bits: int = 40, window: int = 128, leaf_rows: int = 16_384, sample: int = 20_000, seed: int = 11) -> DataFrame:
    """id, neighbour, cosine, nth: for each row its (up to) k most similar rows of other documents, of cosine at least ``least``.

    Without ``least`` every row is a query of ``nearest_vectors``, however far
    its neighbours; that costs rows times rows where these are far. Ties go to the smaller id. Rows whose vector is null, of another length,
    not finite or all zero are left out, as are null ids; a null or empty
    document is a document of its own. A row delivered twice counts once; equal
    vectors are neighbours like any other; extra columns are ignored; an empty
    table gives no rows. Approximate: a neighbour is missed if in no tree it
    stands in the same leaf, or if the search ends before it: that begins with
    ``window`` entries on either side and ends when the outer half holds none
    of the best. ``sample`` bounds the rows from which the upper splits are
    taken, ``bits`` their depth.
    """
    if least is None:
        from .nearest import nearest_vectors

        return nearest_vectors(vectors, None, id_col, doc_col, vector_col, k, dim, trees, seed=seed)
    spark = vectors.sparkSession
    ship(spark)
    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(key(F.col(doc_col)), F.lit(""))).alias("doc"), F.col(vector_col).alias("v")).where(f"id is not null and v is not null and size(v) = {int(dim)}")
    count = vectors.count()
    share = min(1.0, sample / max(1, count))
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    names = ["id", "doc", "key", "v"]
    none = lambda n, t: pa.nulls(n, t)
    floats = pa.list_(pa.float32())

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            rows, v = usable(batch.column("v"), dim)
            if not len(rows):
                continue
            u, at = unit(v), pa.array(rows)
            n += len(u)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("doc").take(at), pa.array(vector_keys(v)), none(len(rows), floats)], names)
            chosen = np.flatnonzero(np.asarray(batch.column("pick").take(at)))
            yield pa.RecordBatch.from_arrays([none(len(chosen), pa.int64()), pa.array(np.ones(len(chosen), np.int64)), none(len(chosen), pa.int64()), pa.array(list(u[chosen]), floats)], names)
        if n:
            yield pa.RecordBatch.from_arrays([none(1, pa.int64()), pa.array([0]), pa.array([n]), none(1, floats)], names)

    surveyed = cut(src.withColumn("pick", pick).mapInArrow(survey, "id bigint, doc bigint, key bigint, v array<float>"), "vectors")
    members = surveyed.where("id is not null").select("id", "doc", "key").dropDuplicates(["id"])
    n = surveyed.where("id is null and doc = 0").agg(F.sum("key").alias("n")).first().n or 0
    taken = surveyed.where("id is null and doc = 1").select("v").toArrow().column(0).combine_chunks()  # bounded by sample
    taken = np.asarray(taken.flatten(), np.float32).reshape(-1, dim)
    depth = min(bits, math.ceil(math.log2(max(1, n / leaf_rows))), max(1, len(taken)).bit_length() - 1)
    leaves = 1 << depth
    held = spark.sparkContext.broadcast(Forest(taken, dim, trees, depth, seed))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            rows, v = usable(batch.column("v"), dim)
            if not len(rows):
                continue
            keys, docs = vector_keys(v), np.asarray(batch.column("doc").take(pa.array(rows)))
            pair, first = np.unique(np.stack([keys, docs], 1), axis=0, return_index=True)  # copies cost one entry a batch and document
            u = unit(v[first])
            e = entries(u, keys[first], docs[first])
            parts, blobs = [], []
            for t in range(forest.trees):
                leaf = forest.leaf(u, t)
                order = np.argsort(leaf, kind="stable")
                ends = np.searchsorted(leaf[order], np.arange(leaves), side="right")
                a = 0
                for x, b in enumerate(ends.tolist()):
                    if b > a:
                        parts.append(t * leaves + x)
                        blobs.append(e[order[a:b]].tobytes())
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "entries"])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
                by.setdefault(p, []).append(blob)
        for p in list(by):
            found = [np.stack([np.minimum(a, b), np.maximum(a, b)]) for a, b in search_leaf(np.frombuffer(b"".join(by.pop(p)), entry_type(dim)), window, least, k, p)]
            a, b = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves * 2)
    planted = spread(src).mapInArrow(plant, "part int, entries binary").repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    near = cut(planted.mapInArrow(climb, "a bigint, b bigint").distinct(), "near")

    # exact cosines of what the trees brought up
    sought = cut(near.select(F.col("a").alias("key")).union(near.select("b")).distinct(), "sought")
    bits_n, wanted = filters.build(sought, F.col("key"))
    look = spark.sparkContext.broadcast(wanted)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, v = usable(batch.column("v"), dim)
            keys = vector_keys(v)
            at = np.flatnonzero(filters.held(look.value, keys % (1 << bits_n)))
            _, first = np.unique(keys[at], return_index=True)
            at = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(list(v[at].astype(np.float64) / np.abs(v[at]).max(1, keepdims=True)), pa.list_(pa.float64()))], ["key", "v"])

    exact = src.mapInArrow(fetch, "key bigint, v array<double>").join(sought, "key").dropDuplicates(["key"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    exact = cut(exact.select("key", "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm")), "exact")
    side = lambda p: exact.select(*[F.col(c).alias(f"{p}_{c}") for c in exact.columns])
    cosine = dot(F.col("a_v"), F.col("b_v")) / (F.col("a_norm") * F.col("b_norm"))
    scored = near.join(side("a"), F.col("a") == F.col("a_key")).join(side("b"), F.col("b") == F.col("b_key")).select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= least)

    # rows: those listed for each vector, then each row's own ranking
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    listed = members.withColumn("nth", rank("key", "doc")).where(F.col("nth") <= k).withColumn("nth", rank("key")).where(F.col("nth") <= 2 * k)
    listed = listed.select(F.col("key").alias("b"), F.col("id").alias("neighbour"), F.col("doc").alias("their_doc"))
    copies = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("cosine"))
    arcs = cut(scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")).unionByName(copies), "arcs")
    found = arcs.join(members.withColumnRenamed("key", "a"), "a").join(listed, "b").where("doc <> their_doc and id <> neighbour")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return found.select("id", "neighbour", "cosine").withColumn("nth", nth).where(F.col("nth") <= k)
