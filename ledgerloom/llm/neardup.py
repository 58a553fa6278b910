"""Near-duplicate records by a token-group matrix.

Records are sets of word shingles. Similar records are partitioned into groups
(by the least token under a second hash); of each group the union of its
members' tokens is kept, as a matrix distributed by token. A record queries the
matrix with its own tokens; groups whose bound reaches what is needed are
opened, their members bounded one by one and what is left compared exactly.

Only as much of the matrix is kept as exactness needs: in any common order of
the tokens, two sets that share a tokens have at least a tokens from the first
shared one on, each. So of a set only the rarest tokens are asked for, and still
fewer of the smaller set of a pair are in the matrix; the place of a token bounds
the sizes of the sets that it can lead to. The order is by a frequency sketch
over all records, so common phrases stay out, and it must tell the tokens of one
record from those of some hundred: the pairs that common tokens make grow with
the square of the table. Pairs that are left are bounded by parity bitmaps (two
sets whose bitmaps differ in d bits have at least d tokens not in common).
Records of the same token set are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, spread
from . import filters

#: bits of a token; more than enough to tell the tokens of two records apart
TOKEN_BITS = 40
SKETCH_BITS = 22
#: places of the sketch that travel together
_CHUNK = 1 << 14
#: bits of the parity bitmap of a token set of up to FIT tokens; twice as many for twice the size
PARITY = 256
FIT = 144
#: records and characters that are worked on together
BLOCK, BLOCK_CHARS = 4096, 1_500_000

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, modulo 2^64, at least n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


@cache
def _in_word() -> np.ndarray:
    """Of every code point whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """Another uniform 64-bit hash of hashes, by number."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_STEP + 2 * k)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Sets:
    """Token sets of some records: which records, the end of each set in ``tokens``, sorted within a set."""

    rows: np.ndarray
    ends: np.ndarray
    tokens: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), self.sizes)

    def take(self, keep: np.ndarray) -> Sets:
        sizes, starts = self.sizes[keep], self.starts[keep]
        return Sets(self.rows[keep], np.cumsum(sizes), self.tokens[np.repeat(starts, sizes) + _within(sizes)])


def token_sets(texts: list[str | None], size: int, least_words: int) -> Sets:
    """Distinct runs of ``size`` words of the texts that have at least least_words (and size) words.

    Words are runs of letters and digits in lower case, hashed all together:
    the characters of a word times powers of a step, moved to the word's start.
    """
    joined = "\0".join((t or "").replace("\0", " ") for t in texts).lower()
    data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = ~_in_word()[data]
    up, down = _powers(len(data) + 1)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(data) else np.zeros(0, np.int64)
    none = Sets(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if not len(starts):
        return none
    value = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    value[gap] = 0
    word = np.add.reduceat(value, starts) * down[starts]
    word = mix(word, 4)
    owner = np.searchsorted(np.flatnonzero(data == 0), starts)
    counts = np.bincount(owner, minlength=len(texts))
    m = len(word) - size + 1
    if m <= 0:
        return none
    x = word[:m]
    for k in range(1, size):
        x = x * np.uint64(0xD6E8FEB86659FD93) + word[k : m + k]
    inside = (owner[:m] == owner[size - 1 :]) & (counts[owner[:m]] >= max(least_words, size))
    x = mix(x[inside], 0) >> np.uint64(64 - TOKEN_BITS)
    keyed = np.sort((owner[:m][inside].astype(np.uint64) << np.uint64(TOKEN_BITS)) | x)
    if not len(keyed):
        return none
    keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    rows, n = np.unique(keyed >> np.uint64(TOKEN_BITS), return_counts=True)
    return Sets(rows.astype(np.int64), np.cumsum(n), keyed & np.uint64((1 << TOKEN_BITS) - 1))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in runs of bounded number and length, with the place of each run."""
    a = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if i - a == BLOCK or (chars > BLOCK_CHARS and i > a):
            yield a, texts[a:i]
            a, chars = i, len(t or "")
    if a < len(texts):
        yield a, texts[a:]


def needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens that a set of n must share with a set at least that similar."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def signatures(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that name each token set."""
    a = np.add.reduceat(mix(s.tokens, 1), s.starts) ^ s.sizes.astype(np.uint64)
    return a.astype(np.int64), np.bitwise_xor.reduceat(mix(s.tokens, 2), s.starts).astype(np.int64)


def sketch_place(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(TOKEN_BITS - SKETCH_BITS)).astype(np.int64)


def rarity(sketch: np.ndarray) -> np.ndarray:
    """Rank of each place of the sketch among 4,096 steps of frequency, on a logarithmic scale."""
    return np.minimum(4095, np.log1p(sketch) * 128).astype(np.uint16)


def prefixes(s: Sets, rare: np.ndarray, threshold: float) -> tuple[Sets, np.ndarray]:
    """Of each set (at most BLOCK) the rarest tokens, among which the first stands that it shares with a similar set; the place of each."""
    w = rare[sketch_place(s.tokens)].astype(np.uint64)
    keyed = np.sort((s.owner.astype(np.uint64) << np.uint64(52)) | (w << np.uint64(TOKEN_BITS)) | s.tokens)
    length = s.sizes - needed(s.sizes, threshold) + 1
    place = _within(length)
    return Sets(s.rows, np.cumsum(length), keyed[np.repeat(s.starts, length) + place] & np.uint64((1 << TOKEN_BITS) - 1)), place


def level_of(n: np.ndarray) -> np.ndarray:
    """Doublings of the bitmap that a set of n tokens has."""
    return np.ceil(np.log2(np.maximum(n, FIT) / FIT)).astype(np.int64)


def parity(s: Sets, bits: int) -> np.ndarray:
    """Parity bitmap of each set over ``bits`` bits, as rows of 64-bit words."""
    at = s.owner * bits + (mix(s.tokens, 5) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(s.ends) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(s.ends), bits), axis=1, bitorder="little").view(np.uint64)


def bitmaps(s: Sets) -> list[bytes]:
    """Parity bitmap of each set, by its size."""
    level = level_of(s.sizes)
    got: list[bytes] = [b""] * len(level)
    for x in np.unique(level):
        rows = np.flatnonzero(level == x)
        for i, bits in zip(rows.tolist(), parity(s.take(rows), PARITY << int(x))):
            got[i] = bits.tobytes()
    return got


def overlap(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens that sets of n and of m share at least if they are similar."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def reach(n: np.ndarray, m: np.ndarray, x: pa.Array, y: pa.Array, threshold: float) -> np.ndarray:
    """Which pairs of sets of n and m tokens may reach the threshold by their bitmaps x and y."""
    apart = np.zeros(len(n), np.int64)
    level, other = level_of(n), level_of(m)
    for a, b in set(zip(level.tolist(), other.tolist())):
        at = np.flatnonzero((level == a) & (other == b))
        both = []
        for column, k in ((x, a), (y, b)):
            words = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
            for _ in range(k - min(a, b)):  # the bitmap of half the size
                words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
            both.append(words)
        apart[at] = np.bitwise_count(both[0] ^ both[1]).sum(1, dtype=np.int64)
    return n + m - apart >= 2 * overlap(n, m, threshold)


HEAD = np.dtype([("sig", "<i8"), ("group", "<u4"), ("n", "<u4")])
CELL = np.dtype([("token", "<u4"), ("row", "<u2"), ("place", "<u2")])


def matrix_parts(s: Sets, sigs: np.ndarray, rare: np.ndarray, threshold: float, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, heads, cells) of the matrix for at most BLOCK records, each with one head per part in which it has cells."""
    chosen, place = prefixes(s, rare, threshold)
    head = np.zeros(len(sigs), HEAD)
    head["sig"], head["n"] = sigs, s.sizes
    head["group"] = np.minimum.reduceat(mix(chosen.tokens, 3), chosen.starts) >> np.uint64(32)
    part = (mix(chosen.tokens, 6) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part * len(sigs) + chosen.owner, kind="stable")
    token, row, part = chosen.tokens[order], chosen.owner[order], part[order]
    place = np.minimum(place[order], 65535)  # further back counts as there, which rules out less
    ends = np.searchsorted(part, np.arange(parts), side="right")
    a = 0
    for p, b in enumerate(ends.tolist()):
        if b > a:
            new = np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]])
            cells = np.zeros(b - a, CELL)
            cells["token"], cells["row"], cells["place"] = token[a:b] & np.uint64(0xFFFFFFFF), np.cumsum(new) - 1, place[a:b]
            yield p, head[row[a:b][new]].tobytes(), cells.tobytes()
        a = b


def open_groups(heads: list[bytes], cells: list[bytes], threshold: float, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(class, class) of one part of the matrix: pairs that no bound by sizes and places of tokens rules out.

    The larger set of a pair asks, the smaller one is in the matrix with the
    tokens that can be the first shared with a set no smaller.
    """
    head = np.frombuffer(b"".join(heads), HEAD)
    cell = np.frombuffer(b"".join(cells), CELL)
    key = np.sort((cell["token"].astype(np.uint64) << np.uint64(32)) | np.arange(len(cell), dtype=np.uint64))
    token, at = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = token[1:] == token[:-1]
    met = np.append(same, False) | np.append(False, same)  # a token of one record leads nowhere
    token, at = token[met], at[met]
    if not len(at):
        return
    sizes = np.array([len(h) // HEAD.itemsize for h in heads])
    row = cell["row"][at] + np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), [len(c) // CELL.itemsize for c in cells])[at]
    sig, first, of = np.unique(head["sig"][row], return_index=True, return_inverse=True)  # a class may come from several batches
    n_of, (names, group_of) = head["n"][row[first]].astype(np.int64), np.unique(head["group"][row[first]], return_inverse=True)
    number = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1
    once, i = np.unique(number * len(sig) + of, return_index=True)
    number, who = once // len(sig), once % len(sig)
    n = n_of[who]
    rest = n - cell["place"][at[i]]
    kept = np.flatnonzero(rest >= overlap(n, n, threshold))
    if not len(kept):
        return
    # the matrix: the groups of each token, with the least and largest size and the longest rest of their members
    kept = kept[np.argsort(number[kept] * len(names) + group_of[who[kept]], kind="stable")]
    line = number[kept] * len(names) + group_of[who[kept]]
    start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    m_token, m_group = line[start] // len(names), line[start] % len(names)
    least, largest, longest = np.minimum.reduceat(n[kept], start), np.maximum.reduceat(n[kept], start), np.maximum.reduceat(rest[kept], start)
    member, i = np.unique(who[kept], return_index=True)
    best = np.maximum.reduceat(rest[kept][np.argsort(who[kept], kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(who[kept])[member])[:-1]]))
    by_group = np.argsort(group_of[member], kind="stable")
    member, best = member[by_group], best[by_group]
    members_of = np.bincount(group_of[member], minlength=len(names))
    group_start = np.cumsum(members_of) - members_of
    # the queries, in runs by record
    lines = np.searchsorted(m_token, np.arange(number[-1] + 2))
    asking = np.argsort(who, kind="stable")
    asking = asking[np.diff(lines)[number[asking]] > 0]
    if not len(asking):
        return
    width = np.diff(lines)[number[asking]]
    last = np.flatnonzero(np.append(who[asking][1:] != who[asking][:-1], True)) + 1
    for a, b in _runs(np.add.reduceat(width, np.concatenate([[0], last[:-1]])), block):
        q = asking[last[a - 1] if a else 0 : last[b - 1]]
        w = np.diff(lines)[number[q]]
        g, q = np.repeat(lines[number[q]], w) + _within(w), np.repeat(q, w)
        small = np.maximum(least[g], needed(n[q], threshold))
        need = overlap(n[q], small, threshold)
        ok = (least[g] <= n[q]) & (largest[g] >= small) & (rest[q] >= need) & (longest[g] >= need)
        q, g = q[ok], g[ok]
        if not len(q):
            continue
        asked = who[q] * len(names) + m_group[g]
        order = np.argsort(asked, kind="stable")
        asked, q, g = asked[order], q[order], g[order]
        new = np.flatnonzero(np.append(True, asked[1:] != asked[:-1]))
        x, g, mine, theirs = asked[new] // len(names), asked[new] % len(names), np.maximum.reduceat(rest[q], new), np.maximum.reduceat(longest[g], new)
        for c, d in _runs(members_of[g], block):
            k = members_of[g[c:d]]
            at_member = np.repeat(group_start[g[c:d]], k) + _within(k)
            u, v = np.repeat(x[c:d], k), member[at_member]
            need = overlap(n_of[u], n_of[v], threshold)
            smaller = (n_of[v] < n_of[u]) | ((n_of[v] == n_of[u]) & (v < u))
            ok = smaller & (n_of[v] >= need) & (np.repeat(mine[c:d], k) >= need) & (np.minimum(np.repeat(theirs[c:d], k), best[at_member]) >= need)
            if ok.any():
                yield np.minimum(sig[u[ok]], sig[v[ok]]), np.maximum(sig[u[ok]], sig[v[ok]])


def _runs(widths: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most a block in width, or of one item."""
    ends = np.cumsum(widths)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + block, side="right")))
        yield a, b
        a = b


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def near_duplicates(records: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, size: int = 5, least_words: int = 20, part_mb: int = 48) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes of equal token sets with their records, links between similar classes.

    classes: id, class_a, class_b, n_tokens - one row per record of at least
    least_words words (and one shingle); (class_a, class_b) names the class.
    links: a_class_a, a_class_b, b_class_a, b_class_b, similarity - every pair
    of different classes whose Jaccard similarity reaches the threshold, once.
    No pair is lost: all bounds are exact. Records delivered twice come out
    once; null, empty and short texts and null ids are left out; extra columns
    are ignored; an empty table gives empty results.
    """
    spark = records.sparkSession
    ship(spark)
    src = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    id_type = src.schema["id"].dataType.simpleString()
    pa_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    names = ["id", "class_a", "class_b", "n_tokens", "bits"]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for at, texts in blocks(batch.column("text").to_pylist()):
                s = token_sets(texts, size, least_words)
                if len(s.ends):
                    np.add.at(sketch, sketch_place(s.tokens), np.int32(1))
                    a, b = signatures(s)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at + s.rows)), pa.array(a), pa.array(b), pa.array(s.sizes), pa.array(bitmaps(s), pa.binary())], names)
        full = [c for c in range(len(sketch) // _CHUNK) if sketch[c * _CHUNK : (c + 1) * _CHUNK].any()]
        if full:
            packed = [pa.compress(sketch[c * _CHUNK : (c + 1) * _CHUNK].tobytes(), codec="zstd", asbytes=True) for c in full]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa_id), pa.array(full, pa.int64()), *(pa.nulls(len(full), pa.int64()) for _ in range(2)), pa.array(packed, pa.binary())], names)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, packed in zip(batch.column("class_a").to_pylist(), batch.column("bits").to_pylist()):
                sums[c] = sums.get(c, 0) + np.frombuffer(pa.decompress(packed, 4 * _CHUNK, codec="zstd", asbytes=True), np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([rarity(x).tobytes() for x in sums.values()], pa.binary())], ["chunk", "ranks"])

    surveyed = cut(spread(src).mapInArrow(survey, f"id {id_type}, class_a bigint, class_b bigint, n_tokens bigint, bits binary"), "shingles")
    rare = np.zeros(1 << SKETCH_BITS, np.uint16)
    for chunk, ranks in surveyed.where("id is null").select("class_a", "bits").repartition("class_a").mapInArrow(ranked, "chunk bigint, ranks binary").collect():  # 8 MB
        rare[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(ranks, np.uint16)
    held = spark.sparkContext.broadcast(rare)
    records = surveyed.where("id is not null")
    classes = records.select("id", "class_a", "class_b", "n_tokens").dropDuplicates(["id"])

    volume = (1 - threshold) * (records.agg(F.sum("n_tokens")).first()[0] or 0) * (CELL.itemsize + HEAD.itemsize)  # with many parts, a cell has a head of its own
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), math.ceil(volume / (part_mb * 1_000_000)))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(batch.column("text").to_pylist()):
                s = token_sets(texts, size, least_words)
                if not len(s.ends):
                    continue
                sigs, one = np.unique(signatures(s)[0], return_index=True)  # copies cost one row a block
                rows = list(zip(*matrix_parts(s.take(one), sigs, held.value, threshold, parts)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["part", "heads", "cells"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[bytes]] = [[], []]
        for batch in batches:
            for kept, name in zip(got, ("heads", "cells")):
                kept += batch.column(name).to_pylist()
        if got[0]:
            for a, b in open_groups(*got, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            ok = pa.array(reach(n, m, batch.column("x"), batch.column("y"), threshold))
            yield batch.select(["a", "b"]).filter(ok)

    matrix = spread(src).mapInArrow(plant, "part int, heads binary, cells binary").repartitionById(parts, F.col("part"))
    opened = cut(matrix.mapInArrow(compare, "a bigint, b bigint").distinct(), "opened")
    bits = records.groupBy("class_a").agg(F.first("n_tokens").alias("n"), F.first("bits").alias("bits"))
    sized = lambda p, n, x: bits.select(F.col("class_a").alias(p), F.col("n").alias(n), F.col("bits").alias(x))
    pairs = cut(opened.join(sized("a", "n", "x"), "a").join(sized("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(bounded, "a bigint, b bigint"), "pairs")

    # exact comparison: the token sets of the classes in open pairs, each from its least record
    sought = pairs.select(F.col("a").alias("class_a")).union(pairs.select("b")).distinct()
    named = cut(classes.groupBy("class_a", "class_b").agg(F.min("id").alias("id")).join(sought, "class_a"), "sought")
    slots, wanted = filters.build(named, F.xxhash64("id"))
    look = spark.sparkContext.broadcast(wanted)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.flatnonzero(filters.held(look.value, batch.column("slot").to_numpy()))
            for at, texts in blocks(batch.column("text").take(pa.array(rows)).to_pylist()):
                s = token_sets(texts, size, least_words)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, s.ends), pa.int32()), pa.array(s.tokens.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows[at + s.rows])), lists], ["id", "tokens"])

    tokens = spread(src).withColumn("slot", filters.slot(F.xxhash64("id"), slots)).mapInArrow(fetch, f"id {id_type}, tokens array<bigint>")
    sets = cut(tokens.join(named, "id").dropDuplicates(["id"]).select("class_a", "class_b", "tokens"), "tokens")
    side = lambda p: sets.select(*[F.col(c).alias(f"{p}_{c}") for c in sets.columns])
    met = pairs.join(side("a"), F.col("a") == F.col("a_class_a")).join(side("b"), F.col("b") == F.col("b_class_a"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = F.size("a_tokens") + F.size("b_tokens")
    links = met.withColumn("shared", shared).withColumn("both", both).where(F.col("shared") >= F.lit(threshold) * (F.col("both") - F.col("shared")) - 1e-9)
    return classes, links.select("a_class_a", "a_class_b", "b_class_a", "b_class_b", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))


def named_classes(classes: DataFrame) -> DataFrame:
    """class_a, class_b, class_id, n_copies: every class under the smallest id of its records."""
    return classes.groupBy("class_a", "class_b").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))


def link_counts(classes: DataFrame, links: DataFrame) -> DataFrame:
    """id, class_id, n_copies, n_links: one row per record with its class, the size of it and the number of similar classes."""
    ends = links.select(F.col("a_class_a").alias("class_a"), F.col("a_class_b").alias("class_b")).unionByName(links.select(F.col("b_class_a").alias("class_a"), F.col("b_class_b").alias("class_b")))
    per = ends.groupBy("class_a", "class_b").agg(F.count("*").alias("n_links"))
    named = named_classes(classes).join(per, ["class_a", "class_b"], "left")
    return classes.join(named, ["class_a", "class_b"]).select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of the edges with the smallest node that it hangs together with.

    Stars are moved onto smaller roots by turns, of larger and of smaller
    neighbours, until nothing changes: a number of rounds that grows with the
    logarithm of the longest path. Each round is written; only a count and a
    checksum come to the driver.
    """
    pair = lambda x, y: edges.select(F.col(x).alias("u"), F.col(y).alias("v"))
    now = cut(pair(a, b).unionByName(pair(b, a)).where("u > v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        larger = larger.where("u > v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u")
        moved = smaller.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(moved.where("u > v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == state:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
        mark = state


def record_groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """id, class_id, group_id, n_group: membership of every record in a group of records that hang together by similarity.

    group_id is the smallest id in the group, which stands for it; n_group
    counts its records. A record like no other is a group of its own.
    """
    named = cut(named_classes(classes), "classes")
    side = lambda p: named.select(F.col("class_a").alias(f"{p}_class_a"), F.col("class_b").alias(f"{p}_class_b"), F.col("class_id").alias(p))
    edges = links.join(side("a"), ["a_class_a", "a_class_b"]).join(side("b"), ["b_class_a", "b_class_b"]).select("a", "b")
    roots = components(edges).withColumnRenamed("node", "class_id")
    grouped = named.join(roots, "class_id", "left").withColumn("group_id", F.coalesce("root", "class_id"))
    size = grouped.groupBy("group_id").agg(F.sum("n_copies").alias("n_group"))
    return classes.join(grouped.join(size, "group_id").select("class_a", "class_b", "class_id", "group_id", "n_group"), ["class_a", "class_b"]).select("id", "class_id", "group_id", "n_group")


def record_pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """id_a, id_b: every pair of records of one class or of linked classes, the smaller id first.

    Its size is that of the result asked for: a class of n copies has n(n-1)/2 pairs.
    """
    a = classes.select(F.col("id").alias("x"), F.col("class_a").alias("a_class_a"), F.col("class_b").alias("a_class_b"))
    b = classes.select(F.col("id").alias("y"), F.col("class_a").alias("b_class_a"), F.col("class_b").alias("b_class_b"))
    across = links.join(a, ["a_class_a", "a_class_b"]).join(b, ["b_class_a", "b_class_b"]).select("x", "y")
    within = a.join(b, (F.col("a_class_a") == F.col("b_class_a")) & (F.col("a_class_b") == F.col("b_class_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
