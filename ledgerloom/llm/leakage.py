"""Evaluation texts inside training text, found by an FM-index per training shard.

A shard is a run of documents of one partition. Its word sequence, over the
alphabet of the evaluation passages plus one symbol for every other word and
one between documents, gets a suffix array, its Burrows-Wheeler transform in a
wavelet matrix and sampled suffix positions. All phrases of twelve words are
searched backwards together, their occurrences located by walking to the next
sample, and spans that touch merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread
from .words import folded_words

BETWEEN, OTHER = 0, 1


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes of a sequence of symbols.

    The first sort covers as many symbols as 63 bits hold, later rounds double
    the depth and only sort what is still tied.
    """
    n = len(seq)
    if n < 2:
        return np.arange(n)
    width = int(seq.max() + 1).bit_length()
    h = min(8, 63 // width)
    x = np.concatenate([seq.astype(np.int64) + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << width) | x[k : n + k]
    sa = np.argsort(key)
    k = key[sa]
    del key
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.zeros(n + 1, np.int64)  # at n: before everything
    while True:
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa] = group + 1
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return sa
        at = sa[tied]
        key = group[tied] * (n + 2) + rank[np.minimum(at + h, n)]
        order = np.argsort(key, kind="stable")
        sa[tied], key = at[order], key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[tied] |= fresh
        h *= 2


class FMIndex:
    """Backward search and location over one sequence of symbols; BETWEEN ends every document."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]  # the suffix 0 is preceded by the last symbol, a BETWEEN
        self.n, self.levels = n, max(1, int(n_symbols - 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.bits, self.counts, self.zeros = [], [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            one = ((cur >> level) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 64, np.uint8)
            packed[:n] = one
            packed = np.packbits(packed, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(one.sum()))
            cur = np.concatenate([cur[~one], cur[one]])
        start = np.zeros(n, bool)
        start[0], start[1:] = True, seq[:-1] == BETWEEN
        keep = (sa % sample == 0) | start[sa]
        self.bwt, self.marks = bwt, keep
        self.where = np.cumsum(keep) - 1
        self.samples = sa[keep]

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.bits[level][block] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c in the first i of the transform."""
        a, b = np.zeros_like(i), i.copy()
        for level in range(self.levels):
            bit = ((c >> (self.levels - 1 - level)) & 1).astype(bool)
            oa, ob = self._ones(level, a), self._ones(level, b)
            a, b = np.where(bit, self.zeros[level] + oa, a - oa), np.where(bit, self.zeros[level] + ob, b - ob)
        return b - a

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place of each phrase (one a row) in the suffix order."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo[alive] = self.first[c] + self.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the sequence of places in the suffix order."""
        out, steps, at = np.full(len(places), -1, np.int64), 0, places.copy()
        rest = np.arange(len(places))
        while len(rest):
            hit = self.marks[at]
            out[rest[hit]] = self.samples[self.where[at[hit]]] + steps
            rest, at = rest[~hit], at[~hit]
            c = self.bwt[at].astype(np.int64)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


class Phrases:
    """All runs of ``length`` words of the items, their alphabet and their items."""

    def __init__(self, items: list[tuple[int, str]], length: int):
        self.symbol: dict[str, int] = {}
        runs: dict[tuple, set[int]] = {}
        for item, passage in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 2) for x in folded_words(passage)]
            for i in range(len(w) - length + 1):
                runs.setdefault(tuple(w[i : i + length]), set()).add(item)
        self.length, self.n_symbols = length, len(self.symbol) + 2
        self.table = np.array(list(runs), np.int64).reshape(-1, length)
        self.items = [sorted(v) for v in runs.values()]


def search_shard(phrases: Phrases, seq: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, words) of every merged span in a shard."""
    index = FMIndex(seq, phrases.n_symbols)
    lo, hi = index.search(phrases.table)
    n = hi - lo
    hit = np.flatnonzero(n)
    if not len(hit):
        return []
    which = np.repeat(hit, n[hit])
    places = np.concatenate([np.arange(lo[i], hi[i]) for i in hit])
    pos = index.locate(places)
    doc = np.searchsorted(starts, pos, side="right") - 1
    spans = sorted((int(d), item, int(p)) for d, w, p in zip(doc, which, pos - starts[doc]) for item in phrases.items[w])
    out: list[list[int]] = []
    for d, item, p in spans:
        if out and out[-1][0] == d and out[-1][1] == item and p <= out[-1][3]:
            out[-1][3] = max(out[-1][3], p + phrases.length)
        else:
            out.append([d, item, p, p + phrases.length])
    return [(d, item, a, b - a) for d, item, a, b in out]


def find_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", length: int = 12, shard_words: int = 1_500_000, block_mb: float = 16) -> DataFrame:
    """doc_id, item_id, first_word, n_words, span: spans of documents that stand in an item's passage.

    A span is a merged run of words of which every ``length`` consecutive ones
    stand in the passage in order, ignoring case, accents, punctuation and
    spacing; span is these words, joined by blanks. Passages and texts of fewer
    words, null and empty ones give nothing; several items of the same passage
    each get a row; repeated documents give repeated rows; extra columns are
    ignored. Every task holds the phrases of the items: sets of more than
    ``block_mb`` are searched in blocks of about that size, by the hash of the
    item, each in a pass over the documents of its own.
    """
    ship(documents.sparkSession)
    held = items.select(F.col(item_col).alias("item"), F.col(passage_col).alias("passage")).where("item is not null and passage is not null")
    size = held.agg(F.sum(F.octet_length("passage")).alias("b")).first().b or 0
    n = max(1, math.ceil(size / (block_mb * 1_000_000)))
    parts = [held if n == 1 else held.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]
    found = [_find_block(documents, part, id_col, text_col, length, shard_words) for part in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _find_block(documents: DataFrame, held: DataFrame, id_col: str, text_col: str, length: int, shard_words: int) -> DataFrame:
    """The leaks of items (item, passage) whose phrases fit into a task."""
    src = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id {held.schema['item'].dataType.simpleString()}, first_word int, n_words int, span string"
    phrases = Phrases([(r.item, r.passage) for r in held.distinct().collect()], length)
    shared = documents.sparkSession.sparkContext.broadcast(phrases)
    id_type, item_type = (pa.int64() if k == "bigint" else None for k in (src.schema["doc_id"].dataType.simpleString(), held.schema["item"].dataType.simpleString()))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
        symbol = shared.value.symbol
        ids, texts, seq, starts = [], [], [], []

        def full():
            return ids, texts, np.array(seq, np.int32), np.array(starts, np.int64)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = [symbol.get(x, OTHER) for x in folded_words(text)]
                if len(w) < length:
                    continue
                ids.append(doc)
                texts.append(text)
                starts.append(len(seq))
                seq += w
                seq.append(BETWEEN)
                if len(seq) >= shard_words:
                    yield full()
                    ids, texts, seq, starts = [], [], [], []
        if ids:
            yield full()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(shared.value.table):
            return
        for ids, texts, seq, starts in shards(batches):
            rows, at, spoken = [], -1, []
            for d, item, a, n in search_shard(shared.value, seq, starts):
                if d != at:
                    at, spoken = d, folded_words(texts[d])
                rows.append((ids[d], item, a, n, " ".join(spoken[a : a + n])))
            c = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], id_type), pa.array(c[1], item_type), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.string())], ["doc_id", "item_id", "first_word", "n_words", "span"])

    return spread(src).mapInArrow(find, schema)
