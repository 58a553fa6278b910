"""Document language by prediction by partial matching.

Per language a byte context tree of variable order with escape probabilities
(method C) is counted on a bounded sample and frozen. A text's code length per
language is exact under these statistics: a byte seen after the longest known
context costs -log2 of its share there, else an escape is paid and the context
is shortened, down to eight bits without context. Languages of a text are the
runs of the cheapest path over its words, a change of language costing a fixed
number of bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_pairs
from ..session import ship, spread

_FOLD = str.maketrans(*fold_pairs())
ORDER = 4
# Spellings that name a language, besides codes with a region.
NAMES = {
    "de": "de deu ger german deutsch allemand aleman alemán germany deutschland",
    "en": "en eng english englisch anglais ingles inglés",
    "fr": "fr fra fre french francais français französisch franzoesisch frances francés",
    "es": "es spa spanish espanol español spanisch espagnol castellano",
}
LANGS = tuple(NAMES)
#: a word is a token of letters only; codes, hashes and figures are no running text
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
#: what stands for text of none of the languages: it costs this many bits a byte
UNKNOWN, NOISE_BITS = "und", 5.0
#: a stretch whose language is less sure than this is no evidence of it
LEAST_CONFIDENCE = 0.8


def named_language(hint: Column) -> Column:
    """'de', 'en', 'fr' or 'es' if the hint names one (code, region code, name), else null."""
    first = F.regexp_extract(F.lower(F.btrim(hint, F.lit(" \t\n\r "))), r"^([\p{L}]+)([-_ ].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(first.isin(*names.split()), lang).otherwise(out)
    return out


@dataclass
class Tree:
    """Frozen statistics of all languages: per order, packed grams with code lengths, contexts with escape lengths."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words (letters only, lower case, no accents, one blank after each), word starts, words per text."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = WORD.findall(t.lower().translate(_FOLD))
        counts[i] = len(w)
        words += w
    if not words:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), counts
    data = np.frombuffer((" ".join(words) + " ").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    return data, np.concatenate([[0], ends[:-1]]), counts


def _packed(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte the last ``order`` bytes and itself in one integer; before the start stand blanks."""
    x = np.concatenate([np.full(order, 32, np.uint8), data]).astype(np.int64)
    n, out = len(data), np.zeros(len(data), np.int64)
    for k in range(order + 1):
        out = (out << 8) | x[k : k + n]
    return out


def train(samples: dict[str, list[str]], order: int = ORDER, least_share: float = 0.0) -> Tree:
    """Count the context trees of each language's texts and freeze them.

    With least_share, grams that are rarer in a language than this share of
    their frequency elsewhere are left out of it: traces of wrong labels.
    """
    grams, bits, contexts, escapes = [], [], [], []
    data = {lang: _bytes(samples.get(lang, []))[0] for lang in LANGS}
    for k in range(order + 1):
        counted = [np.unique(_packed(data[lang], k), return_counts=True) for lang in LANGS]
        every = np.unique(np.concatenate([g for g, _ in counted]))
        most = np.zeros(len(every))
        for g, n in counted:
            at = np.searchsorted(every, g)
            most[at] = np.maximum(most[at], n / max(1, n.sum()))
        per = []
        for g, n in counted:
            keep = n / max(1, n.sum()) >= least_share * most[np.searchsorted(every, g)]
            g, n = g[keep], n[keep]
            c, at, distinct = np.unique(g >> 8, return_inverse=True, return_counts=True)
            total = np.bincount(at, n, len(c)) if len(g) else np.zeros(0)
            per.append((g, -np.log2(n / (total[at] + distinct[at])) if len(g) else n, c, -np.log2(distinct / (total + distinct)) if len(g) else total))
        all_g, all_c = (np.unique(np.concatenate([p[j] for p in per])) for j in (0, 2))
        esc = np.zeros((len(all_c), len(LANGS)), np.float32)
        for j, (_, _, c, e) in enumerate(per):
            esc[np.searchsorted(all_c, c), j] = e
        lower = cost(Tree(grams, bits, contexts, escapes), all_g & ((1 << 8 * k) - 1), k - 1) if k else np.full((len(all_g), len(LANGS)), 8, np.float32)
        b = (lower + esc[np.searchsorted(all_c, all_g >> 8)]).astype(np.float32)
        for j, (g, own, _, _) in enumerate(per):
            b[np.searchsorted(all_g, g), j] = own
        grams.append(all_g)
        bits.append(b)
        contexts.append(all_c)
        escapes.append(esc)
    return Tree(grams, bits, contexts, escapes)


def _find(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, sought)
    at[at == len(keys)] = 0
    return at, (keys[at] == sought) if len(keys) else np.zeros(len(sought), bool)


def cost(tree: Tree, packed: np.ndarray, order: int) -> np.ndarray:
    """Code length of each packed gram in each language, in bits."""
    out = np.zeros((len(packed), len(LANGS)), np.float32)
    rest = np.arange(len(packed))
    for k in range(order, -1, -1):
        if not len(rest):
            return out
        key = packed[rest] & ((1 << 8 * (k + 1)) - 1)
        at, hit = _find(tree.grams[k], key)
        out[rest[hit]] += tree.bits[k][at[hit]]
        rest, key = rest[~hit], key[~hit]
        at, hit = _find(tree.contexts[k], key >> 8)
        out[rest[hit]] += tree.escapes[k][at[hit]]
    out[rest] += 8
    return out


def word_costs(tree: Tree, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code length of each word in each language; number of words of each text; bytes of each word."""
    data, starts, counts = _bytes(texts)
    if not len(data):
        return np.zeros((0, len(LANGS)), np.float32), counts, starts
    grams, at = np.unique(_packed(data, len(tree.grams) - 1), return_inverse=True)
    return np.add.reduceat(cost(tree, grams, len(tree.grams) - 1)[at], starts, axis=0), counts, np.diff(starts, append=len(data))


def paths(words: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on its text's cheapest path; every change costs ``switch`` bits.

    All texts of a batch step through their words together, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    n = counts[order]
    back = np.zeros((len(words), len(LANGS)), np.int8)
    total = np.zeros((len(counts), len(LANGS)), np.float32)
    same = np.arange(len(LANGS), dtype=np.int8)
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t words
    for t in range(longest):
        m = alive[t]
        rows, so_far = first[:m] + t, total[:m]
        best = so_far.argmin(1)
        change = so_far[np.arange(m), best] + switch
        take = change[:, None] < so_far
        back[rows] = np.where(take, best[:, None].astype(np.int8), same)
        total[:m] = np.where(take, change[:, None], so_far) + words[rows]
    out = np.zeros(len(words), np.int8)
    state = total.argmin(1)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        rows = first[:m] + t
        out[rows] = state[:m]
        state[:m] = back[rows, state[:m]]
    return out


def stretches(tree: Tree, texts: list[str], switch: float, least_words: int, least_bits: float) -> list[list[tuple[int, int, int, float]]]:
    """Per text its (first word, last word + 1, language, confidence) stretches, neighbours joined.

    A stretch of fewer than least_words words, or that is less than least_bits
    cheaper in its language than in the text's main one, joins its neighbour.
    Confidence is the share of 2^-(code length / words) of the language. A
    stretch that is cheaper at NOISE_BITS a byte than in any language is of
    none of them (number len(LANGS)), its confidence that of this rate.
    """
    words, counts, sizes = word_costs(tree, texts)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    path = paths(words, counts, switch)
    sums = np.concatenate([np.zeros((1, len(LANGS))), np.cumsum(words, 0, dtype=np.float64)])
    out, a = [], 0
    for n in counts.tolist():
        b = a + n
        runs: list[list[int]] = []
        if n:
            p = path[a:b]
            cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), n]
            main = int(np.bincount(p, minlength=len(LANGS)).argmax())
            for s, e in zip(cuts, cuts[1:]):
                lang, c = int(p[s]), sums[a + e] - sums[a + s]
                if len(cuts) > 2 and (e - s < least_words or lang != main and c[main] - c[lang] < least_bits):
                    lang = -1
                if runs and lang in (-1, runs[-1][2]):
                    runs[-1][1] = e
                elif runs and runs[-1][2] == -1:
                    runs[-1][1:] = [e, lang]
                else:
                    runs.append([s, e, lang])
            if runs[0][2] == -1:
                runs[0][2] = main
        rows = []
        for s, e, lang in runs:
            c = (sums[a + e] - sums[a + s]) / (e - s)
            noise = NOISE_BITS * (offset[a + e] - offset[a + s]) / (e - s)
            if c[lang] > noise:
                lang, c = len(LANGS), np.append(c, noise)
            w = np.exp2(c.min() - c)
            rows.append((s, e, lang, float(w[lang] / w.sum())))
        out.append(rows)
        a = b
    return out


def fit(items: DataFrame, text_col: str, hint_col: str, sample: int = 3000, switch: float = 30.0) -> Tree | None:
    """Train on at most ``sample`` labelled rows, as many of each language, chosen by the hash of their text.

    A share of a language's rows that gives about twice its part of the sample
    is cut down to it, so what the tasks send stays bounded too; a language of
    fewer labels takes part with all of them. Labels may be wrong: the first
    model relabels the sample, texts of one language only train the final one.
    Texts outside 80 to 20,000 characters are taken only where a language has
    no others, as far as 20,000 characters. None if no row is labelled.
    """
    part = max(1, sample // len(LANGS))
    usable = (F.length("text") >= 80) & (F.length("text") <= 20000)
    labelled = items.select(F.col(text_col).alias("text"), named_language(F.col(hint_col)).alias("lang")).where("lang is not null and length(text) > 0")
    rows = []
    for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(usable).alias("good")).orderBy("lang").collect():
        mine = labelled.where(F.col("lang") == r.lang)
        mine = mine.where(usable) if r.good else mine.select(F.substring("text", 1, 20000).alias("text"), "lang")
        share = min(1.0, 2 * part / (r.good or r.n))
        chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
        rows += (mine if share == 1 else mine.where(chosen)).orderBy(F.xxhash64("text"), "text").limit(part).collect()
    if not rows:
        return None
    by = {lang: [r.text for r in rows if r.lang == lang] for lang in LANGS}
    for _ in range(2):
        tree = train(by, least_share=0.3)
        texts = [r.text for r in rows]
        again: dict[str, list[str]] = {lang: [] for lang in LANGS}
        for t, found in zip(texts, stretches(tree, texts, switch, 4, switch)):
            found = [x for x in found if x[3] >= LEAST_CONFIDENCE and x[2] < len(LANGS)]
            if len(found) == 1:
                again[LANGS[found[0][2]]].append(t)
        by = again if any(again.values()) else by
    return train(by)


def languages(items: DataFrame, id_col: str, text_col: str, hint_col: str, tree: Tree | None = None, sample: int = 3000, switch: float = 30.0, least_words: int = 4, least_bits: float = 45.0) -> DataFrame:
    """id, hinted, stretch, first_word, n_words, lang, confidence, n_langs: one row per stretch of one language.

    Every text with a word has a row; null, empty and texts of figures only give
    none. hinted is the language the hint names or null. A stretch of low
    confidence comes out with it, one of none of the languages as 'und';
    n_langs counts languages of at least LEAST_CONFIDENCE, which is also what
    p3_found asks for. A language that no row is labelled with is never
    assigned; texts of which none is labelled are an error. Repeated rows give
    repeated results;
    extra columns are ignored. The model is fitted on a bounded sample, the
    scoring covers every row and its whole text.
    """
    ship(items.sparkSession)
    src = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), named_language(F.col(hint_col)).alias("hinted")).where("text is not null")
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, hinted string, stretch int, first_word int, n_words int, lang string, confidence double, n_langs int"
    tree = tree or fit(items, text_col, hint_col, sample, switch)
    if tree is None:
        if not src.where("length(text) > 0").isEmpty():
            raise ValueError(f"no text has a {hint_col} that names one of {', '.join(LANGS)}: nothing to learn from")
        return items.sparkSession.createDataFrame([], schema)
    model = items.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                rows = []
                for i, found in enumerate(stretches(model.value, part.column("text").to_pylist(), switch, least_words, least_bits)):
                    n = len({x[2] for x in found if x[3] >= LEAST_CONFIDENCE and x[2] < len(LANGS)})
                    rows += [(i, k, a, b - a, [*LANGS, UNKNOWN][lang], c, n) for k, (a, b, lang, c) in enumerate(found)]
                c = list(zip(*rows)) if rows else [()] * 7
                at = pa.array(c[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("hinted").take(at), *(pa.array(c[k], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.string()), (5, pa.float64()), (6, pa.int32())))],
                    ["id", "hinted", "stretch", "first_word", "n_words", "lang", "confidence", "n_langs"],
                )

    return spread(src).mapInArrow(score, schema)
