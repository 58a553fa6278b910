"""Reading level of documents from vocabulary coverage and sentence complexity.

Two passes over the texts: the first counts the vocabulary, the second finds
of each document how far down the frequency-ranked vocabulary it must go to
cover a fixed share of its words, along with its words, sentences and long
words. Both work on whole Arrow batches. Coverage rank and sentence complexity
are calibrated against sample grades in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, spread

#: words of the vocabulary that every task holds; documents that need more go through a join
HEAD = 1 << 16
#: blanks and line breaks
_B = r"\t\n\x0b\f\r "
#: characters that are worked on together
CHARS = 8_000_000


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of bounded length, with the place of each run."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHARS, side="right")))
        yield a, texts.slice(a, b - a)
        a = b


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of texts without nulls, one after the other, and where each ends, from 0."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), (at - at[0]).astype(np.int64)


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of inside bytes begin, none across two texts, and the text of each."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = ends[:-1][ends[:-1] < ends[1:]]
    first[border] = inside[border]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(ends[1:], starts, side="right")


_LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FILLED = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])


def word_list(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (runs of letters and digits, lower case) and the text of each."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\x00-\x7f\pL\pN]+", " ")
    data, ends = bytes_of(low)
    inside = _LETTERS[data]
    starts, owner = runs(inside, ends)
    before = np.cumsum(inside)[starts] - 1 if len(starts) else starts
    kept = data[inside]
    offsets = np.append(before, len(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept)), owner


def sentence_features(texts: pa.Array) -> dict[str, pa.Array]:
    """n_words, n_sentences, n_long of texts: words at blanks, long with seven letters in a row.

    A sentence ends at '.', '!' or '?' before blanks or line breaks and at an
    empty line; empty stretches between are no sentences. A match of seven
    letters takes the rest of its word, so a word counts once.
    """
    t = pc.replace_substring(pc.fill_null(texts, ""), "\x01", "\x02")
    data, ends = bytes_of(t)
    ended = pc.replace_substring_regex(pc.replace_substring_regex(t, r"\n[ \t\r]*\n", "\x01"), rf"([.!?])[{_B}]+", "\\1\x01")
    counts = {
        "n_words": pa.array(np.bincount(runs(_FILLED[data], ends)[1], minlength=len(texts))),
        "n_sentences": pc.count_substring_regex(ended, rf"[^\x01]*[^\x01{_B}][^\x01]*"),
        "n_long": pc.count_substring_regex(t, rf"\pL{{7}}[^{_B}]*"),
    }
    return {k: v.cast(pa.int64()) for k, v in counts.items()}


def vocabulary(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n, rank: every word of the corpus; rank counts the words at least as frequent.

    Counted over all rows (a document delivered twice counts twice), summed
    within a batch and a task before anything moves. Words are runs of letters
    and digits in lower case.
    """
    ship(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                seen = pc.value_counts(word_list(texts)[0])
                yield pa.RecordBatch.from_arrays([seen.field(0), seen.field(1)], ["word", "n"])

    src = documents.select(F.col(text_col).alias("text")).where("text is not null")
    words = cut(spread(src).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    # as many rows as there are different frequencies: at most the root of twice the tokens
    per = words.groupBy("n").agg(F.count("*").alias("w"))
    ranks = per.selectExpr("n", "sum(w) over (order by n desc rows unbounded preceding) rank")
    return words.join(ranks, "n").select("word", "n", "rank")


def measure(documents: DataFrame, vocab: DataFrame, id_col: str, text_col: str, share: float, head: int = HEAD) -> DataFrame:
    """id, n_words, n_sentences, n_long, coverage_rank: one row per row of a document.

    coverage_rank is the size of the smallest frequency-ranked vocabulary that
    covers ``share`` of the document's words. The head of the vocabulary (at
    most ``head`` words) is held by every task; documents for which it does not
    suffice are joined with the whole vocabulary. Texts without words have rank
    null; null ids are left out.
    """
    ship(documents.sparkSession)
    top = vocab.where(F.col("rank") <= head).select("word", "rank").toArrow()
    held = documents.sparkSession.sparkContext.broadcast((top.column("word").combine_chunks(), np.asarray(top.column("rank")).astype(np.int64)))
    src = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    kind = src.schema["id"].dataType.simpleString()
    names = ["id", "n_words", "n_sentences", "n_long", "coverage_rank", "rest"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = held.value
        far = np.int64(1 << 32)  # beyond any rank that a task holds
        ranks = np.append(ranks, far)
        for batch in batches:
            for a, texts in pieces(batch.column("text")):
                words, owner = word_list(texts)
                coded = words.dictionary_encode()
                place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=known), len(known))) if len(words) else np.zeros(0, np.int64)
                rank = ranks[place][np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
                n = np.bincount(owner, minlength=len(texts))
                start = np.cumsum(n) - n
                ordered = np.sort((owner.astype(np.int64) << 33) | rank) & ((1 << 33) - 1)
                at = start + np.maximum(0, np.ceil(share * n - 1e-9).astype(np.int64) - 1)
                cover = np.zeros(len(texts), np.int64)
                cover[n > 0] = ordered[at[n > 0]]
                beyond = cover == far
                kept = pa.array(beyond[owner])
                ends = np.append(0, np.cumsum(np.where(beyond, n, 0)))
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(kept))
                ranked = pa.array(cover, mask=(n == 0) | beyond)
                f = sentence_features(texts)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, len(texts)), f["n_words"], f["n_sentences"], f["n_long"], ranked, rest], names)

    first = cut(spread(src).mapInArrow(look, f"id {kind}, n_words bigint, n_sentences bigint, n_long bigint, coverage_rank bigint, rest array<string>"), "coverage")
    far = first.where("size(rest) > 0").select("id", F.explode("rest").alias("word")).groupBy("id", "word").agg(F.count("*").alias("c"))
    ranked = far.join(vocab.select("word", "rank"), "word").groupBy("id", "rank").agg(F.sum("c").alias("c"))
    covered = ranked.selectExpr("id", "rank", "sum(c) over (partition by id order by rank) so_far", "sum(c) over (partition by id) total")
    exact = covered.where(F.col("so_far") >= F.lit(share) * F.col("total") - 1e-9).groupBy("id").agg(F.min("rank").alias("further"))
    return first.join(exact, "id", "left").select("id", "n_words", "n_sentences", "n_long", F.coalesce("coverage_rank", "further").alias("coverage_rank"))


@dataclass(frozen=True)
class Fit:
    """Grade = base + vocabulary * log1p(coverage rank) + length * log1p(words a sentence) + long * share of long words.

    n documents were graded, of which those held out give the errors: root
    mean square of the fit and of always saying the mean.
    """

    base: float
    vocabulary: float
    length: float
    long: float
    n: int
    n_held_out: int
    rmse: float | None
    rmse_of_mean: float | None


def calibrate(per: DataFrame, labels: DataFrame, label_col: str = "doc_id", least: int = 8) -> Fit | None:
    """Fit of the mean label of a document; None if fewer than ``least`` documents are graded.

    A fifth of the graded documents, by the hash of the id, is held out to
    measure the error; the weights returned are from all of them. The sums are
    one SQL aggregate, the fit a 4 x 4 system.
    """
    names = ["1d", "x", "y", "z"]
    sums = ", ".join(f"sum({p} * {q}) s{i}{j}" for i, p in enumerate(names) for j, q in enumerate(names) if i <= j) + ", " + ", ".join(f"sum({p} * g) t{i}" for i, p in enumerate(names)) + ", sum(g * g) gg"
    got = per.sparkSession.sql(
        f"""
      with graded as (select {label_col} id, avg(grade) g from (select distinct {label_col}, rater, grade from {{labels}}) where grade is not null group by {label_col}),
      v as (select log1p(coverage_rank) x, log1p(words_per_sentence) y, long_share z, g, pmod(xxhash64(id), 5) = 0 held from {{per}} join graded using (id)
        where coverage_rank is not null and words_per_sentence is not null)
      select held, count(*) n, {sums} from v group by held""",
        per=per,
        labels=labels,
    ).collect()
    sums_of = {bool(r.held): (np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)], float), np.array([r[f"t{i}"] for i in range(4)], float), float(r.gg)) for r in got}
    n = sum(r.n for r in got)
    if n < least:
        return None
    solve = lambda m, t: np.linalg.lstsq(m, t, rcond=None)[0]
    rmse = of_mean = None
    if True in sums_of and False in sums_of:
        m, t, gg = sums_of[True]
        w = solve(*sums_of[False][:2])
        mean = sums_of[False][1][0] / sums_of[False][0][0, 0]
        square = lambda c: math.sqrt(max(0.0, (gg - 2 * c @ t + c @ m @ c) / m[0, 0]))
        rmse, of_mean = square(w), square(np.array([mean, 0, 0, 0]))
    w = solve(sum(m for m, _, _ in sums_of.values()), sum(t for _, t, _ in sums_of.values()))
    return Fit(*map(float, w), n, next((r.n for r in got if r.held), 0), rmse, of_mean)


def complexity_bounds(fit: Fit) -> tuple[float, float]:
    """The most that the sentence part of the grade can be in an easy text, and the least in a hard one, by the sign of the weights."""
    easy = max(fit.length * math.log1p(9), 0.0) + max(fit.long * 0.25, 0.0)
    hard = (fit.length * math.log1p(30) if fit.length >= 0 else -math.inf) + (fit.long * 0.3 if fit.long >= 0 else fit.long)
    return easy, hard


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, head: int = HEAD) -> DataFrame:
    """id, n_words, n_sentences, n_long, coverage_rank, words_per_sentence, long_share: one row per document."""
    per = measure(documents, vocabulary(documents, text_col), id_col, text_col, share, head).dropDuplicates(["id"])
    return cut(per.selectExpr("*", "n_words / nullif(n_sentences, 0) words_per_sentence", "n_long / nullif(n_words, 0) long_share"), "reading")


def reading_profile(documents: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, head: int = HEAD) -> DataFrame:
    """doc_id, n_words, n_sentences, n_long, words_per_sentence, long_share, coverage_rank, grade, band, level: one row per document.

    grade is calibrated in SQL (see ``calibrate``): it weighs coverage rank,
    sentence length and long words; band is the grade as a whole number of 1
    to 5. Both are null without labels that allow a fit. level marks the two
    ends of the scale: 'easy' (at least 20 words, sentences of at most 9 words
    on average, at most a quarter long words), 'hard' (at least 30 words a
    sentence, at least 30 % long), 'medium' for other texts of at least 20
    words, else null. Candidates for the ends are taken by the calibrated
    score, whose sentence part cannot be beyond a bound there, and then checked
    exactly by their counts. Null and empty texts have no words and no level. A
    document delivered twice comes out once; extra columns are ignored; an
    empty table gives no rows.
    """
    per = measured(documents, id_col, text_col, share, head)
    fit = calibrate(per, labels) if labels is not None else None
    easy = hard = F.lit(True)
    grade = F.lit(None).cast("double")
    if fit is not None:
        part = F.lit(fit.length) * F.log1p("words_per_sentence") + F.lit(fit.long) * F.col("long_share")
        grade = F.lit(fit.base) + F.lit(fit.vocabulary) * F.log1p("coverage_rank") + part
        most, least = complexity_bounds(fit)
        easy, hard = part <= most + 1e-9, part >= least - 1e-9
    level = (
        F.when(F.col("n_words") < 20, None)
        .when(easy & F.expr("words_per_sentence <= 9 and n_long * 4 <= n_words"), "easy")
        .when(hard & F.expr("words_per_sentence >= 30 and n_long * 10 >= n_words * 3"), "hard")
        .otherwise("medium")
    )
    band = F.greatest(F.lit(1), F.least(F.lit(5), F.round(grade).cast("int")))
    return per.select(F.col("id").alias("doc_id"), "n_words", "n_sentences", "n_long", "words_per_sentence", "long_share", "coverage_rank", grade.alias("grade"), F.when(grade.isNotNull(), band).alias("band"), level.alias("level"))


def calibration(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row with the weights of the fit, the graded documents and the errors on those held out; none without a fit."""
    fit = calibrate(measured(documents, id_col, text_col), labels)
    schema = "base double, vocabulary double, length double, long double, n_graded bigint, n_held_out bigint, rmse double, rmse_of_mean double"
    rows = [] if fit is None else [(fit.base, fit.vocabulary, fit.length, fit.long, fit.n, fit.n_held_out, fit.rmse, fit.rmse_of_mean)]
    return documents.sparkSession.createDataFrame(rows, schema)
