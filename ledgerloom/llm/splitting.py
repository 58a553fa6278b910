"""Splitting oversized items at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: white space around a text that does not count
EDGE = " \t\n\r\f\v "
#: natural places: breaks with the blanks around them, blanks after a sentence, ' | '
NATURAL = re.compile(r"[ \t ]*[\n\r\f][\s]*|(?<=[.!?])[ \t ]+|(?<= \|) ")
BLANK = re.compile(r"[\s ]+")

SCHEMA = "piece int, text string, start bigint, stop bigint, shared int, page int, cut_class string"


def _strength(gap: str) -> int:
    """How natural a boundary is: page 5, empty line 4, line 3, sentence 2, field 1."""
    if "\f" in gap:
        return 5
    lines = gap.count("\n") or gap.count("\r")
    return 4 if lines > 1 else 3 if lines else 2


def atoms(text: str, limit: int, overlap: int = 0) -> tuple[list[int], list[int], str]:
    """End of each atomic segment, strength of the boundary after it, cut class.

    Blanks belong to the segment before them. A stretch longer than the limit
    is cut at blanks (strength 0), a run without blanks by length (strength -1),
    so short that the overlap has room beside it.
    """
    step = max(1, limit - overlap)
    ends, strengths, kind = [], [], "clean"

    def long_stretch(a: int, b: int, last: int) -> str:
        got, at = "word", a
        words = [m.end() for m in BLANK.finditer(text, a, b)]
        if not words or words[-1] != b:
            words.append(b)
        for w in words:
            if len(text[at:w].rstrip(EDGE)) > limit:
                got = "hard"
            while w - at > limit:
                at += step
                ends.append(at)
                strengths.append(-1)
            if w > at:
                ends.append(w)
                strengths.append(0)
                at = w
        if strengths:
            strengths[-1] = last
        return got

    at = 0
    cuts = [(m.end(), 1 if text[m.start() - 1] == "|" else _strength(m.group())) for m in NATURAL.finditer(text)]
    if not cuts or cuts[-1][0] != len(text):
        cuts.append((len(text), 6))
    for end, strength in cuts:
        if end - at > limit:
            if len(text[at:end].strip(EDGE)) > limit:
                got = long_stretch(at, end, strength)
                kind = "hard" if "hard" in (kind, got) else "word"
            else:
                long_stretch(at, end, strength)
        elif end > at:
            ends.append(end)
            strengths.append(strength)
        at = end
    return ends, strengths, kind


def merge(ends: list[int], strengths: list[int], room: int) -> list[int]:
    """Ends after merging the weakest boundary first while two neighbours fit into room.

    Ties go to the smaller combined size, then to the earlier place.
    """
    n = len(ends)
    start = [0, *ends[:-1]]
    stop, left, right, alive = list(ends), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (size := stop[j] - start[i]) <= room:
            heap.append((strengths[i], size, i, j)) if not ready else heapq.heappush(heap, (strengths[i], size, i, j))

    ready = False
    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or stop[j] - start[i] != size:
            continue
        stop[i], strengths[i], right[i], alive[j] = stop[j], strengths[j], right[j], False
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [stop[i] for i in range(n) if alive[i]]


def split_text(text: str, limit: int = 1200, overlap: int = 150) -> list[tuple[int, int, int, str]]:
    """(start, own start, stop, cut class) of each piece of a text, offsets in the text.

    start..stop is at most limit; start..own start repeats the end of the piece
    before, at most overlap, beginning at a natural place, or else after a
    blank, or else anywhere. The own parts put together are the text without
    surrounding blanks.
    """
    overlap = min(overlap, limit - 1)
    lead = len(text) - len(text.lstrip(EDGE))
    body = text.strip(EDGE)
    if not body:
        return []
    ends, strengths, kind = atoms(body, limit, overlap)
    out, at = [], 0
    for end in merge(ends, strengths, max(1, limit - overlap)):
        room, begin = min(overlap, limit - (end - at), at), at
        if room > 0:
            tail = body[at - room : at]
            place = next((m.end() for m in NATURAL.finditer(tail) if m.end() < room), None)
            if place is None:
                place = next((m.end() for m in BLANK.finditer(tail) if m.end() < room), 0)
            begin = at - room + place
        out.append((lead + begin, lead + at, lead + end, kind))
        at = end
    return out


def split_items(items: DataFrame, id_col: str = "id", text_col: str = "text", page_col: str | None = "page", limit: int = 1200, overlap: int = 150) -> DataFrame:
    """id, piece, text, start, stop, shared, page, cut_class: items over the limit, in pieces.

    Only items whose text without surrounding blanks is longer than limit come
    out; pieces count from 0 in order, shared is the number of characters taken
    over from the piece before, page the page on which the piece starts (a form
    feed starts the next one; unknown stays null). A record delivered twice is
    split once, rows with a null id each for themselves; null and short texts give nothing; extra columns are ignored.
    cut_class is 'clean', 'word' or 'hard' as for the whole item.
    """
    ship(items.sparkSession)
    page = F.col(page_col).cast("int") if page_col else F.lit(None).cast("int")
    long = (
        items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), page.alias("page"))
        .where(F.length(F.btrim("text", F.lit(EDGE))) > limit)
        .withColumn("nameless", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
        .dropDuplicates(["id", "nameless"])
        .drop("nameless")
    )
    kind = long.schema["id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id"), []
            for i, (text, first) in enumerate(zip(batch.column("text").to_pylist(), batch.column("page").to_pylist())):
                for n, (a, own, b, cls) in enumerate(split_text(text, limit, overlap)):
                    rows.append((i, n, text[a:b], a, b, own - a, None if first is None else first + text.count("\f", 0, a), cls))
            c = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int32()), pa.array(c[6], pa.int32()), pa.array(c[7], pa.string())],
                ["id", "piece", "text", "start", "stop", "shared", "page", "cut_class"],
            )

    return long.mapInArrow(pieces, f"id {kind}, {SCHEMA}")
