"""Text scalars: keys, accent folding, column names, words."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: characters that count as blanks around a value
BLANKS = " \t\n\r\f\u000b "


def strip(c: Column) -> Column:
    """Without surrounding blanks; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def key(c: Column) -> Column:
    """Key of a reference: without surrounding blanks, lower case; empty becomes null."""
    k = F.lower(strip(c.cast("string")))
    return F.when(k != "", k)


@cache
def fold_pairs() -> tuple[str, str]:
    """Every precomposed letter below U+2000 whose canonical decomposition starts with a plain letter."""
    src, dst = [], []
    for o in range(0xA0, 0x2000):
        base = unicodedata.normalize("NFKD", chr(o))
        if len(base) > 1 and base[0].isalnum() and all(unicodedata.combining(x) for x in base[1:]):
            src.append(chr(o))
            dst.append(base[0])
    return "".join(src), "".join(dst)


def fold_accents(c: Column) -> Column:
    """Letters without their accents, combining marks removed."""
    src, dst = fold_pairs()
    return F.regexp_replace(F.translate(c, src, dst), r"\p{M}", "")


def norm_col(c: Column) -> Column:
    """Catalogue spelling of a column name: lower case, no accents, ß as ss, only [0-9a-z].

    Null stays null; a name without any such character becomes ''.
    """
    return F.regexp_replace(fold_accents(F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))), "[^0-9a-z]", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, as an array; null text gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
