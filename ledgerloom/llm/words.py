"""Words of texts, shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ..functions.text import fold_pairs

WORD = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(*fold_pairs())


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def folded(text: str) -> str:
    """Lower case without accents, ß as ss; may change the length."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower().translate(_FOLD).replace("ß", "ss")


@lru_cache(1 << 16)
def _folded_word(word: str) -> str:
    return word.translate(_FOLD).replace("ß", "ss")


def folded_words(text: str) -> list[str]:
    """Words of the folded text."""
    if text.isascii():
        return WORD.findall(text.lower())
    if not unicodedata.is_normalized("NFC", text):
        return WORD.findall(folded(text))
    return [w if w.isascii() else _folded_word(w) for w in WORD.findall(text.lower())]
