"""Reading numbers and dates from text as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The notations in which a cell's number and date are read.
AMOUNT_PLAIN = r"^[0-9]+$"
AMOUNT_DOT_GROUPS = r"^[1-9][0-9]{0,2}([.][0-9]{3})+(,[0-9]+)?$"
AMOUNT_COMMA_GROUPS = r"^[1-9][0-9]{0,2}(,[0-9]{3})+([.][0-9]+)?$"
AMOUNT_BLANK_GROUPS = r"^[1-9][0-9]{0,2}( [0-9]{3})+([.,][0-9]+)?$"
AMOUNT_DECIMAL = r"^[0-9]*[.,][0-9]+$"
CLOCK = r"([T ]+[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
DATE_YMD = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})" + CLOCK
DATE_DMY = r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})" + CLOCK


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read_amount(c: Column) -> Column:
    """Double that a cell's text names, else null.

    Dot, comma or blank as group or decimal mark, leading or trailing sign or
    brackets for negative, EUR or €. Groups have exactly three digits, so
    '1.234' is 1234 and '0.125' a fraction. Null, empty and anything else: null.
    """
    s = F.regexp_replace(strip(c), "[\u00a0\u2007\u2009\u202f ]", " ")
    s = F.regexp_replace(s, r"(?i)^([+−-]?|[(]) *(EUR|€) *", "$1")
    s = F.regexp_replace(s, r"(?i) *(EUR|€) *([)]?)$", "$2")
    s = F.regexp_replace(s, r"^[(]([^()−+-]*)[)]$", "-$1")
    s = F.regexp_replace(s, r"^([^+−-]*[0-9]) *[−-]$", "-$1")

    def digits(body: Column) -> Column:
        dot = F.replace(body, F.lit(","), F.lit("."))
        return (
            F.when(body.rlike(AMOUNT_PLAIN), body)
            .when(body.rlike(AMOUNT_DOT_GROUPS), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(body.rlike(AMOUNT_COMMA_GROUPS), F.replace(body, F.lit(","), F.lit("")))
            .when(body.rlike(AMOUNT_BLANK_GROUPS), F.replace(dot, F.lit(" "), F.lit("")))
            .when(body.rlike(AMOUNT_DECIMAL), dot)
            .try_cast("double")
        )

    def signed(t: Column) -> Column:
        return F.when(t.rlike("^[−-]"), -1.0).otherwise(1.0) * let(F.btrim(F.regexp_replace(t, "^[+−-] *", "")), digits)

    return let(s, signed)


def read_date(c: Column) -> Column:
    """Calendar date that a cell's text names, else null.

    Y-M-D, Y/M/D, D.M.Y or D/M/Y, with or without a time. A day that does not
    exist gives null.
    """

    def read(s: Column) -> Column:
        same = s.rlike(r"^([0-9]+-[0-9]+-|[0-9]+/[0-9]+/|[0-9]+[.][0-9]+[.])")
        marks = F.regexp_extract(s, r"^([0-9./-]+)", 1)
        part = F.split(marks, "[./-]")
        y, m, d = part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")
        iso = F.when(s.rlike(DATE_YMD), F.concat_ws("-", y, m, d)).when(s.rlike(DATE_DMY), F.concat_ws("-", part[2], m, F.lpad(y, 2, "0")))
        return F.when(same, iso).try_cast("date")

    return let(strip(c), read)
