"""Small building blocks shared by the expression modules."""

from __future__ import annotations

import re
import string
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase
WS = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only; accented capitals stay as they are."""
    return F.translate(col(c), UPPER, LOWER)


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Words joined by single spaces (Unicode white space)."""
    return F.trim(F.regexp_replace(col(c), WS, " "))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def non_empty(c: Column | str) -> Column:
    """NULL instead of an empty string."""
    return F.nullif(col(c), F.lit(""))


def literal_pattern(words: list[str]) -> str:
    """One alternation that matches any of the words literally."""
    return "|".join(re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", w) for w in words)


def contains_any(c: Column | str, words: list[str]) -> Column:
    return col(c).rlike(literal_pattern(words))


def contains_any_folded(c: Column | str, words: list[str]) -> Column:
    """``contains_any`` on the ASCII-lowered text, for words without A-Z.

    Lowering all letters keeps every hit, so the words are searched for there one by one; the pattern, which is slow on
    long texts, is left to the texts that have one of them."""
    c, each = col(c), F.array(*[F.lit(w) for w in words])
    # the lambda variable keeps the lowered text for all words
    some = F.get(F.transform(F.array(F.lower(c)), lambda t: F.exists(each, lambda w: t.contains(w))), F.lit(0))
    return F.when(some, c.rlike("(?i)" + literal_pattern(words))).when(c.isNotNull(), F.lit(False))


def lookup(c: Column | str, table: dict, default=None) -> Column:
    """CASE ladder from a small literal table."""
    c = col(c)
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def as_of_lit(as_of: datetime) -> Column:
    """A wall-clock literal; compares with both timestamp types."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def hours_before(as_of: datetime, hours: float) -> Column:
    return as_of_lit(as_of - timedelta(hours=hours))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
