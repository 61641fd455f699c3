"""Text expressions with Unicode white space and offsets in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as white space when text is stripped or split into words.
SPACE = r"[\s\x1c-\x1f\x85]"


def strip(col: Column) -> Column:
    """Text without outer white space of any kind."""
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def words(col: Column) -> Column:
    """Words between white space; no empty words."""
    return F.filter(F.split(col, rf"(?U){SPACE}+"), lambda w: w != "")


def label(col: Column) -> Column:
    """Normal form of a surface as a concept label."""
    return F.lower(strip(col))


def chars(col: Column) -> Column:
    """Code points of a text."""
    return F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0))


def window_text(text: Column, start: Column, end: Column, margin: int = 40) -> Column:
    """Text from ``margin`` characters before ``start`` to ``margin`` after ``end``."""
    low = F.greatest(start - margin, F.lit(0))
    return F.substring(text, low + 1, end + margin - low)
