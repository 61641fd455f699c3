"""Pieces shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(col: Column) -> Column:
    """Text "spelling aside": outer spaces off, runs of spaces to one, lower case; empty becomes null."""
    text = F.lower(F.regexp_replace(F.trim(col), " +", " "))
    return F.when(text != "", text)


def n_records(df: DataFrame, key: str) -> Column:
    """Number of distinct non-null ids as a scalar subquery: one number, computed where the data is."""
    return df.agg(F.count_distinct(key)).scalar()
