"""Similarity of strings by longest common subsequence (normalised Indel similarity, 0 to 100)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is one integer of len(a) bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2*LCS / (length + length); null if either is null, 100 for two empty strings."""
    return pd.Series([indel(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sort(c: Column) -> Column:
    """Words sorted and joined by one space."""
    return F.array_join(F.sort_array(F.array_remove(F.split(F.trim(c), r"\s+"), "")), " ")


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only where the ratio cannot reach `least`: Levenshtein distance never exceeds Indel distance."""
    room = F.floor((100 - least) / 100 * (F.length(a) + F.length(b)))
    return (F.abs(F.length(a) - F.length(b)) <= room) & (F.levenshtein(a, b) <= room)
