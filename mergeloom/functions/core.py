"""Column helpers used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(c: Column | str) -> Column:
    """Trimmed string, blank as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def zip5(c: Column | str) -> Column:
    """First five characters of the trimmed value, blank as null."""
    return F.substring(nz(c), 1, 5)


def phone10(c: Column | str) -> Column:
    """Digits without the leading 1 of eleven; null unless ten remain."""
    d = digits(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def hash_all(*cols: Column) -> Column:
    """64-bit hash in which a null differs from every value and from its neighbour's null."""
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols])
