"""Ordered rules, the first of which that holds gives label, reason and confidence together; and checks on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str, str, int]


def cascade(rules: list[Rule], otherwise: tuple[str, str, int]) -> Column:
    """struct(label, reason, confidence) of the first rule (condition, label, reason, confidence) that is true."""
    verdict = lambda v: F.struct(F.lit(v[0]).alias("label"), F.lit(v[1]).alias("reason"), F.lit(v[2]).alias("confidence"))
    out = None
    for condition, *v in rules:
        out = F.when(condition, verdict(v)) if out is None else out.when(condition, verdict(v))
    return out.otherwise(verdict(otherwise)) if out is not None else verdict(otherwise)


def reject_reasons(checks: dict[str, Column]) -> Column:
    """Names of all failed checks, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def invariants(df: DataFrame, checks: list[tuple[str, Column, int | None, int | None, str]]) -> DataFrame:
    """(check_name, found, status) of (name, filter, least, most, severity): one pass over the table counts them all."""
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c, *_) in enumerate(checks)])
    rows = []
    for i, (name, _, low, high, severity) in enumerate(checks):
        n = F.col(f"c{i}")
        bad = (n < low if low is not None else F.lit(False)) | (n > high if high is not None else F.lit(False))
        rows.append(F.struct(F.lit(name).alias("check_name"), n.alias("found"), F.when(bad, severity).otherwise("PASS").alias("status")))
    return counted.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, known, share) per column, in one pass."""
    kinds = dict(df.dtypes)
    known = lambda c: F.count(F.nullif(F.trim(F.col(c)), F.lit("")) if kinds[c] == "string" else F.col(c))
    g = df.agg(F.count(F.lit(1)).alias("n"), *[known(c).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("known"), F.round(F.col(c) / F.greatest("n", F.lit(1)), 4).alias("share")) for c in columns]
    return g.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
