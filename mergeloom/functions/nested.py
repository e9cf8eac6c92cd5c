"""Lists, people and documents in JSON columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.functions.core import nz


def json_list(c: Column) -> Column:
    """Texts of a JSON list; anything else gives its quoted parts, or an empty list."""
    parsed = F.from_json(c, "array<string>")
    loose = F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))
    return F.coalesce(F.when(c.rlike(r"^\s*\["), parsed), loose, F.array().cast("array<string>"))


def people(c: Column) -> Column:
    """Distinct people of a JSON list of {first, last, title}, order kept; without a last name there is none."""
    p = F.from_json(c, "array<struct<first:string,last:string,title:string>>")
    clean = F.transform(p, lambda x: F.struct(nz(x["first"]).alias("first"), nz(x["last"]).alias("last"), nz(x["title"]).alias("title")))
    return F.coalesce(F.array_distinct(F.filter(clean, lambda x: x["last"].isNotNull())), F.array().cast("array<struct<first:string,last:string,title:string>>"))


def slots(columns: list[list[str]], names: list[str]) -> Column:
    """Numbered slot columns as a list of structs, empty slots left out; columns: one list per slot, in the order of names."""
    rows = [F.when(F.coalesce(*[nz(c) for c in cs]).isNotNull(), F.struct(*[nz(c).alias(n) for c, n in zip(cs, names)])) for cs in columns]
    return F.array_distinct(F.array_compact(F.array(*rows)))


def union_by(a: Column, b: Column, field: str) -> Column:
    """Elements of a, then those of b whose field a does not have."""
    have = F.transform(a, lambda x: x[field])
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(have, x[field])))


def document_text(c: Column) -> Column:
    """The JSON object inside a longer text, if it can be read."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def path(c: Column, p: str, kind: str = "string") -> Column:
    """A value of a JSON text, null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(c), p, kind)


def self_named(parent: Column, name: Column) -> Column:
    """Whether a parent is only the firm itself: contained in the name, or all its words are."""
    p, n = F.lower(F.trim(parent)), F.lower(F.trim(name))
    left = F.array_except(F.regexp_extract_all(p, F.lit("([a-z0-9]+)"), F.lit(1)), F.regexp_extract_all(n, F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.contains(n, p) | F.contains(p, n) | (F.size(left) == 0)


def _merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _merged(a.get(k), b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    if isinstance(a, list) and isinstance(b, list):
        return a + [x for x in b if x not in a]
    if isinstance(a, str) and isinstance(b, str):
        return b if b.strip() else a
    return a if b is None else b


def merge_documents(df: DataFrame, key: str, order: str, doc: str) -> DataFrame:
    """(key, doc): all JSON documents of a key merged in order: objects field by field, lists united, a known later value wins.

    A blank text never replaces one that is not. What cannot be read as JSON is left out. Documents are merged as they
    are read, first within each batch of rows and then batch by batch, so that a key of many documents is not gathered.
    Rows with a null key are left out; repeated documents change nothing.
    """
    def whole(texts) -> str | None:
        out = None
        for text in texts:
            try:
                out = _merged(out, json.loads(text))
            except (TypeError, ValueError):
                continue
        return None if out is None else json.dumps(out, ensure_ascii=False)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, g["o"].min(), whole(g.sort_values("o")["d"])) for k, g in batch.groupby("k", sort=False)]
            yield pd.DataFrame([r for r in rows if r[2] is not None], columns=["k", "o", "d"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("x"), F.col(doc).alias("d")).filter("k is not null and d is not null")
    rows = rows.withColumn("o", F.row_number().over(Window.partitionBy("k").orderBy("x"))).select("k", "o", "d")
    some = rows.mapInPandas(fold, f"k {kind}, o int, d string")
    return some.groupBy("k").applyInPandas(lambda g: next(fold(iter([g]))), f"k {kind}, o int, d string").select(F.col("k").alias(key), F.col("d").alias(doc))
