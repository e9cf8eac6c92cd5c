"""Vendor files: loosely named headers, unknown encodings, lines before the header, wide sheets, JSON tables."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.fuzzy import indel

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")


def decode(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The text in the first encoding that reads it."""
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1", "replace")


def _plain(s: str) -> str:
    return " ".join(sorted(re.findall("[a-z0-9]+", s.lower())))


def map_headers(headers: list[str], wanted: dict[str, list[str]], least: float = 80) -> dict[str, str]:
    """Canonical name -> header: exact names first, then the most similar of its synonyms; each header serves once."""
    free, out = list(headers), {}
    for exact in (True, False):
        for name, synonyms in wanted.items():
            if name in out:
                continue
            scored = [(100.0 if _plain(h) == _plain(s) else 0.0 if exact else indel(_plain(h), _plain(s)), -i, h) for i, h in enumerate(free) for s in [name, *synonyms]]
            if scored and max(scored)[0] >= least:
                out[name] = max(scored)[2]
                free.remove(out[name])
    return out


def header_row(rows: list[list[str]], wanted: dict[str, list[str]], most: int = 20) -> int:
    """The row among the first ones that maps most columns; the first such row on ties."""
    return max(range(min(most, len(rows))), key=lambda i: (len(map_headers(rows[i], wanted)), -i), default=0)


def _records(raw: bytes, wanted: dict[str, list[str]]) -> Iterator[list[str | None]]:
    rows = list(csv.reader(io.StringIO(decode(raw))))
    if not rows:
        return
    at = header_row(rows, wanted)
    names = [h.strip() for h in rows[at]]
    place = {k: names.index(h) for k, h in map_headers(names, wanted).items()}
    for r in rows[at + 1 :]:
        if any(x.strip() for x in r):
            yield [(r[place[k]].strip() or None) if k in place and place[k] < len(r) else None for k in wanted]


def read_vendor(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Delimited files as strings under canonical names, with the file's name.

    Each file finds its own encoding, header row and mapping; a file is read by one task, as vendors' exports are
    small against a split. Columns that no header matches are null; files without rows give none.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(_records(raw, wanted))
                cols = [pa.array([name] * len(rows), pa.string())] + [pa.array([r[i] for r in rows], pa.string()) for i in range(len(wanted))]
                yield pa.RecordBatch.from_arrays(cols, ["file", *wanted])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, ", ".join(f"`{c}` string" for c in ["file", *wanted]))


def registry_csv(spark: SparkSession, path: str, slots: str, prefix: str, zips: DataFrame | None = None) -> DataFrame:
    """A registry's CSV: headers trimmed, rows kept if any numbered slot column starts with the prefix, in scope by ZIP.

    Adds first_slot, the first such slot's value. zips: a table of ZIPs in scope, one column.
    """
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    values = F.filter(F.array(*[F.trim(F.col(f"`{c}`")) for c in df.columns if re.fullmatch(re.escape(slots) + r"_?\d+", c)]), lambda x: x.startswith(prefix))
    df = df.withColumn("first_slot", F.try_element_at(values, F.lit(1))).filter("first_slot is not null")
    if zips is None:
        return df
    zip_column = next(c for c in df.columns if "postal" in c.lower() or "zip" in c.lower())
    return df.join(zips.toDF("__zip"), F.substring(F.trim(F.col(f"`{zip_column}`")), 1, 5) == F.col("__zip"), "left_semi")


def json_table(spark: SparkSession, path: str, sentinels: list[str]) -> DataFrame:
    """A JSON array of arrays whose first is the header, as strings; sentinel values are null."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<array<string>>").alias("r"))
    head = rows.select(F.col("r")[0]).first()
    names = head[0] if head and head[0] else []
    body = rows.select(F.explode(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(1)))).alias("x"))
    return body.select(*[F.when(~F.get("x", F.lit(i)).isin(sentinels), F.get("x", F.lit(i))).alias(n) for i, n in enumerate(names)])


def long_form(df: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    """One row per id and other column."""
    rest = [c for c in df.columns if c not in ids]
    return df.unpivot(ids, rest, name, value)


def workbook(raw: bytes) -> dict[str, list[list[str | None]]]:
    """Sheets of an XLSX file as rows of texts; merged cells repeat their value."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
    out = {}

    def at(ref: str) -> tuple[int, int]:
        letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
        col = 0
        for ch in letters:
            col = col * 26 + ord(ch) - 64
        return int(row) - 1, col - 1

    for i, name in enumerate(names, 1):
        root, cells = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")), {}
        for c in root.iter(f"{{{ns['m']}}}c"):
            v, inline = c.find("m:v", ns), c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else v.text if v is not None else None
            cells[at(c.get("r"))] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        for m in root.iter(f"{{{ns['m']}}}mergeCell"):
            (r0, c0), (r1, c1) = map(at, m.get("ref").split(":"))
            for r in range(r0, r1 + 1):
                for k in range(c0, c1 + 1):
                    cells[r, k] = cells.get((r0, c0))
        high, wide = (max((p[j] for p in cells), default=-1) + 1 for j in (0, 1))
        out[name] = [[cells.get((r, k)) for k in range(wide)] for r in range(high)]
    return out
