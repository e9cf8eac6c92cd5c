"""Pages to rows: structured data, tables, links, sections."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Page(HTMLParser):
    """Tables, structured-data scripts, and text blocks under their headings, in one pass over a page."""

    BLOCKS, HEADS = {"p", "li", "td"}, {"h1", "h2", "h3", "h4"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.scripts: list[str] = []
        self.sections: list[tuple[str, str]] = []
        self.cell: list[str] | None = None
        self.script: list[str] | None = None
        self.block: list[str] | None = None
        self.heading = ""
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.cell = []
        elif tag == "script" and dict(attrs).get("type") == "application/ld+json":
            self.script = []
        if tag in self.BLOCKS or tag in self.HEADS:
            self.block = []

    def handle_endtag(self, tag):
        text = lambda parts: " ".join("".join(parts).split())
        if tag in ("td", "th") and self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(text(self.cell))
            self.cell = None
        elif tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None
        if self.block is not None and (tag in self.BLOCKS or tag in self.HEADS):
            if tag in self.HEADS:
                self.heading = text(self.block)
            elif text(self.block):
                self.sections.append((self.heading, text(self.block)))
            self.block = None

    def handle_data(self, data):
        for sink in (self.cell, self.script, self.block):
            if sink is not None:
                sink.append(data)


def page(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


def places(node: object) -> Iterator[dict]:
    """Every object with an address, at any depth of structured data."""
    if isinstance(node, list):
        for x in node:
            yield from places(x)
    elif isinstance(node, dict):
        if isinstance(node.get("address"), dict):
            yield node
        for k, v in node.items():
            if k != "address":
                yield from places(v)


def place_rows(html: str | None) -> Iterator[tuple[str | None, ...]]:
    text = lambda x: str(x).strip() or None if isinstance(x, (str, int, float)) else None
    for script in page(html).scripts:
        try:
            data = json.loads(script)
        except ValueError:
            continue
        for o in places(data):
            a = o["address"]
            kind = o.get("@type")
            yield text(kind[0] if isinstance(kind, list) and kind else kind), text(o.get("name")), text(a.get("streetAddress")), text(a.get("addressLocality")), text(a.get("addressRegion")), text(a.get("postalCode")), text(o.get("telephone"))


def table_rows(html: str | None) -> Iterator[tuple[str | None, ...]]:
    for t, rows in enumerate(page(html).tables):
        for r, cells in enumerate(rows):
            for c, text in enumerate(cells):
                yield str(t), str(r), str(c), rows[0][c] if r and rows and c < len(rows[0]) else None, text


def section_rows(html: str | None) -> Iterator[tuple[str | None, ...]]:
    yield from page(html).sections


def parsed_pages(pages: DataFrame, key: str, html: str, columns: list[str], rows: Callable[[str | None], Iterator[tuple]]) -> DataFrame:
    """(key, columns..) from each page; broken pages give what could be read, null pages nothing."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in rows(h) if h else ():
                    keys.append(k)
                    out.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *[pa.array([r[i] for r in out], pa.string()) for i in range(len(columns))]], [key, *columns])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(parse, f"`{key}` {kind}, " + ", ".join(f"`{c}` string" for c in columns))


PLACE_COLUMNS = ["kind", "name", "address", "city", "state", "zip", "phone"]
TABLE_COLUMNS = ["table_no", "row_no", "column_no", "header", "value"]
SECTION_COLUMNS = ["heading", "block"]


def links(html: Column) -> Column:
    """Targets of all links, in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'#]+)"""), F.lit(1)))


def us_addresses(text: Column) -> Column:
    """Addresses 'number street, city, ST zip' in running text."""
    return F.regexp_extract_all(text, F.lit(r"(\d{1,6} [A-Z0-9][A-Za-z0-9 .#-]+, [A-Z][A-Za-z .-]+, [A-Z]{2},? \d{5})"), F.lit(1))
