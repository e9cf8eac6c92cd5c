"""Text functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergeloom.functions.core import nz


def ascii_quotes(c: Column) -> Column:
    """Curly quotes, dashes and hard spaces as ASCII."""
    return F.translate(c, "‘’“”–— ", "''\"\"-- ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def any_word(words: list[str]) -> str:
    """A pattern that finds any of the words or phrases as a whole."""
    return r"(^|[^A-Za-z0-9])(" + "|".join(re.escape(w) for w in words) + r")([^A-Za-z0-9]|$)"


def title_case(c: Column, upper: list[str], lower: list[str]) -> Column:
    """Each word capitalised; some words stay upper case, some lower case unless they come first."""
    up, low = F.array(*[F.lit(w) for w in upper]), F.array(*[F.lit(w) for w in lower])

    def word(w: Column, i: Column) -> Column:
        l = F.lower(w)  # noqa: E741
        return F.when(F.array_contains(up, F.upper(w)), F.upper(w)).when((i > 0) & F.array_contains(low, l), l).otherwise(F.concat(F.upper(F.substring(l, 1, 1)), F.substring(l, F.lit(2), F.length(l))))

    return F.array_join(F.transform(F.split(collapse(c), " "), word), " ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def brand_key(c: Column, stop: list[str]) -> Column:
    """Distinctive words of a name in order, null if none is left."""
    kept = F.filter(words(c), lambda w: (F.length(w) > 1) & ~F.array_contains(F.array(*[F.lit(s) for s in stop]), w))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def slug(c: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def sentences(c: Column) -> Column:
    """Sentences of a text; a stop after a common short form or a single capital does not end one."""
    guarded = F.regexp_replace(c, r"\b(Dr|Mr|Mrs|Ms|St|Inc|Ltd|Co|Jr|Sr|No|[A-Z])\.", "$1\u0001")
    parts = F.split(guarded, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def sorted_set(c: Column, separator: str) -> Column:
    """A joined set in canonical form: trimmed, distinct, sorted."""
    parts = F.filter(F.transform(F.split(c, re.escape(separator)), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), separator)


def sentinel_null(c: Column, sentinels: list[str]) -> Column:
    return F.when(~F.lower(nz(c)).isin([s.lower() for s in sentinels]), nz(c))


def host(url: Column) -> Column:
    """Host of an http(s) address without www, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(url)), r"^https?://(www\.)?([^/:?#]+)", 2), F.lit(""))


def debug_line(cols: list[str], most: int = 2000) -> Column:
    """All non-null columns as 'name: value | name: value'."""
    return F.substring(F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cols]), 1, most)


def is_person(c: Column) -> Column:
    """Whether a name is a person's: it has a doctor's title and no word of a firm."""
    n = collapse(c)
    titled = n.rlike(r"(DDS|DMD|dds|dmd)\.?$|^(Dr|DR|dr)\.? ")
    return titled & ~F.lower(n).rlike("dental|dentistry|care|group|clinic|center|studio|associates|smile|ortho|&")


def surname(c: Column) -> Column:
    """The last word of a name without titles."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(collapse(c), r"^(Dr|DR|dr)\.? ", ""), r"[, ]+(DDS|DMD|dds|dmd|Jr|JR|MD)\.?$", ""))
    return F.nullif(F.regexp_extract(bare, "([A-Za-z'-]+)$", 1), F.lit(""))


def with_note(c: Column, note: Column, marker: str) -> Column:
    """The text with a note at its end, unless it holds the note's marker already."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(text, note))


def http_url(c: Column) -> Column:
    """A trimmed http(s) address with a host; a missing scheme before 'www.' is put in, anything else is null."""
    t = F.trim(c)
    t = F.when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)
    return F.when(t.rlike(r"^(?i)https?://[a-z0-9-]+(\.[a-z0-9-]+)+([/:?#].*)?$"), t)
