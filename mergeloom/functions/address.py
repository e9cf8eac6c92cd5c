"""Named address normalisers. Results depend on which one a query uses, so each keeps its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergeloom.functions.core import nz

# Street words and their short forms.
SHORT = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "CIRCLE": "CIR",
    "PLACE": "PL", "SQUARE": "SQ", "TERRACE": "TER", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "NORTH": "N", "SOUTH": "S", "EAST": "E",
    "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
SUITE = r"[ ,]+(SUITE|STE|UNIT|APT|ROOM|RM|FLOOR|FL|BLDG|#)[ .#]*[A-Z0-9-]*.*$"


def _mapped(c: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(m[w], w)), " ")


def street_key(c: Column) -> Column:
    """Upper case, marks dropped, suite cut off, street words shortened; null if blank."""
    up = F.regexp_replace(F.upper(nz(c)), r"[.]", "")
    bare = F.regexp_replace(up, SUITE, "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, "[^A-Z0-9 ]", " "), " +", " "))
    return F.nullif(_mapped(plain, SHORT), F.lit(""))


def long_street(c: Column) -> Column:
    """Lower case with street words written out, suite kept."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(nz(c)), "[.,]", ""), " +", " "))
    return F.nullif(_mapped(plain, {v.lower(): k.lower() for k, v in SHORT.items()}), F.lit(""))


def house_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "^ *([0-9]+)", 1), F.lit(""))


def street_core(c: Column, n: int = 3) -> Column:
    """The first words of the street key."""
    return F.array_join(F.slice(F.split(street_key(c), " "), 1, n), " ")


def xref_key(address: Column, zip_: Column) -> Column:
    """House number, ZIP and the first six letters of the street."""
    letters = F.substring(F.regexp_replace(street_key(address), "[^A-Z]", ""), 1, 6)
    return F.concat_ws("|", F.coalesce(house_number(address), F.lit("")), F.substring(nz(zip_), 1, 5), letters)


def location_id(address: Column, zip_: Column) -> Column:
    """Stable id of a place: 16 hex digits of the SHA-1 of street key and ZIP."""
    return F.substring(F.sha1(F.concat_ws("|", street_key(address), F.substring(nz(zip_), 1, 5)).cast("binary")), 1, 16)


def before_markers(c: Column, markers: list[str]) -> Column:
    """Upper case, cut at the first place of each marker in turn."""
    out = F.upper(c)
    for m in markers:
        out = F.substring_index(out, m, 1)
    return F.trim(out)


def letters_digits(c: Column) -> Column:
    """Upper case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9 ]", " "), " +", " "))


def without_suite(c: Column) -> Column:
    """Like `letters_digits`, from a word for a suite on cut off."""
    return letters_digits(F.regexp_replace(F.upper(c), "[ ,]+(SUITE|STE|UNIT|APT|ROOM|RM|FLOOR|FL|BLDG|#).*$", ""))


def squeezed(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")


def number_word(c: Column) -> Column:
    """House number and the word after it, '' if there are none."""
    return F.regexp_extract(F.upper(F.trim(c)), "^([0-9]+ +[A-Z0-9]+)", 1)


def sorted_words(c: Column) -> Column:
    """Distinct words in order of the alphabet."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(letters_digits(c), " "))), " ")


def raw_key(c: Column, zip_: Column) -> Column:
    """The address as written, trimmed and lower-cased, with the ZIP."""
    return F.concat(F.lower(F.trim(c)), F.lit("|"), F.coalesce(F.substring(nz(zip_), 1, 5), F.lit("")))


def one_line(c: Column) -> Column:
    """struct(street, town, st, zip5) of an address in one line, nulls if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(c, "^ *([0-9]+[^,]*), *([^,]+), *([A-Z]{2}) +([0-9]{5})", i), F.lit(""))
    return F.struct(part(1).alias("street"), part(2).alias("town"), part(3).alias("st"), part(4).alias("zip5"))
