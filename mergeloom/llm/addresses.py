"""Postal addresses that denote the same building.

An address is parsed into house number, direction, street name, street type and unit. Street names become vectors of
weighted character bigrams. Addresses meet through inverted lists keyed by house number, place and the rarest bigrams
of the name (prefix filter: what is left out of both prefixes cannot reach the threshold), and are verified by cosine
and by the parts that were given on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.core import nz
from mergeloom.operators.pairs import linked_member_pairs, member_pairs
from mergeloom.session import Scratch

# Fixed values of United States postal writing.
DIRECTIONS = {
    "N": "N", "NORTH": "N", "S": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W", "NE": "NE", "NORTHEAST": "NE",
    "NW": "NW", "NORTHWEST": "NW", "SE": "SE", "SOUTHEAST": "SE", "SW": "SW", "SOUTHWEST": "SW",
}
TYPES = {
    "ALLEY": "ALY", "ALY": "ALY", "AVENUE": "AVE", "AVE": "AVE", "AV": "AVE", "BOULEVARD": "BLVD", "BLVD": "BLVD", "CIRCLE": "CIR", "CIR": "CIR",
    "COURT": "CT", "CT": "CT", "DRIVE": "DR", "DR": "DR", "EXPRESSWAY": "EXPY", "EXPY": "EXPY", "LANE": "LN", "LN": "LN", "LOOP": "LOOP",
    "PARKWAY": "PKWY", "PKWY": "PKWY", "PLACE": "PL", "PL": "PL", "PLAZA": "PLZ", "PLZ": "PLZ", "ROAD": "RD", "RD": "RD", "ROW": "ROW",
    "SQUARE": "SQ", "SQ": "SQ", "STREET": "ST", "ST": "ST", "STR": "ST", "TERRACE": "TER", "TER": "TER", "TRAIL": "TRL", "TRL": "TRL",
    "WAY": "WAY", "WY": "WAY",
}
QUALIFIERS = {"SAINT": "SAINT", "ST": "SAINT", "FORT": "FORT", "FT": "FORT", "MOUNT": "MOUNT", "MT": "MOUNT", "LAKE": "LAKE", "LK": "LAKE", "OLD": "OLD"}
ORDINALS = {
    w: str(i)
    for i, w in enumerate(
        "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH TWENTIETH".split(), 1
    )
}
_UNIT = re.compile(r"(?:^|\s)(?:(?:SUITE|STE|UNIT|ROOM|RM|APT|APARTMENT|BLDG|BUILDING|FLOOR|FL|DEPT|SPACE|SPC)\b\.?\s*#?\s*([A-Z0-9-]*)|#\s*([A-Z0-9-]+)|(\d+)(?:ST|ND|RD|TH)\s+(?:FLOOR|FL)\b).*$|\s(?:REAR|FRONT|LOBBY|BASEMENT|BSMT|PENTHOUSE)$")
_STREET = re.compile(r"^\s*(\d+)([A-Z]?)(?:\s*-\s*\d+)?(?:\s+1/2)?\s+(\S.*)$")
_ROUTE = re.compile(r"^(?:(STATE|ST|S|COUNTY|CO|C|US|U S)?\s*(HIGHWAY|HWY|ROUTE|RTE|RT|ROAD|RD)|(SR|CR|CH|SH|US))\s*(\d+)\b(.*)$")
_NTH = re.compile(r"^(\d+)(?:ST|ND|RD|TH)$")


def one_edit(a: str, b: str) -> bool:
    """Equal up to one insertion, deletion, substitution or swap of neighbours."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x == y or x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _ordinal(word: str) -> str | None:
    if m := _NTH.match(word):
        return str(int(m[1]))
    if word in ORDINALS:
        return ORDINALS[word]
    if len(word) >= 5 and word.isalpha():
        near = [n for o, n in ORDINALS.items() if one_edit(word, o)]
        return near[0] if len(near) == 1 else None
    return None


def parse_address(text: str | None) -> tuple[str, str, str, str, str]:
    """(number, direction, name, type, unit), '' where not given; a range goes by its first number."""
    s = re.sub(r"\s+", " ", (text or "").upper().replace(".", " ").replace("’", "'")).strip()
    unit, number, street = "", "", ""
    for part in s.split(","):
        part = part.strip()
        if m := _UNIT.search(part):
            unit = unit or m[1] or m[2] or (f"FL{m[3]}" if m[3] else m[0].strip())
            part = part[: m.start()].strip()
        if not street and (m := _STREET.match(part)):
            number, street = m[1].lstrip("0") or "0", m[3]
            number += m[2]
    if not street:  # no part starts with a number: one may follow a building's name
        bare = _UNIT.sub("", s.split(",")[0])
        m = re.search(r"(?:^|\s)(\d+)(?:-\d+)?\s+(\S.*)$", bare)
        number, street = (m[1], m[2]) if m else ("", bare)
    words = re.findall(r"[A-Z0-9']+", street)
    direction = kind = ""
    if len(words) > 1 and words[0] in DIRECTIONS and not (len(words) == 2 and words[1] in TYPES and not _NTH.match(words[1])):
        direction = DIRECTIONS[words.pop(0)]
    if len(words) > 1 and words[-1] in DIRECTIONS:
        direction = direction or DIRECTIONS[words[-1]]
        words.pop()
    if m := _ROUTE.match(" ".join(words)):
        head = "STATE ROUTE" if m[3] in ("SR", "SH") or m[1] in ("STATE", "ST", "S") else "COUNTY ROAD" if m[3] in ("CR", "CH") or m[1] in ("COUNTY", "CO", "C") else "HIGHWAY"
        if head != "HIGHWAY" or m[2] not in ("ROAD", "RD"):
            tail = m[5].split()
            if tail and tail[-1] in DIRECTIONS:
                direction = direction or DIRECTIONS[tail[-1]]
            return number, direction, f"{head} {int(m[4])}", "", unit
    if len(words) > 1 and words[-1] in TYPES:
        kind = TYPES[words.pop()]
    if len(words) > 1 and words[0] in QUALIFIERS:
        words[0] = QUALIFIERS[words[0]]
    words = [(f"{n}TH" if (n := _ordinal(w)) else w) for w in words]
    return number, direction, " ".join(words), kind, unit


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        parts = list(zip(*map(parse_address, texts), strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p, pa.string()) for p in parts]], ["address", "number", "dir", "name", "type", "unit"])


def parsed(addresses: DataFrame, column: str) -> DataFrame:
    """(address, number, dir, name, type, unit) of every distinct non-blank address."""
    texts = addresses.select(F.col(f"`{column}`").alias("address")).filter(nz("address").isNotNull()).distinct()
    return texts.mapInArrow(_parse, "address string, number string, dir string, name string, type string, unit string")


def letters(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z]", ""), F.lit(""))


def grams(name: Column) -> Column:
    """Distinct character bigrams of the name with its ends marked."""
    marked = F.concat(F.lit("^"), name, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2))))


def alike(a: str, b: str) -> Column:
    """Parts that are equal where both are given."""
    return F.col(a).eqNullSafe(F.col(b)) | (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")


def near_text(a: Column, b: Column, share: float = 0.25) -> Column:
    """Both given and at most this share of the letters edited."""
    far = F.floor(F.greatest(F.length(a), F.length(b)) * share + 0.5)
    return F.coalesce(F.levenshtein(a, b) <= far, F.lit(False))


def same_place(s: str, t: str) -> Column:
    """Same ZIP and no plainly different city, or same city and state; states must agree where given."""
    c = lambda n, x: F.col(f"{n}{x}")
    zips, cities = c("zip", s) == c("zip", t), near_text(c("city", s), c("city", t))
    unknown = (c("zip", s).isNull() | c("zip", t).isNull()) & (c("city", s).isNull() | c("city", t).isNull())
    states = c("state", s) == c("state", t)
    return F.coalesce(zips, F.lit(False)) | (cities & alike(f"state{s}", f"state{t}")) | (unknown & F.coalesce(states, F.lit(False)))


def _weights(classes: DataFrame, cap: float) -> DataFrame:
    """(id, vector, prefix sources): bigrams with capped inverse document frequencies, unit length, rarest first."""
    split = classes.select("id", "name", F.explode(grams(F.col("name"))).alias("g"))
    total = classes.count()
    weight = F.least(F.log(1 + F.lit(total) / F.count(F.lit(1))), F.lit(cap))
    df = split.groupBy("g").agg(F.count(F.lit(1)).alias("df"), weight.alias("w"))
    vec = split.join(df, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "g", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return vec.withColumn("norm", norm).select("id", F.transform("v", lambda x: F.struct(x["g"].alias("g"), (x["w"] / F.col("norm")).alias("w"))).alias("v"))


def same_building(rows: DataFrame, key: str, address: str, city: str, state: str, zip_: str, cosine: float = 0.25, sure: float = 0.42, cap: float = 5.3) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of rows at the same street building.

    House numbers must be equal (a range goes by its first number); direction and street type must be equal where both
    are given; units do not matter; street names must reach the cosine (below `sure`, where both may be mistyped, with
    less than half of the letters edited), and numbers in them must be equal. Places agree by ZIP, or by city (up to typing errors) where a ZIP is missing or wrong. Rows with a null key or a blank
    address match nothing; an address without a house number matches only the same words in the same ZIP. Repeated
    rows change nothing. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession)
    c = lambda n: F.col(f"`{n}`")
    r = rows.select(
        c(key).cast("string").alias("k"), c(address).alias("address"), letters(c(city)).alias("city"), letters(c(state)).alias("state"),
        F.substring(F.nullif(F.regexp_replace(c(zip_), "[^0-9]", ""), F.lit("")), 1, 5).alias("zip"),
    ).filter(F.col("k").isNotNull() & nz("address").isNotNull())
    kind = ["number", "dir", "name", "type", "zip", "city", "state"]
    full = r.join(parsed(rows, address), "address").select("k", *kind)
    members = scratch.cut(full.select("k", F.xxhash64(*[F.coalesce(c, F.lit("\u0000")) for c in kind]).alias("id"), *kind))
    classes = scratch.cut(members.filter("name <> ''").groupBy("id").agg(*[F.first(c).alias(c) for c in kind]))
    vectors = _weights(classes.filter("number <> ''"), cap)

    # The tail that both prefixes may leave out: its squared weights stay below cosine squared.
    def longer(tail: Column, x: Column) -> Column:  # tail: [squared weights, length], closed by a negative first part
        more = tail[0] + x["w"] * x["w"]
        return F.when((tail[0] >= 0) & (more < cosine * cosine), F.array(more, tail[1] + 1)).otherwise(F.array(F.lit(-1.0), tail[1]))

    tail = F.aggregate(F.reverse("v"), F.array(F.lit(0.0), F.lit(0.0)), longer)
    prefix = F.transform(F.slice("v", F.lit(1), F.greatest(F.size("v") - tail[1].cast("int"), F.lit(1))), lambda x: x["g"])
    places = F.array_compact(F.array(F.concat(F.lit("z"), F.col("zip")), F.concat(F.lit("s"), F.col("state"))))
    known = scratch.cut(classes.join(vectors, "id"))
    keyed = known.select("id", "number", "state", places.alias("at"), F.explode(prefix).alias("g"))
    lists = scratch.cut(keyed.select("id", "number", "g", F.explode("at").alias("at")).select("id", F.xxhash64("number", "at", "g").alias("t")).distinct())
    met = lists.toDF("id_a", "t").join(lists.toDF("id_b", "t"), "t").filter("id_a < id_b").select("id_a", "id_b")
    # Addresses without a state meet all others by number and bigram alone.
    bare = keyed.select("id", F.col("state").isNull().alias("lost"), F.xxhash64("number", "g").alias("t")).distinct()
    lost = bare.filter("lost").select(F.col("id").alias("id_a"), "t")
    anywhere = lost.join(bare.select(F.col("id").alias("id_b"), "t"), "t").filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    met = met.unionByName(anywhere).distinct()
    a = known.select(*[F.col(x).alias(f"{x}_a") for x in ("id", *kind, "v")])
    b = known.select(*[F.col(x).alias(f"{x}_b") for x in ("id", *kind, "v")])
    pairs = met.join(a, "id_a").join(b, "id_b").filter((F.col("number_a") == F.col("number_b")) & alike("dir_a", "dir_b") & alike("type_a", "type_b") & same_place("_a", "_b"))
    other = F.map_from_entries("v_b")
    dot = F.aggregate("v_a", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(other, x["g"]), F.lit(0.0)))
    number_in = lambda x: F.regexp_extract(x, "([0-9]+)", 1)
    qualified = lambda x: F.regexp_extract(x, "^(SAINT|FORT|MOUNT|LAKE|OLD|HIGHWAY|STATE ROUTE|COUNTY ROAD) ", 1)
    pairs = pairs.withColumn("cos", dot).filter((number_in("name_a") == number_in("name_b")) & ((qualified("name_a") == qualified("name_b")) | (F.col("cos") >= 0.7)))
    spelt = (F.col("cos") >= sure) | near_text(F.col("name_a"), F.col("name_b"), 0.45)
    links = scratch.cut(pairs.filter((F.col("cos") >= cosine) & spelt).select(F.col("id_a").alias("ga"), F.col("id_b").alias("gb")))
    own = members.filter("name <> '' and (number <> '' or zip is not null)").select("id", F.col("k").alias(key)).distinct()
    return member_pairs(own, "id", key).unionByName(linked_member_pairs(links, own, "id", key)).distinct()
