"""Matching records of two sources without a common key: probabilistic linkage.

Several blocking passes propose pairs: equal telephones; equal house numbers within a ZIP or city; and names that can
reach a least score, found by their telling words, up to a typing error, within a ZIP, city or state. Each pair is
reduced to levels of agreement of name, telephone, address and place. Expectation-maximisation over the counts of level
patterns estimates how often matching and other pairs show each level; a pair's confidence is the posterior probability
that it matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.functions.core import phone10
from mergeloom.llm.addresses import letters, one_edit, parsed
from mergeloom.operators.pairs import split_join
from mergeloom.session import Scratch

#: Greatest share of right-hand names in which a word is rare, and from which on it tells nothing about a name.
RARE, COMMON = 0.0005, 0.01
#: Number of right-hand names up to which a word is rare however few names there are.
RARE_LEAST = 50
#: Name score that a pair must be able to reach to meet by its words in a common place of each kind. A state says little;
#: names that agree less are compared there only if a telephone or house number brings them together.
REACH = {"zip": 0.35, "city": 0.35, "state": 0.45}
#: Ratio of the bounds of the classes into which names fall by the weight of all their words.
CLASS = 1.5
#: Telephones that more right-hand records have than this share of them, and more than this number, belong to no one place.
SHARED_PHONE, SHARED_PHONE_LEAST = 0.0005, 50
FIELDS = ("name", "phone", "address", "place")
#: Levels of agreement of each field; level 0 is no agreement, the last level is missing.
LEVELS = {"name": 8, "phone": 3, "address": 6, "place": 5}


# Legal forms and joining words of English names, which tell nothing about them.
LEGAL_WORDS = ["llc", "inc", "pc", "pllc", "llp", "ltd", "pa", "corp", "co", "the", "and", "of", "at", "in", "by", "a", "p", "c", "s", "d", "l"]


@dataclass(frozen=True)
class Vocabulary:
    """What is known about the words of a field of business.

    drop: words that carry no name. long_forms: short form or synonym -> the word it stands for. Words of more than five
    letters in either are also recognised misspelt, if the misspelt word is no common word of the data itself.
    """

    drop: tuple[str, ...] = tuple(LEGAL_WORDS)
    long_forms: dict[str, str] = field(default_factory=dict)

    def spelt(self) -> dict[str, str]:
        """Longer words of which a misspelt word may be a form, and what it then stands for."""
        return {w: self.long_forms[w] for w in self.long_forms if len(w) > 5} | {w: w for w in self.long_forms.values() if len(w) > 5} | {w: "" for w in self.drop if len(w) > 5}


def name_words(name: Column, vocabulary: Vocabulary) -> Column:
    """Distinct words of a name in long form, without those that carry no name."""
    plain = F.regexp_replace(F.lower(name), "['’.]", "")
    words = F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), F.lit(1))
    if vocabulary.long_forms:
        longer = F.create_map(*[F.lit(x) for kv in vocabulary.long_forms.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(longer[w], w))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in vocabulary.drop]).cast("array<string>"))


def _prepared(df: DataFrame, cols: dict[str, object], vocabulary: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """(id, names, phone, number, dir, street, type, unit, zip, city, state) of a source; absent fields are null."""
    text = lambda f: F.col(f"`{cols[f]}`").cast("string") if cols.get(f) else F.lit(None).cast("string")
    names = F.filter(F.array(*[name_words(F.col(f"`{c}`"), vocabulary) for c in cols["names"]]), lambda n: F.size(n) > 0)
    phone = phone10(text("phone"))
    phone = F.when(~phone.rlike(r"^(\d)\1{9}$") & (F.substring(phone, 1, 3) != "000"), phone)
    out = df.select(
        F.col(f"`{cols['id']}`").alias("id"), names.alias("names"), phone.alias("phone"), text("address").alias("address"),
        F.substring(F.nullif(F.regexp_replace(text("zip"), "[^0-9]", ""), F.lit("")), 1, 5).alias("zip"), letters(text("city")).alias("city"), letters(text("state")).alias("state"),
    ).filter("id is not null")
    if not cols.get("address"):
        return out.withColumns({c: F.lit("") for c in ("number", "dir", "street", "type", "unit")}).drop("address")
    street = parsed(df, cols["address"]).withColumnRenamed("name", "street")
    return out.join(street, "address", "left").drop("address").fillna("", ["number", "dir", "street", "type", "unit"])


def _without_shared_phones(a: DataFrame, b: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the telephones of very many right-hand records as missing."""
    many = b.filter("phone is not null").groupBy("phone").agg(F.count(F.lit(1)).alias("n"))
    # Fewer than 1 / SHARED_PHONE telephones can exceed the share.
    many = F.broadcast(many.filter(F.col("n") > max(SHARED_PHONE * total, SHARED_PHONE_LEAST)).select("phone", F.lit(True).alias("shared")))
    drop = lambda x: x.join(many, "phone", "left").withColumn("phone", F.when(F.col("shared").isNull(), F.col("phone"))).drop("shared")
    return drop(a), drop(b)


def _keys(side: DataFrame) -> DataFrame:
    """(id, key): telephone, and house number within ZIP or city."""
    key = lambda kind, *parts: F.when(_all(parts), F.xxhash64(F.lit(kind), *parts))
    number = lambda k: F.when(F.col("number") != "", k)
    keys = F.array(key("p", F.col("phone")), number(key("zn", F.col("zip"), F.col("number"))), number(key("cn", F.col("city"), F.col("state"), F.col("number"))))
    return side.select("id", F.explode(F.array_compact(keys)).alias("key")).distinct()


def frequencies(side: DataFrame) -> DataFrame:
    """(t, df): the number of records whose names have a word."""
    return side.select("id", F.explode(F.array_distinct(F.flatten("names"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def candidates(a: DataFrame, b: DataFrame, df: DataFrame | None = None, total: int | None = None, plain: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b): pairs of prepared records that have a blocking key in common.

    df, total: word frequencies and size of b; plain: what misspelt words stand for.
    """
    df, total = frequencies(b) if df is None else df, max(1, b.count()) if total is None else total
    scratch = Scratch(a.sparkSession)
    plain = _respelt([a, b], df, total, Vocabulary()) if plain is None else plain
    met = split_join(_keys(a).withColumnRenamed("id", "id_a"), scratch.cut(_keys(b).withColumnRenamed("id", "id_b")), "key")
    return met.select("id_a", "id_b").unionByName(_by_words(a, b, df, total, plain, scratch)).distinct()


def _forms(t: Column) -> Column:
    """A word and, from five letters on, the word with any one letter left out."""
    n = F.length(t)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n)))
    return F.when(n >= 5, F.array_distinct(F.concat(F.array(t), cut))).otherwise(F.array(t))


def _weight(total: int) -> Column:
    """A word's weight by the number of right-hand names that have it (column df)."""
    return F.least(F.log(1 + F.lit(total) / (1 + F.coalesce("df", F.lit(0)))), F.log(F.lit(1 + 1 / RARE)))


def _respelt(sides: list[DataFrame], df: DataFrame, total: int, vocabulary: Vocabulary) -> DataFrame:
    """(t, plain): the words of names that misspell a known one, and what that stands for; words common themselves stay."""
    spelt = vocabulary.spelt()
    words = sides[0].select(F.explode(F.flatten("names")).alias("t")).unionByName(sides[1].select(F.explode(F.flatten("names")).alias("t"))).distinct()
    if not spelt:
        return words.filter("false").withColumn("plain", F.col("t"))
    odd = words.join(df, "t", "left").filter((F.coalesce("df", F.lit(0)) <= max(COMMON * total, 3)) & (F.length("t") > 4))
    # A swap of neighbours counts twice for Levenshtein's distance, so the first test only drops what the second would.
    most = F.when(F.length("t") < 8, 1).otherwise(2)
    near = F.exists(F.array(*[F.lit(k) for k in spelt]), lambda k: (F.abs(F.length(k) - F.length("t")) <= most) & (F.levenshtein(F.col("t"), k) <= 2 * most))
    return odd.filter(near).select("t", F.udf(lambda w: respell(w, spelt), "string")("t").alias("plain")).filter("plain is not null and plain <> t")


def _placed_words(side: DataFrame, df: DataFrame, total: int, plain: DataFrame) -> DataFrame:
    """(id, v, zip, city, state, t, df, w, before, all, rest, ws): the words of every name, rarest first.

    before, rest: weight of the words before and after it, all: of all words, ws: weights of all. Misspelt words of the
    vocabulary stand for what they misspell.
    """
    flat = side.select("id", "zip", "city", "state", F.posexplode("names").alias("v", "n")).select("id", "zip", "city", "state", "v", F.explode("n").alias("t"))
    flat = flat.join(plain, "t", "left").withColumn("t", F.coalesce("plain", "t")).drop("plain").filter("t <> ''").distinct()
    flat = flat.join(df, "t", "left").withColumn("w", _weight(total))
    name = Window.partitionBy("id", "v")
    order = name.orderBy(F.desc("w"), "t").rowsBetween(Window.unboundedPreceding, -1)
    out = flat.withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0.0))).withColumn("all", F.sum("w").over(name)).withColumn("ws", F.collect_list("w").over(name))
    return out.withColumn("rest", F.col("all") - F.col("before") - F.col("w"))


def _by_words(a: DataFrame, b: DataFrame, df: DataFrame, total: int, plain: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_a, id_b) of records of one ZIP, city or state whose names share a word up to one typing error and may reach the least score.

    Of the words that two names share, take the heaviest: it and what comes after it in both names bound the weight they
    share. With the weight of all words of a name this bounds the weight that the other name may have. A word is a key
    only if some such name can exist. Rare words are keys as they are; commoner ones are keys together with the classes of
    both names' weights, so that names too long to be alike by a common word never meet. Words alike up to a typing error
    are found in the vocabularies. Keys of many right-hand records are split.
    """
    wa, wb = (scratch.cut(_placed_words(x, df, total, plain)) for x in (a, b))
    voc = lambda x, s: x.select("t").distinct().filter(F.length("t") >= 5).withColumn("f", F.explode(_forms(F.col("t")))).withColumnRenamed("t", s)
    alike = scratch.cut(voc(wa, "t").join(voc(wb, "x"), "f").filter("t <> x").select("t", "x").distinct())
    rare = F.coalesce("df", F.lit(0)) <= max(RARE * total, RARE_LEAST)
    s, whole, slack = F.col("w") + F.col("rest"), F.col("all"), 1e-9
    class_ = lambda x: F.floor(F.log(F.greatest(x, F.lit(1e-3))) / float(np.log(CLASS))).cast("int")

    def same(words: DataFrame, right: bool, reach: float) -> DataFrame:
        words = words.filter(s >= reach / (2 - reach) * whole - slack)
        own, low, high = class_(whole), class_(reach / (2 - reach) * whole - slack), class_(2 * s / reach - whole + slack)
        other = F.explode(F.when(rare, F.array(F.lit(0))).otherwise(F.sequence(low, F.greatest(low, high))))
        words = words.withColumn("own", F.when(rare, F.lit(0)).otherwise(own)).withColumn("other", other)
        return words.withColumn("kind", F.concat_ws(":", F.lit("same"), *(["other", "own"] if right else ["own", "other"])))

    # A misspelt word weighs no more than the word it stands for, and of its name only words that weigh no more come in.
    meant = wb.select(F.col("t").alias("x"), F.col("w").alias("w_x")).distinct()
    other_a = wa.join(alike, "t").join(meant, "x").withColumn("m", F.least("w", "w_x"))
    lighter = F.aggregate(F.filter("ws", lambda y: y <= F.col("m")), F.lit(0.0), lambda p, y: p + y) - F.when(F.col("w") <= F.col("m"), F.col("w")).otherwise(0.0)
    other_a = scratch.cut(other_a.withColumn("all", whole - F.col("w") + F.col("m")).withColumn("rest", lighter).withColumn("w", F.col("m")).withColumn("t", F.col("x")).withColumn("kind", F.lit("alike")))
    other_b = wb.join(alike.select(F.col("x").alias("t")).distinct(), "t", "left_semi").withColumn("kind", F.lit("alike"))

    def keyed(words: DataFrame, alike_words: DataFrame, side: str) -> DataFrame:
        out = None
        for reach in sorted(set(REACH.values())):
            some = same(words, side == "b", reach).unionByName(alike_words.filter(s >= reach / (2 - reach) * whole - slack), allowMissingColumns=True)
            places = F.explode(F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.xxhash64(F.lit(p), p, "kind", "t")) for p in REACH if REACH[p] == reach]))).alias("key")
            some = some.select(F.col("id").alias(f"id_{side}"), F.col("w").alias(f"w_{side}"), whole.alias(f"all_{side}"), F.col("rest").alias(f"rest_{side}"), "kind", F.lit(reach).alias("reach"), places)
            out = some if out is None else out.unionByName(some)
        return out

    ka, kb = keyed(wa, other_a, "a"), scratch.cut(keyed(wb, other_b, "b").drop("kind", "reach"))
    m = F.least("w_a", "w_b")
    most = m + F.least("rest_a", "rest_b")
    reaches = 2 * most >= F.col("reach") * (F.col("all_a") + F.col("all_b") - F.when(F.col("kind") == "alike", F.col("w_b") - m).otherwise(0.0)) - slack
    return split_join(ka, kb, "key").filter(reaches).select("id_a", "id_b")


def _all(parts: tuple[Column, ...]) -> Column:
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull()
    return ok


def _weighted(side: DataFrame, df: DataFrame, total: int, plain: DataFrame) -> DataFrame:
    """names as one text, 'variant:word:weight|...': rarer words weigh more, up to a cap, known words misspelt as little as 1."""
    flat = side.select("id", F.posexplode("names").alias("v", "n")).select("id", "v", F.explode("n").alias("t")).join(df, "t", "left").join(plain, "t", "left")
    weight = F.when(F.col("plain").isNull(), F.round(_weight(total), 4)).otherwise(1.0)
    word = F.concat_ws(":", F.col("v").cast("string"), F.coalesce("plain", "t"), weight.cast("string"))
    lists = flat.filter("coalesce(plain, t) <> ''").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(word)), "|").alias("words"))
    return side.drop("names").join(lists, "id", "left")


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    """The set of the word's letters as bits."""
    return sum({1 << (ord(c) & 31) for c in word})


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, most + 1 if more."""
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    # Columns of the table of distances as bits: where a cell is one more or one less than the one above it (Hyyrö 2003).
    where = _places(a)
    full, top = (1 << len(a)) - 1, 1 << len(a) >> 1
    more, less, same, before, far = full, 0, 0, 0, len(a)
    for y in b:
        here = where.get(y, 0)
        swap = (~same & here) << 1 & before
        same = (((here & more) + more) ^ more | here | less | swap) & full
        right, left = less | ~(same | more) & full, same & more
        far += (1 if right & top else 0) - (1 if left & top else 0)
        right, left = (right << 1 | 1) & full, left << 1 & full
        more, less, before = left | ~(same | right) & full, right & same, here
    return min(far if a else len(b), most + 1)


@lru_cache(1 << 16)
def _places(word: str) -> dict[str, int]:
    """Of each letter of the word its places as bits."""
    where: dict[str, int] = {}
    for i, x in enumerate(word):
        where[x] = where.get(x, 0) | 1 << i
    return where


def respell(word: str, spelt: dict[str, str]) -> str | None:
    """What the known word that this one misspells stands for ('' if it carries no name), None if there is none."""
    most = 1 if len(word) < 8 else 2
    near = min(((edits(word, k, most), k) for k in spelt if abs(len(k) - len(word)) <= most), default=(9, ""))
    return spelt[near[1]] if near[0] <= most else None


def name_score(a: list[tuple[str, float]], b: list[tuple[str, float]], telling: float) -> tuple[float, float]:
    """(weight of the words that two names share, up to typing errors, against that of all their words; greatest weight shared).

    A mistyped word weighs as little as the word it stands for. If both names keep a word of at least the `telling`
    weight to themselves, the score is cut to a third.
    """
    total, free, shared, rest, strongest = 0.0, dict(b), 0.0, [], 0.0
    for t, w in a:
        if t in free:
            w = min(w, free.pop(t))
            shared += 2 * w
            total += 2 * w
            strongest = max(strongest, w)
        else:
            rest.append((t, w))
    alone = False
    for t, w in rest:
        most = 0 if len(t) < 4 else 1 if len(t) < 6 else 2
        far, hit = min(((edits(t, x, most), x) for x in free), default=(99, ""))
        if far <= most:
            least = min(w, free.pop(hit))
            shared += (0.97 if least < telling else 0.88 if far == 1 else 0.6) * 2 * least
            total += 2 * least
            strongest = max(strongest, least if far == 1 else 0.0)
        else:
            alone |= w >= telling
            total += w
    total += sum(free.values())
    score = shared / total if total else 0.0
    return (score / 3 if alone and any(w >= telling for w in free.values()) else score), strongest


@lru_cache(1 << 15)
def _variants(words: str | None) -> list[list[tuple[str, float]]]:
    """Names as `name_score` takes them, from their text; a text that comes again is read once."""
    by: dict[str, dict[str, float]] = {}
    for x in words.split("|") if words else ():
        v, t, w = x.split(":")
        by.setdefault(v, {}).setdefault(t, float(w))
    return [list(n.items()) for n in by.values()]


_NAME_STEPS = (0.12, 0.35, 0.6, 0.8, 0.93)


def _name_level(a: list[list[tuple[str, float]]], b: list[list[tuple[str, float]]], telling: float, rare: float) -> int:
    """0 to 5 by the best score of any two variants, 6 if the best also shares a rare word, 7 missing."""
    best = max((name_score(x, y, telling) for x in a for y in b), default=None)
    if best is None:
        return 7
    level = sum(best[0] >= s for s in _NAME_STEPS)
    return 6 if level == 5 and best[1] >= rare else level


@lru_cache(1 << 15)
def _bigrams(street: str) -> tuple[set[str], list[str]]:
    return {street[k : k + 2] for k in range(len(street) - 1)}, re.findall(r"\d+", street)


def _streets_alike(a: str, b: str) -> bool:
    (ga, na), (gb, nb) = _bigrams(a), _bigrams(b)
    return na == nb and len(ga & gb) / max(1, (len(ga) * len(gb)) ** 0.5) >= 0.5


_COMPARED = ("words", "phone", "number", "dir", "street", "type", "unit", "zip", "city", "state")
#: Pairs that are compared at once, and of these, pairs of names that are scored at once. A score this near to a step is taken again.
_PAIRS, _SCORED, _NEAR = 1 << 13, 1 << 11, 1e-9
#: Words of a name up to which it is scored with others at once.
_WORDS = 8


class _Field:
    """A field of both sides of a batch: distinct texts, and their numbers; given where a text is neither null nor empty."""

    def __init__(self, batch: pa.RecordBatch, f: str):
        coded = pa.concat_arrays([batch.column(f"{f}_{s}") for s in "ab"]).dictionary_encode()
        self.texts: list[str] = coded.dictionary.to_pylist()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        given = np.array([t != "" for t in self.texts] + [False])[code]
        self.a, self.b = code[: batch.num_rows], code[batch.num_rows :]
        self.given_a, self.given_b = given[: batch.num_rows], given[batch.num_rows :]
        self.given = self.given_a & self.given_b
        self.equal = self.given & (self.a == self.b)

    def alike(self, rows: np.ndarray, test: Callable[[str, str], bool]) -> np.ndarray:
        """test of the two texts where `rows` holds, once for each two different texts; False elsewhere."""
        out, at = np.zeros(len(rows), bool), np.flatnonzero(rows)
        pairs, back = np.unique(self.a[at] * len(self.texts) + self.b[at], return_inverse=True)
        out[at] = np.array([test(self.texts[k // len(self.texts)], self.texts[k % len(self.texts)]) for k in pairs.tolist()], bool)[back]
        return out


def _street_levels(number: _Field, dir: _Field, street: _Field, type: _Field, unit: _Field) -> np.ndarray:
    """0 other, 1 same number or street only, 2 same building, other unit, 3 same building, unit open, 4 same unit, 5 missing."""
    open_ = lambda f: ~f.given | f.equal
    alike = number.given & open_(dir) & open_(type)
    alike &= (street.a == street.b) | street.alike(alike & (street.a != street.b), _streets_alike)
    same = np.select([~unit.given, unit.equal], [3, 4], 2)
    return np.select([~number.given, number.equal & alike, number.equal | alike], [5, same, 1], 0)


def _place_levels(zip: _Field, city: _Field, state: _Field) -> np.ndarray:
    """0 other, 1 same state, 2 same city, 3 same ZIP, 4 missing."""
    near = city.alike(city.given & ~zip.equal & (~state.given | state.equal), one_edit)
    unknown = ~zip.given & ~city.given & ~state.given
    return np.select([zip.equal, near, state.equal, unknown], [3, 2, 1, 4], 0)


@lru_cache(1 << 16)
def _mistyped(a: str, b: str) -> bool:
    """Whether `name_score` takes b for a with typing errors."""
    most = 0 if len(a) < 4 else 1 if len(a) < 6 else 2
    return edits(a, b, most) <= most


def _name_levels(words: _Field, telling: float, rare: float) -> np.ndarray:
    """`_name_level` of all pairs. Those whose words are equal or wholly different are scored at once, the others one by one."""
    names = [_variants(t) for t in words.texts]
    many = np.array([len(n) for n in names] + [0])
    flat = [v for n in names for v in n]
    number: dict[str, int] = {}
    wide = max([1, *(len(v) for v in flat)])
    size = min(wide, _WORDS)
    ids, weights = np.full((len(flat), size), -1, np.int32), np.zeros((len(flat), size))
    for k, v in enumerate(flat):
        for c, (t, w) in enumerate(v[:size]):
            ids[k, c], weights[k, c] = number.setdefault(t, len(number)), w
    texts = list(number)
    length, letters = np.array([len(t) for t in texts], np.int64), np.array([_letters(t) for t in texts], np.uint64)
    most = np.select([length < 4, length < 6], [0, 1], 2)
    n_a, n_b, start = many[words.a], many[words.b], np.cumsum(many) - many
    levels, slow = np.full(len(words.a), LEVELS["name"] - 1), np.zeros(len(words.a), bool)
    pair = np.repeat(np.arange(len(n_a)), n_a * n_b)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
    x, y = start[words.a[pair]] + nth // np.maximum(n_b[pair], 1), start[words.b[pair]] + nth % np.maximum(n_b[pair], 1)
    long = np.array([len(v) > size for v in flat] + [False])
    slow[pair[long[x] | long[y]]] = True
    best = np.full(len(n_a), -1.0)
    for k in range(0, len(pair), _SCORED):
        part = slice(k, k + _SCORED)
        rows, i, j, w, v = pair[part], ids[x[part]], ids[y[part]], weights[x[part]], weights[y[part]]
        equal = (i[:, :, None] == j[:, None, :]) & (i >= 0)[:, :, None]
        shared = equal.any(2)
        both = np.where(shared, np.minimum(w, np.take_along_axis(v, equal.argmax(2), 1)), 0.0).sum(1)
        rest, free = (i >= 0) & ~shared, (j >= 0) & ~equal.any(1)
        r, c, d = np.nonzero(rest[:, :, None] & free[:, None, :])
        t, u = i[r, c].astype(np.int64), j[r, d].astype(np.int64)
        hope = (most[t] > 0) & (np.abs(length[t] - length[u]) <= most[t]) & (np.bitwise_count(letters[t] ^ letters[u]) <= 2 * most[t])
        r, t, u = r[hope], t[hope], u[hope]
        two, back = np.unique(t * len(texts) + u, return_inverse=True)
        wrong = np.array([_mistyped(texts[z // len(texts)], texts[z % len(texts)]) for z in two.tolist()], bool)[back]
        slow[rows[r[wrong]]] = True
        total = 2 * both + np.where(rest, w, 0.0).sum(1) + np.where(free, v, 0.0).sum(1)
        score = 2 * both / np.where(total > 0, total, 1.0)
        alone = (rest & (w >= telling)).any(1) & (free & (v >= telling)).any(1)
        np.maximum.at(best, rows, np.where(alone, score / 3, score))
    known = best >= 0
    levels[known] = np.searchsorted(_NAME_STEPS, best[known], "right")
    slow |= known & ((best >= _NAME_STEPS[-1] - _NEAR) | (np.abs(best[:, None] - np.array(_NAME_STEPS)).min(1) < _NEAR))
    for k in np.flatnonzero(slow).tolist():
        levels[k] = _name_level(names[words.a[k]], names[words.b[k]], telling, rare)
    return levels


def _compare(batches: Iterator[pa.RecordBatch], telling: float, rare: float) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(i, _PAIRS) for whole in batches for i in range(0, whole.num_rows, _PAIRS)):
        f = {c: _Field(batch, c) for c in _COMPARED}
        out = {
            "name": _name_levels(f["words"], telling, rare),
            "phone": np.where(f["phone"].given, f["phone"].equal, 2),
            "address": _street_levels(*[f[c] for c in ("number", "dir", "street", "type", "unit")]),
            "place": _place_levels(f["zip"], f["city"], f["state"]),
        }
        cols = [batch.column("id_a"), batch.column("id_b"), *[pa.array(out[c].astype(np.int32)) for c in FIELDS]]
        yield pa.RecordBatch.from_arrays(cols, ["id_a", "id_b", *FIELDS])


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(share of matches, m, u): the level probabilities of matching and other pairs, by expectation-maximisation.

    A missing field tells nothing: it has the same probability in both classes and takes no part.
    """
    p = np.array([x for x, _ in patterns], dtype=int).reshape(-1, len(FIELDS))
    n = np.array([c for _, c in patterns], dtype=float)
    m, u = {}, {}
    for f in FIELDS:
        k = LEVELS[f] - 1
        rising = 4.0 ** np.arange(k)
        m[f], u[f] = rising / rising.sum(), rising[::-1] / rising.sum()
    share = 0.1
    for _ in range(rounds):
        lm, lu = np.full(len(p), np.log(share)), np.full(len(p), np.log1p(-share))
        for j, f in enumerate(FIELDS):
            given = p[:, j] < LEVELS[f] - 1
            lm[given] += np.log(m[f][p[given, j]])
            lu[given] += np.log(u[f][p[given, j]])
        g = 1 / (1 + np.exp(np.clip(lu - lm, -50, 50)))
        new = float((g * n).sum() / max(n.sum(), 1))
        new = min(max(new, 1e-6), 1 - 1e-6)
        for j, f in enumerate(FIELDS):
            k = LEVELS[f] - 1
            for w, t in ((g * n, m), ((1 - g) * n, u)):
                c = np.bincount(p[:, j], weights=w, minlength=k + 1)[:k] + 0.01
                t[f] = c / c.sum()
        if abs(new - share) < 1e-9:
            break
        share = new
    return share, m, u


def link(left: DataFrame, left_cols: dict, right: DataFrame, right_cols: dict, accept: float = 0.5, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:  # noqa: B008
    """(left_id, right_id, confidence and the level of each field) of matching records.

    left_cols, right_cols: the columns id, names (a list), phone, address, zip, city, state; all but id and names may be
    missing. A pair is reported if its posterior is at least `accept` and its name or its telephone agrees: an address
    alone does not tell two tenants of a building apart. All such pairs of a left record are reported, as the same
    thing may be registered twice; but one without an agreeing name gives way to one with it. Fields that
    are null, blank or placeholders count as missing, and so do telephones shared by more than 0.05 % of the right-hand
    records (and more than 50). Rows with a null id are left out, rows with the same id are one record each. Empty tables
    give no rows. vocabulary: short forms, synonyms and words without meaning in the field of business at hand.
    """
    scratch = Scratch(left.sparkSession)
    a, b = scratch.cut(_prepared(left, left_cols, vocabulary)), scratch.cut(_prepared(right, right_cols, vocabulary))
    total = max(1, b.count())
    a, b = _without_shared_phones(a, b, total)
    df = scratch.cut(frequencies(b))
    plain = scratch.cut(_respelt([a, b], df, total, vocabulary))
    met = candidates(a, b, df, total, plain)
    side = lambda x, s: _weighted(x, df, total, plain).select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", *_COMPARED)])
    both = met.join(side(a, "a"), "id_a").join(side(b, "b"), "id_b")
    kinds = f"id_a {dict(a.dtypes)['id']}, id_b {dict(b.dtypes)['id']}, " + ", ".join(f"{f} int" for f in FIELDS)
    telling, rare = (float(np.log(1 + min(1 / x, total / 3))) for x in (COMMON, RARE))
    levels = scratch.cut(both.mapInArrow(lambda it: _compare(it, telling, rare), kinds))
    # At most one row per pattern of levels, a number fixed by the levels.
    patterns = [(tuple(r[f] for f in FIELDS), r["n"]) for r in levels.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")).collect()]
    share, m, u = estimate(patterns)
    weight = F.lit(float(np.log(share) - np.log1p(-share)))
    for f in FIELDS:
        steps = np.log(m[f]) - np.log(u[f])
        weight = weight + F.get(F.array(*[F.lit(float(x)) for x in [*steps, 0.0]]), F.col(f))
    scored = levels.withColumn("weight", weight)
    scored = scored.filter((F.col("weight") >= float(np.log(accept / (1 - accept)))) & (F.col("name").between(2, LEVELS["name"] - 2) | (F.col("phone") == 1)))
    best = scored.groupBy("id_a").agg(F.max(F.when(F.col("name") < LEVELS["name"] - 1, F.col("name"))).alias("best"))
    kept = scored.join(best, "id_a").filter("best is null or best < 4 or name >= 2")
    return kept.select(
        F.col("id_a").alias("left_id"), F.col("id_b").alias("right_id"), F.round(1 / (1 + F.exp(-F.col("weight"))), 6).alias("confidence"), *[F.col(f).alias(f"{f}_level") for f in FIELDS]
    )
