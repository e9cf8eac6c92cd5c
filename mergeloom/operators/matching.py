"""Joins on similarity, containment and date bands, and the latest row of each key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.functions.fuzzy import may_reach, ratio
from mergeloom.operators.similar import Texts, block_text, codes, first_of, in_order, meet, ratios, similar


def fuzzy_match(left: DataFrame, right: DataFrame, block: list[str], left_text: str, right_text: str, left_id: str, right_id: str, least: float, first: bool = False, strict: bool = False) -> DataFrame:
    """For each left record the right record of its block with the most similar text.

    Pairs are formed by equality of the block columns only; an exact Levenshtein bound drops hopeless ones before
    the ratio is computed. Accepted from `least` on (above it if strict). first: the least right id instead of the best
    score. Ties go to the least right id. Null blocks and texts match nothing. The best of a block is found by an
    aggregate that combines on the map side, so a hot block has no window over it.
    """
    right = right.select(*[F.col(c) for c in block], F.col(right_id).alias("__rid"), F.col(right_text).alias("__rt"))
    pairs = left.select(*block, F.col(left_id).alias("__lid"), F.col(left_text).alias("__lt")).join(right, block)
    pairs = pairs.filter(may_reach(F.col("__lt"), F.col("__rt"), least)).withColumn("score", ratio("__lt", "__rt"))
    pairs = pairs.filter(F.col("score") > least if strict else F.col("score") >= least)
    if first:
        best = pairs.groupBy("__lid").agg(F.min(F.struct("__rid", "score")).alias("b"))
    else:
        best = pairs.groupBy("__lid").agg(F.min(F.struct((-F.col("score")).alias("__neg"), "__rid", "score")).alias("b"))
    return best.select(F.col("__lid").alias(left_id), F.col("b.__rid").alias(right_id), F.col("b.score").alias("score"))


def ranked_match(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, tests: list[tuple[str, list[tuple[str, str]], float, int]], alike: str | None = None) -> DataFrame:
    """(left_id, right_id, how, score): for each left record the best right record of its block by several tests.

    tests: (name, pairs of left and right columns of which the better score counts, least score, tier); a lower tier goes
    first whatever its score, then the greater score, then the earlier test, then the least right id. alike: a column that
    must be equal where both records have it. Null blocks and texts match nothing. Every pair of a block counts, but blocks
    meet in parts (`similar.meet`), which give the best of each left record.
    """
    sides = [sorted({pair[k] for _, columns, _, _ in tests for pair in columns}) for k in (0, 1)]
    of = lambda df, key, texts: df.select(block_text(block).alias("b"), F.col(key).alias("id"), *[F.col(c).alias(f"t_{c}") for c in texts], *([F.col(alike).alias("alike")] if alike else []))
    a, b = of(left, left_id, sides[0]), of(right, right_id, sides[1])

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        blocks, place, keep = codes(x["b"], y["b"]), in_order(y["id"]), None
        if alike:
            h, g = codes(x["alike"], y["alike"])
            keep = lambda i, j: (h[i] == g[j]) | (h[i] < 0) | (g[j] < 0)
        tx, ty = {c: Texts(x[f"t_{c}"]) for c in sides[0]}, {c: Texts(y[f"t_{c}"]) for c in sides[1]}
        none = np.zeros(0, np.int64)
        i, j, tier, neg, test = none, none, none, np.zeros(0), none
        for k in sorted(range(len(tests)), key=lambda k: (tests[k][3], k)):
            _, columns, least, own = tests[k]
            # Nothing beats a lower tier or, by an earlier test, equal texts.
            open_ = blocks[0].copy()
            open_[i[(tier < own) | (neg == -100)]] = -1
            for c, d in columns:
                u, v, score = similar(tx[c], ty[d], open_, blocks[1], least, keep)
                i, j, tier, neg, test = np.r_[i, u], np.r_[j, v], np.r_[tier, np.full(len(u), own)], np.r_[neg, -score], np.r_[test, np.full(len(u), k)]
            first = first_of(i, tier, neg, test, place[j])
            i, j, tier, neg, test = i[first], j[first], tier[first], neg[first], test[first]
        return pa.table({"l": x["id"].take(pa.array(i)), "r": y["id"].take(pa.array(j)), "tier": pa.array(tier, pa.int32()), "neg": neg, "test": pa.array(test, pa.int32())})

    met = meet(a, b, work, f"l {dict(a.dtypes)['id']}, r {dict(b.dtypes)['id']}, tier int, neg double, test int")
    top = met.groupBy("l").agg(F.min(F.struct("tier", "neg", "test", "r")).alias("b"))
    how = F.element_at(F.array(*[F.lit(name) for name, *_ in tests]), F.col("b.test") + 1)
    return top.select(F.col("l").alias(left_id), F.col("b.r").alias(right_id), how.alias("how"), F.round(-F.col("b.neg"), 4).alias("score"))


def weighed_match(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, first: tuple[str, float, float], second: tuple[str, float, float], least: float) -> DataFrame:
    """(left_id, right_id, score): for each left record the right record of its block with the best weighed score.

    first, second: (column, least score, weight). Where the first column reaches its least score, both scores are added by
    their weights; else the second counts alone from its least score on. Sums from `least` on are rounded to four digits,
    ties go to the least right id. Records without the second column match nothing, nor do null blocks.
    """
    (one, least_one, w_one), (two, least_two, w_two) = first, second
    of = lambda df, key: df.select(block_text(block).alias("b"), F.col(key).alias("id"), F.col(one).alias("one"), F.col(two).alias("two")).filter("two is not null")
    a, b = of(left, left_id), of(right, right_id)

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        blocks, place, rows = codes(x["b"], y["b"]), in_order(y["id"]), max(1, y.num_rows)
        x2, y2 = Texts(x["two"]), Texts(y["two"])
        i, j, score = similar(Texts(x["one"]), Texts(y["one"]), *blocks, least_one)
        score = w_one * score + w_two * ratios(x2, y2, i, j)
        u, v, alone = similar(x2, y2, *blocks, least_two)
        new = ~np.isin(u * rows + v, i * rows + j)
        i, j, score = np.r_[i, u[new]], np.r_[j, v[new]], np.r_[score, alone[new]]
        best = np.full(x.num_rows, -np.inf)
        np.maximum.at(best, i, score)
        # Scores that rounding may make equal stay together.
        near = np.flatnonzero((score >= least) & (score >= best[i] - 2e-4))
        i, j, score = i[near], j[near], score[near]
        _, value = np.unique(score, return_inverse=True)
        top = first_of(i * (len(value) + 1) + value, place[j])
        return pa.table({"l": x["id"].take(pa.array(i[top])), "r": y["id"].take(pa.array(j[top])), "score": score[top]})

    met = meet(a, b, work, f"l {dict(a.dtypes)['id']}, r {dict(b.dtypes)['id']}, score double").withColumn("score", F.round("score", 4))
    top = met.groupBy("l").agg(F.min(F.struct((-F.col("score")).alias("neg"), "r")).alias("b"))
    return top.select(F.col("l").alias(left_id), F.col("b.r").alias(right_id), (-F.col("b.neg")).alias("score"))


def similar_texts(left: DataFrame, right: DataFrame, block: str, left_text: str, right_text: str, left_id: str, right_id: str, least: float) -> DataFrame:
    """(left_id, right_id, score) of all pairs of a block whose texts' ratio is at least `least`.

    Blocks meet in parts (`similar.meet`), where signatures of the texts leave few pairs to compare. Null blocks and null or
    empty texts match nothing; repeated rows give one pair.
    """
    of = lambda df, key, text: df.select(block_text([block]).alias("b"), F.col(key).alias("id"), F.col(text).alias("t")).filter("t <> ''").distinct()
    a, b = of(left, left_id, left_text), of(right, right_id, right_text)

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        i, j, score = similar(Texts(x["t"]), Texts(y["t"]), *codes(x["b"], y["b"]), least)
        return pa.table({"l": x["id"].take(pa.array(i)), "r": y["id"].take(pa.array(j)), "score": score})

    met = meet(a, b, work, f"l {dict(a.dtypes)['id']}, r {dict(b.dtypes)['id']}, score double")
    return met.groupBy(F.col("l").alias(left_id), F.col("r").alias(right_id)).agg(F.max("score").alias("score"))


def containing_texts(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Distinct (text, part) where the text contains the part; blank and null values match nothing."""
    p = parts.select(F.col(part).alias("p")).filter(F.length("p") > 0).distinct()
    t = texts.select(F.col(text).alias("__low")).filter("__low is not null").distinct()
    return _by_trigram(t, p).select(F.col("__low").alias(text), F.col("p").alias(part))


#: Patterns that a plan holds as literals.
MOST_LITERALS = 5000


def longest_pattern(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, key: str) -> DataFrame:
    """For each text the longest pattern it contains (lower case), ties to the first in order; null if none.

    A dictionary of up to 5,000 patterns is compiled into the plan as literals, longest first, so that one pass over the
    texts decides. A larger one is joined by character trigrams: a pattern is found under its rarest trigram, a distinct
    text under each of its own. Rows may repeat; null texts and blank patterns match nothing.
    """
    words = patterns.select(F.lower(F.trim(F.col(pattern))).alias("p")).filter(F.length("p") > 0).distinct()
    known = [r[0] for r in words.limit(MOST_LITERALS + 1).collect()]
    if len(known) > MOST_LITERALS:
        return _longest_by_trigram(texts.select(F.col(key), F.lower(F.col(text)).alias("__low")), words, key)
    ordered = F.array(*[F.lit(p) for p in sorted(known, key=lambda p: (-len(p), p))] or [F.lit(None).cast("string")])
    low = F.lower(F.col(text))
    return texts.select(key, F.try_element_at(F.filter(ordered, lambda p: F.contains(low, p)), F.lit(1)).alias("pattern"))


def _pieces(c: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _by_trigram(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(__low, p) of distinct texts and the patterns they contain; a pattern is found under its rarest trigram."""
    # Patterns shorter than three characters are their own piece.
    own = words.select("p", F.explode(F.when(F.length("p") < 3, F.array("p")).otherwise(_pieces(F.col("p"), 3))).alias("g"))
    rare = own.join(own.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").groupBy("p").agg(F.min(F.struct("n", "g")).alias("x")).select("p", "x.g")
    pieces = F.concat(*[_pieces(F.col("__low"), n) for n in (1, 2, 3)])
    return texts.withColumn("g", F.explode(pieces)).join(rare, "g").filter(F.contains(F.col("__low"), F.col("p"))).select("__low", "p")


def _longest_by_trigram(texts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    met = _by_trigram(texts.select("__low").filter("__low is not null").distinct(), words)
    best = met.groupBy("__low").agg(F.min(F.struct((-F.length("p")).alias("n"), "p")).alias("b"))
    return texts.join(best, "__low", "left").select(key, F.col("b.p").alias("pattern"))


def band_pairs(df: DataFrame, block: list[str], date: str, days: int, key: str, carry: list[str] | None = None, hope: Callable[[Callable, Callable], Column] | None = None) -> DataFrame:
    """(key_a, key_b), a < b, of rows of one block whose dates are at most `days` apart, with columns `carry` of both.

    Dates fall into windows of `days`; a row meets its own window and the next, so a block is never crossed as a whole.
    hope: a further condition on the pair, from two functions that give a column of either side.
    """
    carry = carry or []
    rows = df.filter(F.col(date).isNotNull()).select(*block, F.struct(F.col(key).alias("k"), F.col(date).cast("date").alias("d"), *carry).alias("x"))
    rows = rows.withColumn("w", F.floor(F.unix_date("x.d") / days).cast("int"))
    a = rows.select(*block, F.col("x").alias("xa"), F.col("w").alias("wa"), F.explode(F.array("w", F.col("w") + 1)).alias("w"))
    b = rows.withColumnRenamed("x", "xb")
    a_, b_ = F.col("xa"), F.col("xb")
    near = a.join(b, [*block, "w"]).filter((F.abs(F.datediff("xa.d", "xb.d")) <= days) & ((F.col("wa") < F.col("w")) | (a_["k"] < b_["k"])) & (a_["k"] != b_["k"]))
    if hope is not None:
        near = near.filter(hope(lambda c: a_[c], lambda c: b_[c]))
    less = a_["k"] < b_["k"]
    lo, hi = F.when(less, a_).otherwise(b_), F.when(less, b_).otherwise(a_)
    return near.select(lo.alias("lo"), hi.alias("hi")).select(F.col("lo.k").alias(f"{key}_a"), F.col("hi.k").alias(f"{key}_b"), *[F.col(f"{s}.{c}").alias(f"{c}_{t}") for s, t in (("lo", "a"), ("hi", "b")) for c in carry]).distinct()


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
