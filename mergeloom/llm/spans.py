"""Long stretches of text that several records share verbatim, by level-wise doubling.

Windows of half the wanted length are counted first; those in more than one record are extended to twice that length,
and so on until none is repeated. Not every window need be counted at the first level: any stretch of the wanted
length in two records makes both choose the same anchor in its first half, the place of the least hash among the
neighbouring character groups. Windows of half the length at anchors are counted; around those that are repeated every
window of the full length that chose this anchor is taken. Hashes of windows are differences of running sums, so a
window costs the same whatever its length; windows are equal if two independent 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.operators.pairs import distinct_groups, member_pairs
from mergeloom.session import Scratch

_BASE = 0x9E3779B97F4A7C15
#: Odd multipliers of the two window hashes, with their inverses modulo 2^64, and what the characters are mixed with.
_POWERS = [(0xD1342543DE82EF95, 0x9FB21C651E98DF25), (0x2545F4914F6CDD1D, 0x94D049BB133111EB)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(by)
    x ^= x >> np.uint64(29)
    x *= np.uint64(_BASE)
    return x ^ (x >> np.uint64(32))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2^64, from a table that grows with the longest text met."""
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * len(have) if have is not None else 4096), base, dtype=np.uint64)
        have[:1] = 1
        have = _TABLES[base] = np.multiply.accumulate(have)
    return have[:n]


class Windows:
    """Hashes of any windows of a text: sums of mixed characters times powers of an odd number, modulo 2^64."""

    def __init__(self, codes: np.ndarray, which: int):
        self.base, mix = _POWERS[which]
        terms = _mixed(codes, mix) * _powers(self.base, len(codes))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(pow(self.base, -1, 1 << 64), len(codes) + 1)

    def at(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the windows of n characters at the given starts, as signed numbers."""
        h = (self.sums[starts + n] - self.sums[starts]) * self.back[starts]
        return _mixed(h, self.base).view(np.int64)


def anchors(c: np.ndarray, length: int) -> np.ndarray:
    """For each start of a window of `length` characters (given by their codes), the anchor it chooses."""
    reach, group = length // 2, length // 6
    h = c * np.uint64(_BASE)
    width = 1
    while width < group:  # hash of `group` characters from hashes of its parts
        step = min(width, group - width)
        h = h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + h[step:]
        h ^= h >> np.uint64(29)
        width += step
    # The place in the lower half breaks ties of the hash's upper half in favour of the first.
    best, span = (h * np.uint64(_BASE)) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64), 1
    while span < reach:
        step = min(span, reach - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return (best[: len(c) - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, at, h = [], [], []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = t.as_py()
            if len(text) >= length:
                codes = _codes(text)
                a = np.unique(anchors(codes, length))
                doc.append(np.full(len(a), d, np.int64))
                at.append(a)
                h.append(Windows(codes, 0).at(a, length // 2))
        if doc:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in ((doc, np.int64), (at, np.int32), (h, np.int64))], ["d", "a", "h"])


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, t, keep in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text = t.as_py()
            chosen = np.zeros(len(text) + 1, bool)
            chosen[keep.values.to_numpy(zero_copy_only=False)] = True
            codes = _codes(text)
            starts = np.flatnonzero(chosen[anchors(codes, length)])
            hashes = [Windows(codes, i).at(starts, length) for i in (0, 1)]
            for i in range(0, len(starts), 50_000):
                part = slice(i, i + 50_000)
                cols = [np.full(len(starts[part]), d, np.int64), starts[part].astype(np.int32), hashes[0][part], hashes[1][part]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d", "p", "h", "g"])


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """The values of `by` that occur in more than one record."""
    return rows.groupBy(*by).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select(*by)


def shared_windows(docs: DataFrame, key: str, text: str, length: int, scratch: Scratch) -> DataFrame:
    """(d, p, h, g): every window of `length` characters, by start and hashes, that some other record holds too.

    Values are counted with a partial count per task; the join back to the rows is one that splits a hot value's rows
    (a semi join under adaptive execution), so a notice in a third of all records is shared by many tasks.
    """
    t = docs.select(F.col(f"`{key}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).filter(f"d is not null and length(t) >= {length}")
    rows = scratch.cut(t.mapInArrow(lambda it: _anchor_rows(it, length), "d bigint, a int, h bigint"))
    kept = rows.join(_repeated(rows, "h"), "h", "left_semi").groupBy("d").agg(F.collect_set("a").alias("keep"))
    windows = scratch.cut(t.join(kept, "d").select("d", "t", "keep").mapInArrow(lambda it: _window_rows(it, length), "d bigint, p int, h bigint, g bigint"))
    out = scratch.cut(windows.join(_repeated(windows, "h", "g"), ["h", "g"], "left_semi").select("d", "p", "h", "g"))
    scratch.free(rows, windows)
    return out


def _members(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    windows = shared_windows(docs, key, text, length, Scratch(docs.sparkSession))
    return windows.select(F.struct("h", "g").alias("w"), F.col("d").alias(key)).distinct()


def sharing_pairs(docs: DataFrame, key: str, text: str, length: int = 240) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of records that share a stretch of at least `length` characters.

    Characters are compared as they are (case, spaces and marks count). Null and shorter texts share nothing; rows with
    a null key are left out; rows with the same key are one record. Windows are compared by two 64-bit hashes. Longer
    windows can add no pair, so doubling ends at `length` here; `shared_share` goes on.
    """
    return member_pairs(_members(docs, key, text, length), "w", key)


def sharing_classes(docs: DataFrame, key: str, text: str, length: int = 240) -> DataFrame:
    """(class_id, key): for each different set of two or more records with a window in common, its members.

    Two records share a stretch exactly if some class holds both. A notice in a million records is one class of a million
    rows here, not all its pairs. Records, nulls and equality as in `sharing_pairs`.
    """
    m = _members(docs, key, text, length)
    return m.join(distinct_groups(m, "w", key).select("w"), "w").select(F.concat_ws(":", F.hex("w.h"), F.hex("w.g")).alias("class_id"), key)


def shared_share(docs: DataFrame, key: str, text: str, length: int = 240) -> DataFrame:
    """One row per record: (key, n_chars, shared_chars, shared_share, longest_level).

    shared_chars counts the characters covered by stretches of at least `length` that some other record holds too;
    longest_level is the longest of length, 2*length, 4*length .. at which some window of the record is still repeated
    elsewhere, 0 if none. Null texts count as empty, an empty text has share 0; rows with the same key are one
    record, of which the longest text counts; null keys are left out.
    """
    scratch = Scratch(docs.sparkSession)
    level = shared_windows(docs, key, text, length, scratch)
    # Covered characters: windows start at most `length` apart inside one covered run. The starts of a record are bounded
    # by its own text, so a window function over them sees one text at a time.
    starts = level.select("d", "p").distinct()
    gap = F.expr("p - lag(p) over (partition by d order by p)")
    covered = starts.select("d", F.least(F.coalesce(gap, F.lit(length)), F.lit(length)).alias("c")).groupBy("d").agg(F.sum("c").alias("covered"))
    longest, n = level.select("d").distinct().withColumn("level", F.lit(length)), length
    while True:
        nxt = level.alias("x").join(level.alias("y"), (F.col("x.d") == F.col("y.d")) & (F.col("y.p") == F.col("x.p") + n))
        nxt = scratch.cut(nxt.select("x.d", "x.p", F.xxhash64("x.h", "y.h").alias("h"), F.xxhash64("y.g", "x.g").alias("g")))
        nxt = scratch.cut(nxt.join(_repeated(nxt, "h", "g"), ["h", "g"], "left_semi").select("d", "p", "h", "g"))
        if nxt.isEmpty():
            break
        n *= 2
        longest = longest.unionByName(nxt.select("d").distinct().withColumn("level", F.lit(n)))
        level = nxt
    top = longest.groupBy("d").agg(F.max("level").alias("level"))
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("d"), F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).alias("n")).filter("d is not null")
    out = base.groupBy("d").agg(F.max("n").alias("n")).join(covered, "d", "left").join(top, "d", "left")
    shared = F.coalesce("covered", F.lit(0).cast("bigint"))
    return out.select(
        F.col("d").alias(key), F.col("n").alias("n_chars"), shared.alias("shared_chars"),
        F.round(F.when(F.col("n") > 0, shared / F.col("n")).otherwise(0.0), 4).alias("shared_share"), F.coalesce("level", F.lit(0)).alias("longest_level"),
    )
