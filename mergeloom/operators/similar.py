"""Pairs of similar texts within blocks, found exactly and without comparing every pair letter by letter.

Rows of a block meet in parts of bounded size. In a part every text has a signature of 128 bits, one for the k-th use of
a letter; the bits in which two signatures differ never exceed the Indel distance, so that whole arrays of pairs fall out
by two XORs. What is left is compared by the bit-parallel longest common subsequence, again on arrays of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.fuzzy import lcs_length

#: Rows of one block, left and right, that meet in one part.
LEFT, RIGHT = 4096, 16384
#: Pairs whose signatures, and letters of right texts, that are compared at once.
_AT_ONCE, _LETTERS_AT_ONCE = 1 << 18, 1 << 22
#: Pairs that go through the letters together; their bits stay in the processor's cache.
_PAIRS_AT_ONCE = 1 << 13
#: Bits of a word of the bit-parallel comparison; texts longer than this on the left are compared one by one.
_WORD = 64
_ONE_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def block_text(block: list[str]) -> Column:
    """The block columns as one text, null if any of them is."""
    some = F.col(block[0]).cast("string") if len(block) == 1 else F.to_json(F.struct(*block))
    return F.when(F.array_contains(F.array(*[F.col(c).isNull() for c in block]), True), None).otherwise(some)


def meet(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(left rows, right rows) over parts in which every pair of rows of equal block `b` meets once.

    work has to compare the blocks itself, as small ones share a part. Large ones are cut on both sides by the rows' hash.
    Null blocks meet nothing. Both sides are read twice.
    """
    many = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.filter("b is not null"), right.filter("b is not null")
    cut = lambda df, name, size: df.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    parts = cut(left, "__pl", LEFT).join(cut(right, "__pr", RIGHT), "b")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        out = df.join(parts, "b").withColumn(f"{own}_", F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")).withColumn(f"{other}_", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        whole = (F.col("__pl") == 1) & (F.col("__pr") == 1)
        key = F.when(whole, F.pmod(F.xxhash64("b"), F.lit(many)).cast("long")).otherwise(F.xxhash64("b", "__pl_", "__pr_"))
        # The planner counts bytes, not the work in a part, so the number of tasks is given.
        return out.select(*df.columns, key.alias("__part")).repartition(many, "__part")

    return dealt(left, "__pl", "__pr").groupBy("__part").cogroup(dealt(right, "__pr", "__pl").groupBy("__part")).applyInArrow(work, schema)


class Texts:
    """Letters and signatures of an array of texts; a null has length -1."""

    def __init__(self, texts: pa.ChunkedArray):
        self.text = texts
        self.n = pc.fill_null(pc.utf8_length(texts), -1).to_numpy().astype(np.int64)
        own = np.maximum(self.n, 0)
        self.off = np.cumsum(own) - own
        joined = b"".join(_bytes(x) for x in texts.chunks)
        # A lone surrogate cannot come from Spark's UTF-8, so every text has an encoding.
        self.letters = np.frombuffer(joined, dtype=np.uint8) if len(joined) == own.sum() else np.frombuffer(joined.decode().encode("utf-32-le"), dtype=np.uint32)
        c = self.letters.astype(np.int32)
        slots = np.where((c >= 97) & (c <= 122), c - 97, np.where((c >= 48) & (c <= 57), c - 22, np.where(c == 32, 36, 37 + c % 3))).astype(np.uint8)
        # Letter by letter over all texts at once, longest first, so that those that have one more are the first ones.
        # Bits go by use mod 16 (40 * 16 is a multiple of 128), so that bytes may overflow.
        order = np.argsort(-own, kind="stable")
        having = np.searchsorted(-own[order], -np.arange(1, int(own.max(initial=0)) + 1), "right")
        off, uses, signs = self.off[order], np.zeros(40 * len(own), np.uint8), np.zeros(2 * len(own), np.uint64)
        first, word = np.arange(len(own)) * 40, np.arange(len(own)) * 2
        for k, n in enumerate(having):
            slot = slots[off[:n] + k]
            at = first[:n] + slot
            use = uses[at]
            uses[at] = use + np.uint8(1)
            bit = (slot + np.uint8(40) * use) & np.uint8(127)
            signs[word[:n] + (bit >> np.uint8(6))] |= _ONE_BIT[bit & np.uint8(63)]
        self.signs = np.empty((2, len(own)), np.uint64)
        self.signs[:, order] = signs.reshape(-1, 2).T


def _bytes(texts: pa.Array) -> memoryview | bytes:
    """The texts one after the other in UTF-8, nulls as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    return memoryview(texts.buffers()[2])[off[0] : off[-1]] if len(texts) and texts.buffers()[2] else b""


def codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are; -1 for null."""
    both = pa.chunked_array([*left.chunks, *right.chunks], type=left.type).combine_chunks().dictionary_encode().indices
    numbers = pc.fill_null(both, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers[: len(left)], numbers[len(left) :]


def _common(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair; a row of the table is one word of bits."""
    out = np.zeros(len(i), np.int64)
    for k in np.flatnonzero(a.n[i] > _WORD):
        out[k] = lcs_length(a.text[i[k]].as_py(), b.text[j[k]].as_py())
    short = np.flatnonzero(a.n[i] <= _WORD)
    i, j = i[short], j[short]
    if not len(i):
        return out
    bits = np.zeros(len(i), np.uint64)
    used, at = np.unique(i, return_inverse=True)
    own = a.n[used]
    pos = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    letters = a.letters[np.repeat(a.off[used], own) + pos]
    alphabet = np.unique(letters)
    width = len(alphabet) + 1
    # Number of a letter among those of the left texts; what they lack and the padding share the last one, which has no bits.
    number = np.full(int(max(letters.max(initial=0), b.letters.max(initial=0))) + 1, width - 1, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    where = np.zeros(len(used) * width, np.uint64)
    np.bitwise_or.at(where, np.repeat(np.arange(len(used)), own) * width + number[letters], np.uint64(1) << pos.astype(np.uint64))
    others, right = np.unique(j, return_inverse=True)
    theirs = b.n[others]
    nth = np.arange(theirs.sum()) - np.repeat(np.cumsum(theirs) - theirs, theirs)
    steps = np.full((int(theirs.max()), len(others)), width - 1, np.int32)
    steps[nth, np.repeat(np.arange(len(others)), theirs)] = number[b.letters[np.repeat(b.off[others], theirs) + nth]]
    for k in range(0, len(i), _PAIRS_AT_ONCE):
        part = slice(k, k + _PAIRS_AT_ONCE)
        base, y, row = at[part] * width, right[part], np.full(len(at[part]), ~np.uint64(0))
        for x in steps[: int(theirs[y].max())]:
            hit = where[x[y] + base]
            hit &= row
            rest = row - hit
            row += hit
            row |= rest
        bits[part] = row
    n = a.n[i].astype(np.uint64)
    full = np.where(n == _WORD, ~np.uint64(0), (np.uint64(1) << (n % np.uint64(_WORD))) - np.uint64(1))
    out[short] = np.bitwise_count(~bits & full)
    return out


def _hopeful(a: Texts, b: Texts, block_a: np.ndarray, block_b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block whose lengths and letters let the ratio reach `least`; null texts are in none."""
    share = (100 - least) / 100
    i, j = np.flatnonzero((a.n >= 0) & (block_a >= 0)), np.flatnonzero((b.n >= 0) & (block_b >= 0))
    if not len(i) or not len(j):
        return
    i, j = i[np.lexsort((a.n[i], block_a[i]))], j[np.lexsort((b.n[j], block_b[j]))]
    far = int(max(a.n[i].max(), b.n[j].max())) + 1
    key_b, n_b, s0, s1 = block_b[j] * far + b.n[j], b.n[j], b.signs[0][j], b.signs[1][j]
    starts = np.flatnonzero(np.r_[True, np.diff(block_a[i] * far + a.n[i]) != 0])
    n, block = a.n[i][starts], block_a[i][starts]
    low = np.searchsorted(key_b, block * far + np.ceil(n * (1 - share) / (1 + share) - 1e-9).astype(np.int64))
    high = np.searchsorted(key_b, block * far + np.minimum(np.floor(n * (1 + share) / max(1 - share, 1e-9) + 1e-9), far - 1).astype(np.int64), "right")
    for start, end, n, lo, hi in zip(starts, np.r_[starts[1:], len(i)], n, low, high, strict=True):
        if lo >= hi:
            continue
        room = np.minimum(np.floor(share * (n + n_b[lo:hi]) + 1e-9), 255).astype(np.uint8)
        by = max(1, _AT_ONCE // int(hi - lo))
        for k in range(start, end, by):
            rows = i[k : min(k + by, end)]
            differ = np.bitwise_count(a.signs[0][rows, None] ^ s0[lo:hi]) + np.bitwise_count(a.signs[1][rows, None] ^ s1[lo:hi])
            x, y = np.nonzero(differ <= room)
            if len(x):
                yield rows[x], j[lo + y]


def similar(a: Texts, b: Texts, block_a: np.ndarray, block_b: np.ndarray, least: float, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ratio) of the pairs of one block whose ratio is at least `least`. keep: a condition on pairs, as an array."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def compare() -> None:
        i, j = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
        waiting.clear()
        score = ratios(a, b, i, j)
        good = score >= least
        found.append((i[good], j[good], score[good]))

    for i, j in _hopeful(a, b, block_a, block_b, least):
        if keep is not None:
            good = keep(i, j)
            i, j = i[good], j[good]
        if len(i):
            waiting.append((i, j))
            if sum(len(w[0]) for w in waiting) >= 1 << 16:
                compare()
    if waiting:
        compare()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def ratios(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Ratio of each pair of texts, none of which is null; 100 for two empty ones."""
    out, by = np.zeros(len(i)), max(1, _LETTERS_AT_ONCE // max(1, int(b.n[j].max(initial=0))))
    for k in range(0, len(i), by):
        x, y = i[k : k + by], j[k : k + by]
        both = a.n[x] + b.n[y]
        out[k : k + by] = np.where(both > 0, 200.0 * _common(a, b, x, y) / np.maximum(both, 1), 100.0)
    return out


def in_order(ids: pa.ChunkedArray) -> np.ndarray:
    """Place of each row in the order of the ids, nulls first."""
    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def first_of(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Index of the first row of each group by the given keys."""
    s = np.lexsort((*order[::-1], group))
    return s[np.r_[True, np.diff(group[s]) != 0]] if len(s) else s
