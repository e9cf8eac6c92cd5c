"""Passages of held-out items inside a training corpus, found with suffix arrays over corpus shards.

Each task gathers the documents of its partition into shards of bounded size and builds a suffix array over the
shard's words. Every suffix of every item is then binary-searched in it, all suffixes at once, which gives each
verbatim match of at least the required length with its place and full length. A suffix whose first words include one
that no item has cannot hold a match and is left out of the array; this changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.session import Scratch

WORD = re.compile("[a-z0-9]+")
#: Words of corpus in one suffix array, and words of items searched in one pass over the corpus.
SHARD_WORDS, ITEM_WORDS = 1_000_000, 2_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def suffix_array(t: np.ndarray, longest: int) -> np.ndarray:
    """Starts of all suffixes of t in order, compared up to `longest` words, by prefix doubling."""
    rank, k = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    while k < longest and rank.max(initial=0) < len(t) - 1:
        after = np.full(len(t), -1, np.int64)
        after[:-k] = rank[k:]
        rank, k = np.unique(rank * (len(t) + 1) + after + 1, return_inverse=True)[1].astype(np.int64), 2 * k
    return np.argsort(rank, kind="stable")


def _bound(t: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) of the array whose suffix has at `depth` a word of at least `word`."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = open_ & (t[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(t) - 1)] < word)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def search(t: np.ndarray, sa: np.ndarray, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(item suffix, corpus place) of every match of `least` words or more. q ends with -2, which matches nothing."""
    j = np.arange(max(0, len(q) - least))
    lo, hi = np.zeros(len(j), np.int64), np.full(len(j), len(sa))
    for depth in range(least):
        w = q[j + depth]
        a, b = _bound(t, sa, lo, hi, depth, w), _bound(t, sa, lo, hi, depth, w + 1)
        some = (a < b) & (w >= 0)
        j, lo, hi = j[some], a[some], b[some]
    n = hi - lo
    return np.repeat(j, n), sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


class _Items:
    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least, self.vocabulary, ids, owner = least, {}, [], []
        for k, (_, text) in enumerate(rows):
            w = words(text)
            if len(w) >= least:
                ids += [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w] + [-2]
                owner += [k] * (len(w) + 1)
        self.keys = np.array([r[0] for r in rows], dtype=np.int64)
        self.q, self.owner = np.array(ids + [-2], dtype=np.int64), np.array(owner + [0], dtype=np.int64)

    def shard(self, docs: list[int], tokens: list[list[int]]) -> pa.RecordBatch | None:
        t = np.full(sum(map(len, tokens)) + len(tokens) + 1, -1, dtype=np.int64)
        start, at = np.empty(len(tokens), np.int64), 0
        for i, x in enumerate(tokens):
            start[i] = at
            t[at : at + len(x)] = x
            at += len(x) + 1
        edge = np.flatnonzero(t < 0)
        run = edge - np.r_[-1, edge[:-1]] - 1
        keep = np.zeros(len(t) + 1, np.int64)
        np.add.at(keep, edge[run >= self.least] - run[run >= self.least], 1)
        np.add.at(keep, edge[run >= self.least] + 1, -1)
        place = np.flatnonzero(np.cumsum(keep[:-1]))  # runs of item words long enough, each with its end mark
        if not len(place):
            return None
        s = t[place]
        sa = suffix_array(s, int(run.max()))
        j, p = search(s, sa, self.q, self.least)
        length, going = np.full(len(j), self.least), np.arange(len(j))
        while len(going):
            a, b = s[np.minimum(p[going] + length[going], len(s) - 1)], self.q[j[going] + length[going]]
            going = going[(a == b) & (a >= 0)]
            length[going] += 1
        doc = np.searchsorted(start, place[p], "right") - 1
        where = place[p] - start[doc]
        order = np.lexsort((where, -length, self.owner[j], doc))
        doc, item, length, where = doc[order], self.owner[j][order], length[order], where[order]
        first = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)] if len(doc) else np.zeros(0, bool)
        if not first.any():
            return None
        cols = [np.array(docs, np.int64)[doc[first]], self.keys[item[first]], length[first], where[first]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["d", "i", "n", "p"])


def _scan(batches: Iterator[pa.RecordBatch], items: _Items) -> Iterator[pa.RecordBatch]:
    docs, tokens, size, get = [], [], 0, items.vocabulary.get
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            w = [get(x, -1) for x in words(text.as_py())]
            if len(w) >= items.least:
                docs.append(doc)
                tokens.append(w)
                size += len(w)
            if size >= SHARD_WORDS:
                if out := items.shard(docs, tokens):
                    yield out
                docs, tokens, size = [], [], 0
    if docs and (out := items.shard(docs, tokens)):
        yield out


def _blocks(rows: Iterator) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most `ITEM_WORDS` words, one held at a time; an empty block if there are none."""
    block, size, some = [], 0, False
    for r in rows:
        n = len(words(r.t))
        if block and size + n > ITEM_WORDS:
            yield block
            block, size, some = [], 0, True
        block.append((r.i, r.t))
        size += n
    if block or not some:
        yield block


def leaked(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12) -> DataFrame:
    """(doc_key, item_key, n_words, word_at): the longest run of words, at least `least`, that a document and an item share.

    Words are maximal runs of a-z and 0-9 after lower-casing; of equally long runs the first place in the document
    (counted in words) is given. Texts that are null, blank or shorter than `least` words match nothing; rows with a
    null key are left out. Repeated rows repeat their result once per key. Items are searched in blocks of at most
    `ITEM_WORDS` words (a larger single item is a block of its own), so any number of items is allowed, and what the driver
    holds and sends to the workers is one block at a time; the corpus is read once a block.
    """
    spark = docs.sparkSession
    q = items.select(F.col(f"`{item_key}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("i is not null and t is not null").distinct()
    d = docs.select(F.col(f"`{doc_key}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).filter("d is not null and t is not null")
    schema = "d bigint, i bigint, n bigint, p bigint"
    scratch, found, last = Scratch(spark), None, None
    for block in _blocks(q.toLocalIterator()):
        if last is not None:  # more than one block: each is searched, written and let go before the next is fetched
            done = scratch.cut(last)
            found = done if found is None else found.unionByName(done)
            held.destroy()
        held = spark.sparkContext.broadcast(block)
        last = d.mapInArrow(lambda it, held=held: _scan(it, _Items(held.value, least)), schema)
    found = last if found is None else found.unionByName(last)
    best = found.groupBy("d", "i").agg(F.max(F.struct("n", (-F.col("p")).alias("p"))).alias("x"))
    return best.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), F.col("x.n").alias("n_words"), (-F.col("x.p")).alias("word_at"))


def without_leaks(docs: DataFrame, doc_key: str, leaks: DataFrame) -> DataFrame:
    """The documents that hold no item's passage; a document with a null key is kept."""
    return docs.join(leaks.select(F.col(doc_key).alias("__leaked")).distinct(), F.col(f"`{doc_key}`") == F.col("__leaked"), "left_anti")
