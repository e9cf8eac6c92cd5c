"""Nearest vectors by cosine: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query vectors held by a task at once (their count times their dimension stays below this).
BLOCK_VALUES = 4_000_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _score(batches: Iterator[pa.RecordBatch], ids: list, vectors: np.ndarray, k: int, least: float, digits: int) -> Iterator[pa.RecordBatch]:
    q = _unit(vectors)
    for batch in batches:
        keep = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == q.shape[1]]
        if not keep:
            continue
        own = [i for i, _ in keep]
        c = np.round(_unit(np.array([v for _, v in keep], dtype=np.float64)) @ q.T, digits)
        out: tuple[list, list, list] = ([], [], [])
        for j, qid in enumerate(ids):
            rows = np.flatnonzero(c[:, j] >= least)
            best = sorted(((-c[r, j], own[r]) for r in rows if own[r] != qid))[:k]
            out[0].extend([qid] * len(best))
            out[1].extend(i for _, i in best)
            out[2].extend(-s for s, _ in best)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.float64())], ["qid", "hit", "c"])


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, least: float = -2.0, digits: int = 5) -> DataFrame:
    """(qid, hit, c): for each query the k rows of greatest cosine (rounded; ties to the least key), itself left out.

    Every row is compared with every query. Queries are taken in blocks of bounded size; each task keeps the k best of
    a batch, and an aggregate merges them, so that neither a task nor the driver gathers all scores. Null vectors, and
    vectors of another length than the first query's, match nothing; a zero vector has cosine 0.
    """
    kind = dict(rows.dtypes)[key]
    data = rows.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    found, block = None, []

    def scored(block: list) -> DataFrame:
        ids, vectors = [i for i, _ in block], np.array([v for _, v in block], dtype=np.float64)
        return data.mapInArrow(lambda it: _score(it, ids, vectors, k, least, digits), f"qid {kind}, hit {kind}, c double")

    width = 0
    for r in queries.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v")).filter("i is not null and v is not null").toLocalIterator():
        width = width or len(r.v)
        if len(r.v) != width:
            continue
        if (len(block) + 1) * width > BLOCK_VALUES:
            found, block = scored(block) if found is None else found.unionByName(scored(block)), []
        block.append((r.i, r.v))
    if block:
        found = scored(block) if found is None else found.unionByName(scored(block))
    if found is None:
        return rows.sparkSession.createDataFrame([], f"qid {kind}, hit {kind}, c double")
    top = found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("n"), "hit"))), 1, k).alias("t"))
    return top.select("qid", F.explode("t").alias("x")).select("qid", "x.hit", (-F.col("x.n")).alias("c"))
