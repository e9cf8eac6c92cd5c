"""Differences between two copies of a table, found by polynomial set reconciliation.

Each copy turns its rows into hashes, spreads them over buckets by the hash itself (so no key can make a bucket
hot) and publishes, per bucket, a handful of values of the characteristic polynomial prod(z - h) over the field
of 2^61-1 elements. The quotient of both copies' values is a rational function whose numerator and denominator
have exactly the differing hashes as roots. It is recovered by the extended Euclidean algorithm; its degrees must
leave spare evaluation points, agree with the row counts and split completely over the rows present, else the
bucket is tried again with twice as many points. Only the rows of differing keys are then read and compared field
by field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.core import hash_all, nz
from mergeloom.session import Scratch

P = (1 << 61) - 1
_P = np.uint64(P)
_M31, _M30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_U1, _U30, _U31, _U61 = np.uint64(1), np.uint64(30), np.uint64(31), np.uint64(61)
#: Evaluation points lie above every hash (hashes have 60 bits).
FIRST_POINT = 1 << 60
#: Evaluations beyond the degree bound, which verify a decoded bucket.
SPARE = 3


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a*b mod 2^61-1 for reduced operands, in 64-bit arithmetic."""
    ah, al, bh, bl = a >> _U31, a & _M31, b >> _U31, b & _M31
    mid = ah * bl + al * bh
    lo = al * bl
    s = ((ah * bh) << _U1) + (mid >> _U30) + ((mid & _M30) << _U31) + (lo & _P) + (lo >> _U61)
    s = (s & _P) + (s >> _U61)
    return np.where(s >= _P, s - _P, s)


def _padded(offsets: np.ndarray, values: np.ndarray, fill: int) -> np.ndarray:
    sizes = np.diff(offsets)
    width = max(1, int(sizes.max(initial=0)))
    out = np.full((len(sizes), width), fill, dtype=np.uint64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    offsets = col.offsets.to_numpy()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    return offsets - offsets[0], flat


def _evaluate(batches: Iterator[pa.RecordBatch], points: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            offsets, flat = _lists(batch.column(1))
            cols = []
            for i in range(points):
                z = np.uint64(FIRST_POINT + i)
                m = _padded(offsets, z - flat, 1)
                while m.shape[1] > 1:
                    if m.shape[1] % 2:
                        m = np.concatenate([m, np.ones((len(m), 1), np.uint64)], axis=1)
                    half = m.shape[1] // 2
                    m = mulmod(m[:, :half], m[:, half:])
                cols.append(m[:, 0])
            ev = np.stack(cols, axis=1).astype(np.int64).ravel()
            off = np.arange(0, len(ev) + 1, points, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(off, pa.array(ev))],
                ["bucket", "n", "ev"],
            )


def _trim(a: list[int]) -> list[int]:
    while a and a[-1] == 0:
        a.pop()
    return a


def _divmod_poly(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, inv, q = a[:], pow(b[-1], P - 2, P), [0] * max(1, len(a) - len(b) + 1)
    for i in range(len(a) - len(b), -1, -1):
        c = a[i + len(b) - 1] * inv % P
        q[i] = c
        if c:
            for j, y in enumerate(b):
                a[i + j] = (a[i + j] - c * y) % P
    return _trim(q), _trim(a)


def _newton(xs: list[int], ys: list[int]) -> tuple[list[int], list[int]]:
    """The polynomial through the points, and the product of (z - x)."""
    coef = ys[:]
    for k in range(1, len(xs)):
        for i in range(len(xs) - 1, k - 1, -1):
            coef[i] = (coef[i] - coef[i - 1]) * pow(xs[i] - xs[i - k], P - 2, P) % P
    out, base = [0] * len(xs), [1]
    for i, c in enumerate(coef):
        for j, b in enumerate(base):
            out[j] = (out[j] + c * b) % P
        base = [((base[j - 1] if j else 0) - (xs[i] * base[j] if j < len(base) else 0)) % P for j in range(len(base) + 1)]
    return _trim(out), base


def rational(ratio: list[int], surplus: int) -> tuple[list[int], list[int]] | None:
    """Monic numerator and denominator of the lowest degrees that explain all values, or None if unverified.

    surplus: rows of the first copy less rows of the second, which the degrees must reproduce.
    """
    m = len(ratio)
    f, big = _newton([FIRST_POINT + i for i in range(m)], ratio)
    r0, r1, t0, t1 = big, f, [], [1]
    while r1:
        if m - (len(r1) - 1) - (len(t1) - 1) >= SPARE:
            if len(r1) - len(t1) == surplus and r1[-1] == t1[-1]:
                inv = pow(r1[-1], P - 2, P)
                return [c * inv % P for c in r1], [c * inv % P for c in t1]
            return None
        q, rest = _divmod_poly(r0, r1)
        nxt = [0] * max(len(t0), len(q) + len(t1) - 1)
        for i, c in enumerate(t0):
            nxt[i] = c
        for i, a in enumerate(q):
            for j, b in enumerate(t1):
                nxt[i + j] = (nxt[i + j] - a * b) % P
        r0, r1, t0, t1 = r1, rest, t1, _trim(nxt)
    return None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = batch.to_pydict()
        rows: dict[str, list] = {"bucket": [], "ok": [], "num": [], "den": []}
        for bucket, na, ea, nb, eb in zip(d["bucket"], d["na"], d["ea"], d["nb"], d["eb"], strict=True):
            points = len(ea or eb)
            ea, eb = ea or [1] * points, eb or [1] * points
            found = rational([a * pow(b, P - 2, P) % P for a, b in zip(ea, eb, strict=True)], (na or 0) - (nb or 0))
            rows["bucket"].append(bucket)
            rows["ok"].append(found is not None)
            rows["num"].append(found[0] if found else [1])
            rows["den"].append(found[1] if found else [1])
        types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))


def _roots(poly: list[int], elements: list[int] | None) -> list[int]:
    """Positions of the elements that are roots."""
    if not elements or len(poly) == 1:
        return []
    x = np.array(elements, dtype=np.uint64)
    acc = np.full(len(x), poly[-1], dtype=np.uint64)
    for c in reversed(poly[:-1]):
        acc = mulmod(acc, x) + np.uint64(c)
        acc = np.where(acc >= _P, acc - _P, acc)
    return np.flatnonzero(acc == 0).tolist()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = batch.to_pydict()
        out: dict[str, list] = {"bucket": [], "verified": [], "keys": []}
        for i, bucket in enumerate(d["bucket"]):
            a, b = _roots(d["num"][i], d["el_a"][i]), _roots(d["den"][i], d["el_b"][i])
            out["bucket"].append(bucket)
            out["verified"].append(len(a) == len(d["num"][i]) - 1 and len(b) == len(d["den"][i]) - 1)
            out["keys"].append(sorted({*(d["key_a"][i][j] for j in a), *(d["key_b"][i][j] for j in b)}))
        types = [pa.int64(), pa.bool_(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


def _cell(c: Column, kind: str) -> Column:
    """A text that is equal only for values that count as equal: doubles go by cells of 0.000001."""
    if kind in ("double", "float"):
        d = c.cast("double")
        return F.when(F.abs(d) < 1e9, F.round(d * 1e6).cast("bigint").cast("string")).otherwise(d.cast("string"))
    return nz(c) if kind == "string" else c.cast("string")


def _side(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    out = df.select(nz(F.col(f"`{key}`").cast("string")).alias("k"), *[F.col(f"`{f}`").alias(f"v{i}") for i, f in enumerate(fields)])
    h = hash_all(F.col("k"), *[_cell(F.col(f"v{i}"), kinds[f]) for i, f in enumerate(fields)])
    return out.filter("k is not null").withColumn("h", h)


def differing_keys(a: DataFrame, b: DataFrame, scratch: Scratch, bucket_rows: int = 64, first_bound: int = 8) -> DataFrame:
    """Keys of the rows (k, h) that only one side holds.

    The bound is doubled until every bucket is verified. Once it has reached the rows that the fullest bucket has on both
    sides it cannot be exceeded; keys of roots then count even if a bucket's number of roots is off, as two rows with
    one hash would make it, for the fields of all reported keys are compared anyway.
    """
    buckets = max(1, max(a.count(), b.count()) // bucket_rows)

    def hashed(side: DataFrame) -> tuple[DataFrame, int]:
        el = F.col("h").bitwiseAND(F.lit((1 << 60) - 1)).alias("el")
        grouped = side.groupBy(F.pmod(F.hash("h"), F.lit(buckets)).cast("bigint").alias("bucket")).agg(F.collect_set(F.struct(el, "k")).alias("s"))
        cut, seen = scratch.cut_watching(grouped.select("bucket", F.col("s.el").alias("el"), F.col("s.k").alias("key")), most=F.coalesce(F.max(F.size("el")), F.lit(0)))
        return cut, int(seen["most"])

    (ha, most_a), (hb, most_b) = hashed(a), hashed(b)
    pending, found, bound = None, [], first_bound
    while True:
        points = bound + SPARE

        def sketch(side: DataFrame, n: str, ev: str, points: int = points, pending: DataFrame | None = pending) -> DataFrame:
            some = side.select("bucket", "el")
            some = some if pending is None else some.join(pending, "bucket", "left_semi")
            return some.mapInArrow(lambda it: _evaluate(it, points), "bucket bigint, n bigint, ev array<bigint>").toDF("bucket", n, ev)

        both = sketch(ha, "na", "ea").join(sketch(hb, "nb", "eb"), "bucket", "full").filter("not (na <=> nb and ea <=> eb)")
        # Decoding costs far more than its few bytes suggest: an explicit number of partitions is not coalesced.
        both = both.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
        decoded = scratch.cut(both.mapInArrow(_decode, "bucket bigint, ok boolean, num array<bigint>, den array<bigint>"))
        tried = (
            decoded.filter("ok")
            .join(ha.toDF("bucket", "el_a", "key_a"), "bucket", "left")
            .join(hb.toDF("bucket", "el_b", "key_b"), "bucket", "left")
            .select("bucket", "num", "den", "el_a", "key_a", "el_b", "key_b")
        )
        rooted = tried.mapInArrow(_search, "bucket bigint, verified boolean, keys array<string>")
        if bound >= most_a + most_b:
            rooted = rooted.withColumn("verified", F.lit(True))
        rooted = scratch.cut(rooted)
        found.append(rooted.filter("verified").select(F.explode("keys").alias("k")))
        pending, left = scratch.cut_counting(decoded.select("bucket").join(rooted.filter("verified").select("bucket"), "bucket", "left_anti"), F.lit(True))
        scratch.free(decoded)
        if not left or bound >= most_a + most_b:
            break
        bound *= 2
    keys = found[0]
    for more in found[1:]:
        keys = keys.union(more)
    scratch.free(ha, hb)
    return keys.distinct()


def compare_fields(a: DataFrame, b: DataFrame, fields: list[str], kinds: dict[str, str]) -> DataFrame:
    """(record_key, diff_kind, field_name) of rows (k, v0..) from both sides, by extremes per key and side.

    Some row of one side differs from some row of the other exactly if the values of both together are not all
    one, so least and greatest value and the count of nulls per side suffice and no pair of rows is formed.
    """
    def value(i: int) -> Column:
        c = F.col(f"v{i}")
        return c.cast("double") if kinds[fields[i]] in ("double", "float") else nz(c.cast("string"))

    tagged = a.select("k", F.lit(True).alias("a"), *[value(i).alias(f"v{i}") for i in range(len(fields))]).unionByName(
        b.select("k", F.lit(False).alias("a"), *[value(i).alias(f"v{i}") for i in range(len(fields))])
    )
    aggs = []
    for s, here in (("a", F.col("a")), ("b", ~F.col("a"))):
        aggs.append(F.count_if(here).alias(f"n_{s}"))
        for i in range(len(fields)):
            v = F.when(here, F.col(f"v{i}"))
            aggs += [F.min(v).alias(f"lo{i}_{s}"), F.max(v).alias(f"hi{i}_{s}"), F.count(v).alias(f"c{i}_{s}")]
    g = tagged.groupBy("k").agg(*aggs)

    def unequal(i: int) -> Column:
        lo_a, hi_a, lo_b, hi_b, c_a, c_b = (F.col(f"{x}{i}_{s}") for s, x in (("a", "lo"), ("a", "hi"), ("b", "lo"), ("b", "hi"), ("a", "c"), ("b", "c")))
        nulls = ((c_a < F.col("n_a")) & (c_b > 0)) | ((c_a > 0) & (c_b < F.col("n_b")))
        if kinds[fields[i]] in ("double", "float"):
            apart = lambda x, y: (F.isnan(x) != F.isnan(y)) | (~F.isnan(x) & ~F.isnan(y) & (F.abs(x - y) > 1e-6))
            values = apart(hi_a, lo_b) | apart(hi_b, lo_a)
        else:
            values = ~((lo_a == hi_a) & (lo_b == hi_b) & (lo_a == lo_b))
        return nulls | F.coalesce(values, F.lit(False))

    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    kind = F.when(F.col("n_b") == 0, "missing_in_replica").when(F.col("n_a") == 0, "missing_in_source")
    found = F.when(
        both, F.array_compact(F.array(*[F.when(unequal(i), F.struct(F.lit("differs").alias("diff_kind"), F.lit(f).alias("field_name"))) for i, f in enumerate(fields)]))
    ).otherwise(F.array(F.struct(kind.alias("diff_kind"), F.lit("").alias("field_name"))))
    return g.select(F.col("k").alias("record_key"), F.explode(found).alias("x")).select("record_key", "x.diff_kind", "x.field_name")


def diff_copies(source: DataFrame, replica: DataFrame, key: str, fields: list[str], bucket_rows: int = 64, first_bound: int = 8) -> DataFrame:
    """Rows missing on either side and unequal fields, as (record_key, diff_kind, field_name).

    Keys are compared trimmed; rows whose key is null or blank cannot be compared and are left out. Strings are
    compared trimmed and case-sensitively with blank as null, doubles up to 0.000001, NaN equals NaN, null differs
    from every value. A key may occur any number of times on either side: it is in order if both sides hold the same
    set of rows for it, else a field differs if some row of one side differs from some row of the other; exact copies
    change nothing. Other columns are ignored. Empty tables are
    allowed: every key of the other side is then missing.
    """
    scratch = Scratch(source.sparkSession)
    a, b = _side(source, key, fields), _side(replica, key, fields)
    keys = scratch.cut(differing_keys(a.select("k", "h"), b.select("k", "h"), scratch, bucket_rows, first_bound))
    kinds = dict(source.dtypes)
    return compare_fields(a.join(keys, "k", "left_semi").drop("h"), b.join(keys, "k", "left_semi").drop("h"), fields, kinds)


def count_mismatches(counts: DataFrame, replica: DataFrame, key: str, batch: str, name: str, number: str, prefix: str) -> DataFrame:
    """Batches whose recorded count is not the number of distinct keys the replica holds.

    Null counts and null names are not judged; blank keys are no keys; a batch the replica lacks counts 0.
    Repeated names are judged row by row.
    """
    have = replica.select(F.concat(F.lit(prefix), F.col(f"`{batch}`")).alias("name"), nz(F.col(f"`{key}`").cast("string")).alias("k"))
    have = have.groupBy("name").agg(F.countDistinct("k").alias("have"))
    want = counts.select(F.col(f"`{name}`").alias("name"), F.col(f"`{number}`").alias("want")).filter("name is not null and want is not null")
    bad = want.join(have, "name", "left").filter("want <> coalesce(have, 0)")
    return bad.select(F.col("name").alias("record_key"), F.lit("count_mismatch").alias("diff_kind"), F.lit(number).alias("field_name")).distinct()
