"""Changes between consecutive full snapshots, through a bucketed key-to-hash index.

Of a delivery only a key and a hash per key are kept, as a table bucketed by key. The next delivery is reduced to the
same form and joined to it bucket by bucket, without another shuffle; the new index then takes the old one's place.
Full old and new values are read back only for the keys that changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.core import hash_all, nz
from mergeloom.session import Scratch, new_path


class KeyIndex:
    """A key-to-hash table bucketed by key: the memory of the last delivery.

    The number of buckets is part of the folder's name, so that an index can be opened again by its path alone, in any
    session. Buckets hold about `ROWS` keys each, so that an index that grows is cut into more of them when it is
    written anew; an old and a new index with different numbers of buckets can still be compared, by one shuffle.
    """

    #: Keys that a bucket is meant to hold.
    ROWS = 2_000_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.name = spark, path, f"key_index_{uuid.uuid4().hex}"
        buckets = path.rsplit("-", 1)[1]
        spark.sql(f"create table {self.name} (k string, h bigint) using parquet clustered by (k) sorted by (k) into {buckets} buckets location '{path}'")

    @classmethod
    def write(cls, df: DataFrame, folder: str | None = None, keys: int | None = None) -> KeyIndex:
        """The index of rows (k, h). keys: about how many there are, if known."""
        spark = df.sparkSession
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(keys or 0) // cls.ROWS))
        path, name = f"{folder or new_path(spark)}/index-{uuid.uuid4().hex}-{buckets}", f"new_index_{uuid.uuid4().hex}"
        df.select("k", "h").write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "k").sortBy("k").saveAsTable(name)
        spark.sql(f"drop table {name}")  # the files stay
        return cls(spark, path)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self, files: bool = True) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        if files:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _hash(fields: dict[str, Callable[[Column], Column]]) -> Column:
    return hash_all(*[normal(F.col(f"`{f}`")) for f, normal in fields.items()])


def deliveries(snapshots: DataFrame, date: str) -> list:
    """The delivery dates in order; there are as few as deliveries were made."""
    return [r[0] for r in snapshots.select(F.col(f"`{date}`").alias("d")).filter("d is not null").distinct().orderBy("d").collect()]


def _latest(rows: DataFrame, key: str, fields: dict, order: list[str], whole: bool = False) -> DataFrame:
    """One row per key of a delivery: the latest by `order`, ties by the greater hash."""
    h = _hash(fields)
    rows = rows.withColumn("__h", h).withColumn("k", nz(F.col(f"`{key}`").cast("string"))).filter("k is not null")
    last = F.struct(*[F.col(f"`{c}`") for c in order], "__h")
    what = F.struct(F.col("__h").alias("h"), *[normal(F.col(f"`{f}`")).alias(f"f{i}") for i, (f, normal) in enumerate(fields.items())]) if whole else F.struct(F.col("__h").alias("h"))
    return rows.groupBy("k").agg(F.max_by(what, last).alias("x")).select("k", "x.*")


def _current(snapshots: DataFrame, key: str, date: str, at, fields: dict, order: list[str], whole: bool = False) -> DataFrame:
    return _latest(snapshots.filter(F.col(f"`{date}`") == F.lit(at)), key, fields, order, whole)


def take_delivery(
    last: KeyIndex | None, delivery: DataFrame, key: str, fields: dict[str, Callable[[Column], Column]], order: list[str], folder: str | None = None, keys: int | None = None
) -> tuple[DataFrame, KeyIndex]:
    """(changes, index) of one delivery against the index of the delivery before: changes are (key, change_kind).

    The new index is written first, then the last one is probed with it, bucket by bucket and without a shuffle; keys
    that meet no row come out as 'added' or 'removed', unequal hashes as 'changed'. The last index is left to the
    caller, who drops it once the changes are written; the new index takes its place and can be opened again by its
    `path` when the next delivery comes. Without a last index everything is new and no change is reported. Fields,
    order, ties and nulls as in `snapshot_changes`.
    """
    now = KeyIndex.write(_latest(delivery, key, fields, order), folder, keys)
    if last is None:
        return now.read().limit(0).select(F.col("k").alias(key), F.lit("").alias("change_kind")), now
    both = now.read().withColumnRenamed("h", "h1").join(last.read().withColumnRenamed("h", "h0"), "k", "full")
    kind = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.select(F.col("k").alias(key), kind.alias("change_kind")).filter("change_kind is not null"), now


def snapshot_changes(snapshots: DataFrame, key: str, date: str, fields: dict[str, Callable[[Column], Column]], order: list[str]) -> DataFrame:
    """(key, date, change_kind) between consecutive deliveries: 'added', 'removed' or 'changed'.

    fields: compared columns and how each is normalised; null equals null and differs from any value. Within a
    delivery the row with the greatest `order` (nulls least) counts for a key, ties go to the greater hash, exact
    copies change nothing. Keys are compared trimmed; rows with blank key or null date are left out. The first
    delivery, and an empty table, give no rows. This runs `take_delivery` over a table that holds all deliveries.
    """
    scratch = Scratch(snapshots.sparkSession)
    out, last = None, None
    for at in deliveries(snapshots, date):
        changes, now = take_delivery(last, snapshots.filter(F.col(f"`{date}`") == F.lit(at)), key, fields, order)
        if last:
            some = scratch.cut(changes.select(key, F.lit(at).cast("date").alias(date), "change_kind"))
            out = some if out is None else out.unionByName(some)
            last.drop()
        last = now
    if last:
        last.drop()
    if out is None:
        return snapshots.limit(0).select(F.col(f"`{key}`").cast("string").alias(key), F.lit(None).cast("date").alias(date), F.lit("").alias("change_kind"))
    return out


def changed_values(snapshots: DataFrame, key: str, date: str, fields: dict[str, Callable[[Column], Column]], order: list[str]) -> DataFrame:
    """(key, date, field_name, old_value, new_value) of every changed field, values as normalised for comparison.

    Old and new rows are fetched only for the keys that the index reports as changed. Nulls and ties as in
    `snapshot_changes`.
    """
    scratch = Scratch(snapshots.sparkSession)
    changes = scratch.cut(snapshot_changes(snapshots, key, date, fields, order).filter("change_kind = 'changed'").select(F.col(key).alias("k"), F.col(date).alias("d")))
    dates, out = deliveries(snapshots, date), None
    for before, at in zip(dates, dates[1:]):
        keys = changes.filter(F.col("d") == F.lit(at)).select("k")
        rows = snapshots.withColumn("__k", nz(F.col(f"`{key}`").cast("string"))).join(keys.withColumnRenamed("k", "__k"), "__k", "left_semi").drop("__k")
        old = _current(rows, key, date, before, fields, order, True)
        new = _current(rows, key, date, at, fields, order, True)
        both = old.select("k", F.struct(*[f"f{i}" for i in range(len(fields))]).alias("o")).join(new.select("k", F.struct(*[f"f{i}" for i in range(len(fields))]).alias("n")), "k")
        parts = F.array_compact(F.array(*[F.when(~F.col(f"o.f{i}").eqNullSafe(F.col(f"n.f{i}")), F.struct(F.lit(f).alias("field_name"), F.col(f"o.f{i}").alias("old_value"), F.col(f"n.f{i}").alias("new_value"))) for i, f in enumerate(fields)]))
        some = both.select(F.col("k").alias(key), F.lit(at).cast("date").alias(date), F.explode(parts).alias("x")).select(key, date, "x.*")
        out = some if out is None else out.unionByName(some)
    if out is None:
        return changes.select(F.col("k").alias(key), F.col("d").alias(date), *[F.lit("").alias(c) for c in ("field_name", "old_value", "new_value")])
    return out
