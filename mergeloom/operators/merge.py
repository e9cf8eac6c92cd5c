"""Merging tables: upserts, survivorship, change capture, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_known(c: str, order: Column) -> Column:
    """The first non-null value by the given order, as an aggregate."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], guarded: dict[str, list[str]] | None = None) -> DataFrame:
    """Old rows with new values where these are not null, and the rows only new has, over old's columns.

    key: one column or several, of which a null equals nothing. guarded: columns that keep an old value unless it is null or
    one of the given ones. New's keys must be unique; columns that new lacks stay as they are, columns that old lacks are
    dropped.
    """
    keys = [key] if isinstance(key, str) else key
    n = new.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in keys and c in old.columns])
    both = old.withColumn("__old", F.lit(True)).join(n, [F.col(k) == F.col(f"__key_{k}") for k in keys], "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(c, f"__key_{c}").alias(c)
        if c not in new.columns:
            return F.col(c)
        taken = F.coalesce(f"__n_{c}", c)
        if guarded and c in guarded:
            taken = F.when(F.col("__old").isNull() | F.col(c).isNull() | F.col(c).isin(guarded[c]), taken).otherwise(F.col(c))
        return taken.alias(c)

    return both.select(*[value(c) for c in old.columns])


def scoped_replace(old: DataFrame, new: DataFrame, scope: DataFrame, by: str) -> DataFrame:
    """Old rows outside the scope and new rows inside it. scope: distinct values of `by`; a null is in no scope."""
    some = scope.select(by).filter(F.col(by).isNotNull()).distinct()
    return old.join(some, by, "left_anti").unionByName(new.join(some, by, "left_semi")).select(*old.columns)


def changed_columns(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """New values of the rows of which some field differs from the old one, with the list `changed`; a null differs from a value."""
    o = old.select(F.col(key), F.struct(*fields).alias("__o"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col("__o")[f]), F.lit(f)) for f in fields]))
    return new.select(key, *fields).join(o, key).withColumn("changed", changed).filter(F.size("changed") > 0).drop("__o")


def next_batch(rows: DataFrame, store: DataFrame | None, by: str, mark: str, size: int) -> DataFrame:
    """The first `size` rows of each source past its watermark. store: (by, last_value), None if nothing was read yet."""
    if store is not None:
        rows = rows.join(store.select(by, "last_value"), by, "left").filter(F.col("last_value").isNull() | (F.col(mark) > F.col("last_value"))).drop("last_value")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(mark))).filter(F.col("__n") <= size).drop("__n")


def advance(store: DataFrame | None, done: DataFrame, by: str, mark: str) -> DataFrame:
    """The watermarks after rows have been taken: they move only as far as rows were done, and never back."""
    new = done.groupBy(by).agg(F.max(mark).alias("last_value"))
    return new if store is None else store.select(by, "last_value").unionByName(new).groupBy(by).agg(F.max("last_value").alias("last_value"))


def combine(files: list[tuple[DataFrame, Column]], by: list[str]) -> DataFrame:
    """Rows of several tables, the first of each key by table and then by each table's own order; columns may differ."""
    out = None
    for i, (df, order) in enumerate(files):
        one = df.withColumn("__o", F.struct(F.lit(i).alias("file"), order.cast("string").alias("text"), order.alias("at")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return keep_first(out, by, [F.col("__o.file"), F.col("__o.at")]).drop("__o")


def accounting(df: DataFrame, status: Column) -> DataFrame:
    """(status, n, total, balanced): rows of each status against an independent count of all rows."""
    parts = df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(1))  # one row per status
    whole = df.agg(F.count(F.lit(1))).scalar()
    return parts.withColumn("total", F.sum("n").over(one)).withColumn("balanced", F.col("total") == whole)


def merge_by_state(old: DataFrame, new: DataFrame, key: str, state: str, open_states: list[str]) -> DataFrame:
    """Old and new rows by key with an outcome: 'inserted', 'kept' (new lacks it), 'replaced' (the old state is open or null) or 'protected'."""
    o, n = old.select(F.col(key).alias("__k"), F.struct(*old.columns).alias("o")), new.select(F.col(key).alias("__j"), F.struct(*old.columns).alias("n"))
    both = o.join(n, F.col("__k") == F.col("__j"), "full")
    free = F.col(f"o.{state}").isNull() | F.col(f"o.{state}").isin(open_states)
    outcome = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").when(free, "replaced").otherwise("protected")
    row = F.when(outcome.isin("inserted", "replaced"), F.col("n")).otherwise(F.col("o"))
    return both.select(outcome.alias("outcome"), row.alias("r")).select("outcome", "r.*")


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """New rows whose key old does not hold, the first of each key by `order`; keys with a null are never equal."""
    complete = F.lit(True)
    for k in key:
        complete = complete & F.col(k).isNotNull()
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    numbered = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return numbered.filter((F.col("__n") == 1) | ~complete).drop("__n")


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def change_events(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_changed, old_value, new_value) where both values are known and differ."""
    o = old.select(F.col(key), F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields])).alias("o"))
    n = new.select(F.col(key), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field_changed", "new_value"))
    joined = n.filter("new_value is not null").join(o, key).withColumn("old_value", F.col("o")[F.col("field_changed")])
    return joined.filter("old_value <> new_value").select(key, "field_changed", "old_value", "new_value")


def pull(df: DataFrame, row_id: str, last_id: Column, changed: str, last_sync: Column) -> DataFrame:
    """Rows past the watermark: new ids, and old ids changed since the last synchronisation."""
    return df.filter((F.col(row_id) > last_id) | ((F.col(row_id) <= last_id) & (F.col(changed) > last_sync)))


def only_in(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti")


def replace_guard(current: int, incoming: int, floor: int, share: float = 0.95) -> None:
    """Refuses a full replacement that is empty, below its floor or much smaller than what it replaces."""
    if incoming == 0 or incoming < floor or incoming < share * current:
        raise ValueError(f"replacement refused: {incoming} rows for {current}, floor {floor}")


def collapse(df: DataFrame, by: list[str], order: Column, first: list[str], largest: list[str], least: list[str], sets: dict[str, str]) -> DataFrame:
    """One row per group: first known values by `order`, extremes, and sorted joined sets of distinct values."""
    aggs = [first_known(c, order).alias(c) for c in first] + [F.max(c).alias(f"max_{c}") for c in largest] + [F.min(c).alias(f"min_{c}") for c in least]
    aggs += [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name) for name, c in sets.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
