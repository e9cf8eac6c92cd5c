"""Clusters by shared keys, connected components and one-hop propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.session import Scratch


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) of every vertex with an edge to another; the component is its least vertex.

    Alternating large-star and small-star steps: a vertex links its larger neighbours, then its smaller ones, to the
    least vertex it knows; the number of rounds grows with the logarithm of the longest path. Null ends and loops are
    ignored. Each round is written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession)
    # A round changed nothing if number, sum and exclusive-or of the edges' hashes are as before.
    marks = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v")), "s": F.sum(F.xxhash64("u", "v") % (1 << 31))}
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e, before = scratch.cut_watching(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **marks)

    def star(pairs: DataFrame) -> DataFrame:
        """Each pair (u, v) with the least v of u."""
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")

    while before["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = star(large)
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new, after = scratch.cut_watching(small.filter("u <> v").distinct(), **marks)
        scratch.free(e)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()


def clusters_by_key(df: DataFrame, key: Column, member: str, place: Column, least_members: int = 2, least_places: int = 1, most_members: int | None = None) -> DataFrame:
    """(cluster_key, members, places) of keys shared by enough members at enough places; over-broad keys can be left out.

    Blank keys are none. Counts are distinct and pre-aggregated before the shuffle.
    """
    g = df.select(F.nullif(F.trim(key), F.lit("")).alias("cluster_key"), F.col(member).alias("m"), place.alias("p")).filter("cluster_key is not null").groupBy("cluster_key").agg(F.countDistinct("m").alias("members"), F.countDistinct("p").alias("places"))
    out = g.filter((F.col("members") >= least_members) & (F.col("places") >= least_places))
    return out.filter(F.col("members") <= most_members) if most_members else out


def propagate(df: DataFrame, key: Column, label: str, order: str, unset: list[str]) -> DataFrame:
    """The rows with `label` taken over, where unset, from the first labelled row of the same key (one hop, on the state before)."""
    k = F.nullif(F.trim(key), F.lit(""))
    have = df.withColumn("__k", k).filter(F.col("__k").isNotNull() & F.col(label).isNotNull() & ~F.col(label).isin(unset))
    first = have.groupBy("__k").agg(F.min_by(label, order).alias("__label"))
    open_ = F.col(label).isNull() | F.col(label).isin(unset)
    return df.withColumn("__k", k).join(first, "__k", "left").withColumn(label, F.when(open_, F.coalesce("__label", label)).otherwise(F.col(label))).drop("__k", "__label")


def cluster_summaries(df: DataFrame, keys: dict[str, Column], member: str, place: str, spot: str, label: Column, flag: Column, least: int, most: int) -> DataFrame:
    """(kind, cluster_key, members, places, spots, flagged, classes) of every key of each kind with `least` to `most` members.

    keys: kind -> key of a row, null for none. Members, places and spots are counted once each; flagged counts members for
    which the flag holds; classes is the histogram of labels as 'label:n,..'. Each row is spread to its kinds once, and
    counts are combined before the shuffle. Members must be unique in df.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(F.trim(c), F.lit("")).alias("key")) for k, c in keys.items()])
    r = df.select(F.explode(pairs).alias("k"), F.col(member).alias("m"), F.col(place).alias("p"), F.col(spot).alias("s"), label.alias("c"), F.coalesce(flag, F.lit(False)).alias("f"))
    r = r.select(F.col("k.kind").alias("kind"), F.col("k.key").alias("cluster_key"), "m", "p", "s", "c", "f").filter("cluster_key is not null")
    classes = r.groupBy("kind", "cluster_key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("kind", "cluster_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "c", F.col("n").cast("string")))), ",").alias("classes"))
    g = r.groupBy("kind", "cluster_key").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("p").alias("places"), F.countDistinct("s").alias("spots"), F.count_if("f").alias("flagged"))
    return g.filter(F.col("members").between(least, most)).join(classes, ["kind", "cluster_key"])
