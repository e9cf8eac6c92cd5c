"""Pairs of the members of groups, spread over tasks in chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of one group are paired in chunks of about this many.
CHUNK = 256


def split_join(left: DataFrame, right: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """Inner join by one key, with the right rows of a key dealt out over parts of about `chunk` rows.

    Left rows of such a key go to every part, so that each pair still meets once; a key of few right rows stays whole.
    The number of parts follows the key's own size, so no key is too large for a task. right is read twice.
    """
    parts = right.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("__parts")).filter("__parts > 1")
    one = F.coalesce("__parts", F.lit(1))
    a = left.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), one - 1))).drop("__parts")
    b = right.join(parts, key, "left").withColumn("__part", F.pmod(F.xxhash64(*right.columns), one).cast("int")).drop("__parts")
    return a.join(b, [key, "__part"]).drop("__part")


def distinct_groups(members: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n): of the groups with the same two or more members one, with its size. members: without repeats or nulls.

    Sets of members are compared by size, least and greatest member and two 64-bit checksums.
    """
    k = F.col(key)
    signed = members.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.bit_xor(F.xxhash64(k)).alias("x"), F.bit_xor(F.xxhash64(k, F.lit(1))).alias("y"),
    ).filter("n > 1")
    return signed.groupBy("n", "lo", "hi", "x", "y").agg(F.min(group).alias(group)).select(group, "n")


def member_pairs(members: DataFrame, group: str, key: str, chunk: int = CHUNK) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of members that share a group.

    members: (group, key) without repeats or nulls. A group of n members is cut into ceil(n/chunk) chunks by the
    key's hash; chunks, not members, meet by the group, and each pair of chunks is joined on its own, so the largest
    group is spread like all others. Groups with the same members are expanded once.
    """
    m = members.select(F.col(group).alias("g"), F.col(key).alias("k"))
    one = distinct_groups(m, "g", "k").select("g", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    chunked = m.join(one, "g").withColumn("c", F.pmod(F.hash("k"), F.col("chunks")))
    left = chunked.select("g", F.col("c").alias("c_a"), F.col("k").alias("a"), F.explode(F.sequence(F.col("c"), F.col("chunks") - 1)).alias("c_b"))
    right = chunked.select("g", F.col("c").alias("c_b"), F.col("k").alias("b"))
    met = left.join(right, ["g", "c_b"]).filter("c_a <> c_b or a < b")
    return met.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()


def linked_member_pairs(links: DataFrame, members: DataFrame, group: str, key: str, chunk: int = CHUNK) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of members of two linked groups.

    links: distinct (ga, gb), ga <> gb; members: (group, key) without repeats or nulls. Chunked as in `member_pairs`.
    """
    m = members.select(F.col(group).alias("g"), F.col(key).alias("k"))
    sizes = m.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("n"))
    touched = links.select(F.col("ga").alias("g")).unionByName(links.select(F.col("gb").alias("g"))).distinct()
    sizes = sizes.join(touched, "g", "left_semi")
    spread = links.join(sizes.toDF("ga", "na"), "ga").join(sizes.toDF("gb", "nb"), "gb")
    spread = spread.withColumn("ca", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    chunked = m.join(sizes, "g").select("g", F.pmod(F.hash("k"), F.col("n")).alias("c"), "k")
    met = spread.join(chunked.toDF("ga", "ca", "a"), ["ga", "ca"]).select("a", "gb", "cb").join(chunked.toDF("gb", "cb", "b"), ["gb", "cb"]).filter("a <> b")
    return met.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
