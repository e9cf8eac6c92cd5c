"""Positions and batches of rows in a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.session import Scratch


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """The rows with their position, from 0 on, in the given order; rows equal in it stand in any order among themselves.

    The rows are range-sorted once and written with the number of their partition and their place in it; partition
    sizes, summed up over one row per partition, give the positions. Reading both from the written table keeps them
    in agreement whatever the number of partitions. An empty table gives no rows.
    """
    inner = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = Scratch(df.sparkSession).cut(placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__pos", inner).drop("__at"))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(sizes, "__part").withColumn(name, F.col("__before") + F.col("__pos")).drop("__part", "__pos", "__before")


def batches(df: DataFrame, order: list[Column], size: int, name: str = "batch_no") -> DataFrame:
    """The rows with the number of their batch of `size` rows in the given order, from 0 on."""
    return numbered(df, order, "__row").withColumn(name, F.floor(F.col("__row") / size)).drop("__row")
