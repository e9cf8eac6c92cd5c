"""Groups from pairwise links, by low-diameter decomposition.

Every vertex draws an exponentially distributed head start. Clusters grow from all vertices at once, one edge per step;
a vertex joins the cluster whose head start less distance is greatest, so that clusters stay shallow and few edges run
between them. After a fixed number of steps clusters contract to their centres, the edges between clusters form a
smaller graph, and the same is done again until no edge is left. Assignments of all levels are then composed.

Vertices are numbered once. The edges of a level are stored in buckets of their first end, together with a loop at every
vertex. A step joins them to the state, which is partitioned in the same way, and takes the best offer per vertex: only
offers that beat a vertex's own head start are shuffled, combined on the map side first. All steps of a level run as one
job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mergeloom.session import Scratch, new_path

#: Rate of the head starts: an edge runs between clusters with a probability of about 1-exp(-RATE).
RATE = 0.1
#: Steps for which clusters grow before they contract.
STEPS = 3
#: Edges of one vertex that may lie in one bucket; those of a vertex with more are spread over branches.
DEGREE = 20_000
#: What marks names of branches and groups, which are no records.
_MARK = "\u0001"


def spread_hubs(edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """The edges (u, v) with those of a vertex of more than `degree` edges moved to branches, which are tied to it.

    Branches are few (edges / degree in all) and connect what the hub connected. A hub of so many branches that these
    are too many themselves, degree squared, is left with them.
    """
    hubs = edges.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / degree).cast("int").alias("parts")).filter("parts > 1")
    branch = lambda hub, s: F.concat(F.lit(_MARK), hub, F.lit(_MARK), s.cast("string"))
    hubs_v = hubs.select(F.col("u").alias("v"), F.col("parts").alias("parts_v"))
    moved = edges.join(hubs, "u", "left").join(hubs_v, "v", "left").select(
        F.when(F.col("parts").isNull(), F.col("u")).otherwise(branch(F.col("u"), F.pmod(F.hash("v"), F.col("parts")))).alias("u"),
        F.when(F.col("parts_v").isNull(), F.col("v")).otherwise(branch(F.col("v"), F.pmod(F.hash("u"), F.col("parts_v")))).alias("v"),
    )
    ties = hubs.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s")).select("u", branch(F.col("u"), F.col("s")).alias("v"))
    return moved.unionByName(ties).unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _head_start(v: Column, level: int) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(v, F.lit(level)), 11).cast("double") + 1) / float(1 << 53)
    return -F.log(uniform) / RATE


class _Edges:
    """Symmetric edges (u, v, w) in buckets of u, without repeats, with a loop (u, u, 0) at every vertex; left: number of edges."""

    def __init__(self, edges: DataFrame):
        self.spark, self.name, self.path = edges.sparkSession, f"level_edges_{uuid.uuid4().hex}", new_path(edges.sparkSession)
        row = lambda v, w: F.struct("u", F.col(v).alias("v"), F.lit(w).alias("w"))
        buckets, seen = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), Observation()
        both = edges.repartition(buckets, "u").select(F.explode(F.array(row("v", 1), row("u", 0))).alias("x")).select("x.*").distinct().observe(seen, F.sum("w").alias("left"))
        both.write.format("parquet").option("path", self.path).option("compression", "zstd").bucketBy(buckets, "u").sortBy("u").saveAsTable(self.name)
        self.left = int(seen.get["left"] or 0)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _decompose(edges: _Edges, level: int) -> DataFrame:
    """(u, c): the cluster centre of every vertex after all steps."""
    state = edges.read().filter("w = 0").select("u", _head_start(F.col("u"), level).alias("k"), F.col("u").alias("c"))
    for _ in range(STEPS):
        offers = edges.read().join(state, "u").select("v", (F.col("k") - F.col("w")).alias("k"), "c", "w")
        offers = offers.filter((F.col("w") == 0) | (F.col("k") > _head_start(F.col("v"), level)))
        # Equal offers, as rare as equal random numbers, are decided by either of them.
        state = offers.groupBy("v").agg(F.max("k").alias("k"), F.max_by("c", "k").alias("c")).withColumnRenamed("v", "u")
    return state.select("u", "c")


def group_records(links: DataFrame, u: str, v: str, groups: DataFrame | None = None, group: str = "group", record: str = "record") -> DataFrame:
    """(group, record) for every record with a link to another: group is the least record of all connected ones.

    groups: memberships (group, record); all records of one group are linked. Links with a null end, links of a record
    to itself, and memberships with a null are ignored; repeats and both directions change nothing. Records are compared
    as strings and must not contain the character U+0001. No links give no rows.
    """
    scratch = Scratch(links.sparkSession)
    one = links.select(F.col(u).cast("string").alias("u"), F.col(v).cast("string").alias("v")).filter("u <> v")
    if groups is not None:
        hub = F.concat(F.lit(_MARK), F.col(group).cast("string"))
        one = one.unionByName(groups.select(hub.alias("u"), F.col(record).cast("string").alias("v")).filter("u is not null and v is not null"))
    symmetric = scratch.cut(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    named = scratch.cut(spread_hubs(symmetric))
    ids = scratch.cut(named.select(F.col("u").alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()))
    numbered = named.join(ids.toDF("u", "i"), "u").join(ids.toDF("v", "j"), "v").select(F.col("i").alias("u"), F.col("j").alias("v"))
    edges, maps = _Edges(numbered), []
    while edges.left:
        centre = scratch.cut(_decompose(edges, len(maps)))
        maps.append(centre)
        across = edges.read().filter("w = 1").join(centre.withColumnRenamed("c", "cu"), "u").select("cu", "v").join(centre.toDF("v", "cv"), "v")
        smaller = _Edges(across.filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        edges.drop()
        edges = smaller
    edges.drop()
    if not maps:
        return links.sparkSession.createDataFrame([], "group string, record string")
    whole = maps.pop()
    while maps:
        whole = scratch.cut(maps.pop().join(whole.toDF("c", "top"), "c", "left").select("u", F.coalesce("top", "c").alias("c")))
    whole = whole.join(ids.toDF("name", "u"), "u").select("name", "c").filter(~F.col("name").startswith(_MARK))
    least = whole.groupBy("c").agg(F.min("name").alias("group"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return whole.join(least, "c").select("group", F.col("name").alias("record"))
