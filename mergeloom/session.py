"""Session set-up, table loading and lineage cuts.

Long or iterative plans are cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``. That folder is shared by all executors, so a lost executor costs a retry of the
current stage, never the intermediate result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


def build_session(app: str = "mergeloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under."""
    builder = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut tables: the cluster's own setting, or a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = option.get() if option.isDefined() else None
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="mergeloom-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], True)
    return f"file://{_LOCAL_DIR[0]}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/mergeloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Removes all cut tables of this application; results that still read them must have been written before."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/mergeloom/{spark.sparkContext.applicationId}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Cut tables of one operator call; ``free`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def cut(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def cut_watching(self, df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
        """The cut table, and aggregates of its rows taken while it is written."""
        seen = Observation()
        out = self.cut(df.observe(seen, *[a.alias(n) for n, a in aggregates.items()]))
        return out, seen.get

    def cut_counting(self, df: DataFrame, what: Column) -> tuple[DataFrame, int]:
        """The cut table and the number of its rows for which `what` holds."""
        out, seen = self.cut_watching(df, n=F.count_if(what))
        return out, int(seen["n"])

    def free(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
