"""Structured Streaming over event files: windows, sessions and duplicates, run over all files that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.session import new_path, shared_dir


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: str, time: str, files: int = 1000) -> DataFrame:
    """Files of a folder as a stream, so many a batch; the time column becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def run(stream: DataFrame) -> DataFrame:
    """Runs the stream over what is available and gives the table it wrote. Checkpoint and output lie in the shared folder.

    Rows are appended once they are final: a window or session when the watermark has passed its end, whereupon its
    state is dropped. Windows still open when the files end are not in the table; they come with later files.
    """
    spark = stream.sparkSession
    out, state = new_path(spark), f"{shared_dir(spark)}/mergeloom/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(stream: DataFrame, time: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *by, "n")


def sliding(stream: DataFrame, time: str, width: str, step: str, by: list[str], late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.window(time, width, step), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), *by, "n")


def without_repeats(stream: DataFrame, time: str, key: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def upsert_latest(stream: DataFrame, key: str, order: str, out: str, state: str) -> None:
    """Keeps the newest row per key in a table that each batch replaces (two folders in turn, so a failed batch changes nothing)."""

    def merge(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if batch:
            df = df.unionByName(spark.read.parquet(f"{out}/{(batch - 1) % 2}"))
        df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(order, *[c for c in df.columns if c not in (key, order)])).alias("x")).select("x.*").write.mode("overwrite").parquet(f"{out}/{batch % 2}")

    stream.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
