"""Logs, guarded replacement of tables, exports, and read-only SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.operators.merge import replace_guard


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that cannot be read are left out."""
    df = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.filter("_broken is null").drop("_broken")


def last_runs(log: DataFrame, source: str, time: str) -> DataFrame:
    """The newest entry per source."""
    return log.groupBy(source).agg(F.max_by(F.struct(*log.columns), time).alias("x")).select("x.*")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, floor: int = 1, share: float = 0.95, empty: bool = False) -> int:
    """Replaces a parquet table through a staging folder, if enough rows came; gives their number.

    An empty (unless `empty`), too small or shrunken replacement raises and leaves the old table as it was.
    """
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    target, fs = _fs(spark, path)
    have = spark.read.schema(df.schema).parquet(path).count() if fs.exists(target) else 0
    n = spark.read.schema(df.schema).parquet(staged).count()
    try:
        if n or not empty:
            replace_guard(have, n, floor, share)
    except ValueError:
        fs.delete(_fs(spark, staged)[0], True)
        raise
    _swap(spark, staged, path)
    return n


def rebuild_table(df: DataFrame, path: str) -> int:
    """Drops a parquet table and writes it anew, whatever it held; gives the number of rows."""
    return replace_table(df, path, floor=0, share=0.0, empty=True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rotate_log(spark: SparkSession, path: str, schema: str, time: str, n: int) -> int:
    """Keeps the newest n entries of a JSON-lines log; entries come in a new folder that then takes the old one's place."""
    kept = keep_newest(read_log(spark, path, schema), time, n)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    kept.write.json(staged)
    _swap(spark, staged, path)
    return read_log(spark, path, schema).count()


def report(df: DataFrame, path: str) -> None:
    """Rows as JSON documents with a fixed set of fields, nulls kept, in a single file for people to read."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a finished folder in a table's place. The old one is moved aside first and put back if the second move fails."""
    old = f"{path}.old-{uuid.uuid4().hex}"
    target, fs = _fs(spark, path)
    s, o = _fs(spark, staged)[0], _fs(spark, old)[0]
    had = fs.exists(target)
    if had and not fs.rename(target, o):
        raise OSError(f"{path} could not be moved")
    if not fs.rename(s, target):
        if had:
            fs.rename(o, target)
        raise OSError(f"{staged} could not be moved")
    if had:
        fs.delete(o, True)


def keep_newest(log: DataFrame, time: str, n: int) -> DataFrame:
    """The newest n entries (top-k; ties by the whole row)."""
    return log.orderBy(F.desc(time), F.desc(F.to_json(F.struct(*log.columns)))).limit(n)


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Named columns only, in this order, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def snapshot(df: DataFrame, path: str, date: str) -> None:
    """Appends rows under the month of a date column."""
    df.withColumn("month", F.date_format(date, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


#: Nodes of parsed statements that only read.
_READS = {
    "Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "LateralJoin", "Generate", "Sample", "Expand",
    "UnresolvedHaving", "UnresolvedWith", "WithWindowDefinition", "UnresolvedInlineTable", "UnresolvedRelation", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "OneRowRelation",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Pivot", "UnresolvedPivot", "Unpivot", "UnresolvedUnpivot", "LocalRelation",
}
#: Functions that call into the JVM's classes.
_CALLS = {"reflect", "try_reflect", "java_method"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def _parts(plan) -> tuple[set[str], set[str]]:
    """Kinds of all nodes of a parsed statement, subqueries included, and the names of all functions it calls."""
    kinds, calls, open_ = set(), set(), [(plan, True)]
    while open_:
        x, node = open_.pop()
        name = x.getClass().getSimpleName().rstrip("$")
        if node:
            kinds.add(name)
            open_ += [(e, False) for e in _items(x.expressions())]
            if name == "UnresolvedWith":
                open_ += [(c, True) for c in _items(x.innerChildren())]
        elif name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "UnresolvedScalarSubquery"):
            open_.append((x.plan(), True))
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            calls.add(_items(x.nameParts() if name == "UnresolvedFunction" else x.name())[-1].lower() if name != "UnresolvedGenerator" else x.name().funcName().lower())
        open_ += [(c, node) for c in _items(x.children())]
    return kinds, calls


def read_only_sql(spark: SparkSession, text: str, most: int | None = None) -> DataFrame:
    """Runs a query, and nothing else: every node of the parsed statement must be one that reads.

    Words inside texts do not matter. Functions that call into the JVM's classes are refused too. most: number of rows
    to return at most; all by default.
    """
    kinds, calls = _parts(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    if kinds - _READS or calls & _CALLS:
        raise ValueError(f"only queries are allowed, not {', '.join(sorted((kinds - _READS) | (calls & _CALLS)))}")
    return spark.sql(text) if most is None else spark.sql(text).limit(most)
