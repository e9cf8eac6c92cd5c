"""Full history of changing attributes, coalesced by tree reduction.

The last value of each day is a unit interval. Neighbouring blocks of days are merged pairwise, round by round; at each
merge the open last run of one block meets the first run of the next and either swallows it (equal value) or is
closed by it. One shuffle brings together the blocks of several rounds (64 blocks for six rounds), which then run in
memory. Runs inside a block are then final and leave the tree, so a block carries two runs at most from shuffle to
shuffle and no task ever holds the whole history of an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.functions.core import nz
from mergeloom.session import Scratch

_RUNS = "array<struct<f:int,t:int,v:string>>"
#: Added to day numbers so that shifts of early dates meet at 0.
_SHIFT = 1 << 24


def _merged(a: Column, b: Column) -> Column:
    """Two neighbouring lists of runs as one: the open last run of the first swallows, or is closed by, the next run."""
    run = lambda f, t, v: F.struct(f.alias("f"), t.alias("t"), v.alias("v"))
    last, nxt = F.element_at(a, -1), b[0]
    head, tail = F.slice(a, 1, F.size(a) - 1), F.slice(b, 2, F.size(b))
    joined = F.when(last["v"] == nxt["v"], F.array(run(last["f"], nxt["t"], last["v"]))).otherwise(F.array(run(last["f"], nxt["f"], last["v"]), nxt))
    return F.when(last["t"].isNotNull(), F.concat(a, b)).otherwise(F.concat(head, joined, tail))


def _coalesce_runs(blocks: Column, rounds: int) -> Column:
    """The runs of up to 2**rounds neighbouring blocks, merged pairwise round by round."""

    def halved(acc: Column, _: Column) -> Column:
        pair = lambda i: F.when(2 * i + 1 < F.size(acc), _merged(F.get(acc, 2 * i), F.get(acc, 2 * i + 1))).otherwise(F.get(acc, 2 * i))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(acc) - 1) / 2).cast("int")), pair)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), blocks, halved)[0]


def value_history(
    events: DataFrame, entity: str, field: str, old: str, new: str, day: str, written: str, row_id: str, level_bits: int = 6
) -> DataFrame:
    """(entity, field, valid_from, valid_to, value) of every version of every entity's field, days as dates.

    Rows with a blank new value, and rows with neither day nor writing time, do not count. Field names are trimmed
    and lower-cased, values trimmed; a null entity or field is an entity or field of its own. Rows are ordered by
    day (the writing date if null), writing time (null first), id, value; the last of a day sets the value from that
    day on. The first row's old value, unless blank, holds from 0001-01-01; a value equal to the one in force opens
    no version; the last version holds to 9999-12-31. Repeated rows change nothing; an empty table gives no rows.
    level_bits: pairwise rounds between two shuffles.
    """
    scratch = Scratch(events.sparkSession)
    c = lambda name: F.col(f"`{name}`")
    when = F.coalesce(c(day).cast("date"), c(written).cast("date"))
    rows = events.select(
        c(entity).alias("e"), F.lower(F.trim(c(field))).alias("a"), nz(c(old)).alias("old"), nz(c(new)).alias("new"),
        (F.unix_date(when) + _SHIFT).alias("pos"), F.struct(c(written), c(row_id)).alias("o"),
    ).filter("new is not null and pos is not null")
    by_day = rows.groupBy("e", "a", "pos").agg(
        F.max_by("new", F.struct("o", "new")).alias("v"), F.min(F.struct("o", F.coalesce("old", F.lit("")).alias("old"))).alias("first")
    )
    level = by_day.select("e", "a", "pos", F.array(F.struct(F.col("pos").alias("f"), F.lit(None).cast("int").alias("t"), "v")).cast(_RUNS).alias("runs"), F.nullif("first.old", F.lit("")).alias("old"))
    done = None
    while True:
        block = F.array_sort(F.collect_list(F.struct("pos", "runs", "old"))).alias("b")
        merged = level.groupBy("e", "a", F.expr(f"shiftright(pos, {level_bits})").alias("pos")).agg(block)
        merged = merged.select("e", "a", "pos", _coalesce_runs(F.col("b.runs"), level_bits).alias("r"), F.col("b")[0]["old"].alias("old"))
        n = F.size("r")
        merged, ends = scratch.cut_watching(
            merged.select(
                "e", "a", "pos", "old",
                F.when(n > 1, F.array(F.col("r")[0], F.element_at("r", -1))).otherwise(F.col("r")).alias("runs"),
                F.when(n > 2, F.slice("r", 2, n - 2)).otherwise(F.array().cast(_RUNS)).alias("inner"),
            ),
            lo=F.min("pos"), hi=F.max("pos"),
        )
        inner = merged.filter("size(inner) > 0").select("e", "a", F.explode("inner").alias("x")).select("e", "a", "x.*")
        done = inner if done is None else done.unionByName(inner)
        if ends["lo"] == ends["hi"]:
            break
        level = merged.drop("inner")
    first, origin = F.col("runs")[0], F.lit(-719162 + _SHIFT)
    run = lambda f, t, v: F.struct(f.cast("int").alias("f"), t.cast("int").alias("t"), v.alias("v"))
    rest = F.slice("runs", 2, 2)
    whole = (
        F.when(F.col("old").isNull(), F.col("runs"))
        .when(F.col("old") == first["v"], F.concat(F.array(run(origin, first["t"], first["v"])), rest))
        .otherwise(F.concat(F.array(run(origin, first["f"], F.col("old"))), F.col("runs")))
    )
    outer = merged.select("e", "a", F.explode(whole).alias("x")).select("e", "a", "x.*")
    date = lambda d: F.date_from_unix_date(F.col(d) - _SHIFT)
    return done.unionByName(outer).select(
        F.col("e").alias(entity), F.col("a").alias(field), date("f").alias("valid_from"),
        F.coalesce(date("t"), F.to_date(F.lit("9999-12-31"))).alias("valid_to"), F.col("v").alias("value"),
    )
