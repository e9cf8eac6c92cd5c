"""Mixing sources to target weights: hierarchical budgets, filled from seeded epochs.

Target weights run down a tree (domain, language, source). A node that cannot use its budget, because its texts may be
repeated only so often, passes the shortage to its siblings first and to its parent's siblings after that. A leaf
repeats its texts in whole epochs and takes the rest of its budget from the front of one more epoch, whose order is a
seeded hash of the record key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.session import Scratch

#: Vocabulary file on the driver; its content goes to the executors with the job, so they need no such file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the public byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slices of an epoch's order; only the slice in which a leaf's budget ends is sorted.
SLICES = 4096


def encoder(ranks: bytes):
    """The tokenizer of a vocabulary file's content."""
    import base64

    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], ranks: Broadcast[bytes]) -> Iterator[pa.RecordBatch]:
    e = encoder(ranks.value)
    for batch in batches:
        n = [len(e.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("leaf"), pa.array(n, pa.int64())], ["d", "leaf", "n"])


def fill(amount: float, parts: dict, weight: dict, room: dict) -> dict:
    """Shares of amount by weight, none above its room; what one cannot take goes to the others by weight, 0 to a weight of 0."""
    got, left = dict.fromkeys(parts, 0.0), {p for p in parts if weight[p] > 0}
    while left and amount > 1e-9:
        total = sum(weight[p] for p in left)
        want = {p: amount * weight[p] / total for p in left}
        full = {p for p in left if want[p] >= room[p] - got[p]}
        if not full:
            for p in left:
                got[p] += want[p]
            break
        for p in full:
            amount -= room[p] - got[p]
            got[p] = room[p]
        left -= full
    return got


def budgets(leaves: list[tuple[tuple[str, ...], float, float]], amount: float) -> dict[tuple[str, ...], float]:
    """Budget of each leaf (path, weight, room): shortages go to siblings before they go up the tree, none to a leaf of weight 0."""
    weight, room, below = defaultdict(float), defaultdict(float), defaultdict(set)
    for path, w, r in leaves:
        for i in range(len(path) + 1):
            weight[path[:i]] += w
            room[path[:i]] += r if w > 0 else 0.0
            if i < len(path):
                below[path[:i]].add(path[: i + 1])
    out, open_ = {}, [((), min(amount, room[()]))] if leaves else []
    while open_:
        node, a = open_.pop()
        if node not in below:
            out[node] = a
            continue
        open_ += fill(a, dict.fromkeys(sorted(below[node])), weight, room).items()
    return out


def language(lang: Column) -> Column:
    """Two-letter code, 'und' for anything else."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    ok = F.lower(F.trim(lang)).rlike("^[a-z]{2}([-_].*)?$")
    return F.when(F.coalesce(ok, F.lit(False)), code).otherwise("und")


def mix(
    docs: DataFrame, key: str, text: str, lang: str, source: str, targets: DataFrame, domains: dict[str, str], total: int | None = None,
    seed: int = 7, tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): mixture (key, source, n_tokens, repeats) and shares per target source.

    targets: (source, target_share, max_repeats), few rows. Sources are compared trimmed and lower-cased. Records with
    a null key, without a target source or with an empty text have no part in it. Leaf budgets add up to `total` tokens,
    by default the tokens of all records that take part, or to all that repeats allow if that is less. Each leaf keeps
    within its budget and misses it by less than one record. The language level splits a source's target by the tokens
    it has in each language. A source without records, a target of 0 (which gets nothing, whatever others lack) and empty
    tables are allowed. Rows with the same
    key share their place in the order and are taken apart by their size only.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    want = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.select(F.lower(F.trim("source")), "target_share", "max_repeats").collect() if r[0]}
    src = F.lower(F.trim(F.col(f"`{source}`")))
    leaf = F.concat_ws("\u0001", language(F.col(f"`{lang}`")), src)
    some = docs.select(F.col(f"`{key}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("text"), leaf.alias("leaf"), src.alias("s"))
    some = some.filter(F.col("d").isNotNull() & (F.length("text") > 0) & F.col("s").isin(list(want) or [""])).drop("s")
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    sized = scratch.cut(some.mapInArrow(lambda it: _count(it, ranks), "d bigint, leaf string, n bigint").filter("n > 0"))
    # A row per language code and target source: their number is bounded by the targets.
    have = {tuple(r[0].split("\u0001")): r[1] for r in sized.groupBy("leaf").agg(F.sum("n")).collect()}
    of_source: dict[str, int] = defaultdict(int)
    for (_, s), n in have.items():
        of_source[s] += n
    leaves = [((domains.get(s, "other"), lang_, s), want[s][0] * n / of_source[s], float(n * want[s][1])) for (lang_, s), n in sorted(have.items())]
    # A source without records has room 0 and no language: its target goes to the rest of its domain first.
    leaves += [((domains.get(s, "other"), "", s), want[s][0], 0.0) for s in sorted(want) if s not in of_source]
    plan = budgets(leaves, float(total if total is not None else sum(have.values())))
    rows = []
    for (_, lang_, s), b in plan.items():
        if (lang_, s) not in have:
            continue
        n = have[lang_, s]
        whole = min(int((b + 1e-6) // n), want[s][1])
        rows.append((f"{lang_}\u0001{s}", s, whole, int(b + 1e-6) - whole * n if whole < want[s][1] else 0))
    budget = F.broadcast(spark.createDataFrame(rows, "leaf string, source string, whole int, rest bigint"))
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("d"))
    placed = sized.join(budget, "leaf").withColumn("o", order).withColumn("slice", F.shiftrightunsigned("o", 52).cast("int"))
    slices = placed.groupBy("leaf", "slice").agg(F.sum("n").alias("sum"), F.max("rest").alias("rest"))
    ahead = slices.selectExpr("leaf", "slice", "coalesce(sum(sum) over (partition by leaf order by slice rows between unbounded preceding and 1 preceding), 0) before", "sum", "rest")
    kind = F.when(F.col("before") + F.col("sum") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(2)
    ahead = ahead.select("leaf", "slice", "before", kind.alias("kind"))
    cut = placed.join(ahead, ["leaf", "slice"])
    inside = cut.filter("kind = 2").withColumn("upto", F.expr("before + sum(n) over (partition by leaf, slice order by shiftrightunsigned(o, 1), d, n rows unbounded preceding)"))
    extra = F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    parts = cut.filter("kind <> 2").select("d", "source", "n", (F.col("whole") + F.col("kind")).alias("r")).unionByName(
        inside.select("d", "source", "n", (F.col("whole") + extra).alias("r"))
    )
    mixture = scratch.cut(parts.filter("r > 0").select(F.col("d").alias(key), F.col("source"), F.col("n").alias("n_tokens"), F.col("r").cast("int").alias("repeats")))
    taken = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("taken"), F.max("repeats").alias("most"))
    goal = spark.createDataFrame([(s, w, m, of_source.get(s, 0)) for s, (w, m) in sorted(want.items())] , "source string, target_share double, max_repeats int, available_tokens bigint")
    all_ = F.greatest(F.sum(F.coalesce("taken", F.lit(0))).over(_everything()), F.lit(1))
    shares = F.broadcast(goal).join(taken, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", F.coalesce("taken", F.lit(0).cast("bigint")).alias("mixed_tokens"),
        F.coalesce("most", F.lit(0)).alias("most_repeats"), F.round(F.coalesce("taken", F.lit(0)) / all_, 6).alias("share"),
    )
    return mixture, shares


def _everything():
    """A window over one row per target source."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))
