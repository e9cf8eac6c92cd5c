"""Pairs of points within a distance, by a sweep over latitude strips.

Equal coordinates are collapsed to one site. Sites are range-partitioned by latitude strips, four radii high, that
overlap by one radius; strips are cut into segments of longitude with the same overlap, so that a dense city is
shared by many tasks. Each partition is sorted by (strip, segment, longitude) and swept once: a site meets the sites
of the active window, those at most a radius to its west. A pair is reported only in the lesser of both sites' home
cells. Pairs of sites are expanded to pairs of points in chunks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of one site are paired in chunks of about this many.
CHUNK = 256
_BLOCK = 1 << 20


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, sphere: float = 3958.8) -> Column:
    """Great-circle distance in the unit of the sphere's radius (default: miles)."""
    a = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return F.lit(2 * sphere) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def placed(lat: Column, lon: Column) -> Column:
    """Null, NaN, impossible and (0, 0) coordinates are not placed."""
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def _sweep(batches: Iterator[pa.RecordBatch], radius: float, sphere: float) -> Iterator[pa.RecordBatch]:
    names = ["strip", "seg", "x", "dlon", "lat", "lon", "ghost", "hseg", "hstrip", "n", "one"]
    tail: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        if not len(new["x"]):
            continue
        old = len(tail["x"]) if tail else 0
        d = {c: np.concatenate([tail[c], new[c]]) for c in names} if tail else new
        turn = np.r_[0, np.cumsum((np.diff(d["strip"]) != 0) | (np.diff(d["seg"]) != 0))]
        key = turn * 1000.0 + d["x"]
        left = np.searchsorted(key, key - d["dlon"] * (1 + 1e-9) - 1e-6)
        count = np.arange(len(key)) - left
        count[:old] = 0
        ends = np.cumsum(count)
        start = 0
        while start < len(key):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BLOCK, "right")))
            c = count[start:stop]
            i = np.repeat(np.arange(start, stop), c)
            j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(left[start:stop], c)
            start = stop
            lat_i, lat_j = np.radians(d["lat"][i]), np.radians(d["lat"][j])
            near = np.abs(lat_i - lat_j) <= radius / sphere * (1 + 1e-9)
            i, j, lat_i, lat_j = i[near], j[near], lat_i[near], lat_j[near]
            a = np.sin((lat_i - lat_j) / 2) ** 2 + np.cos(lat_i) * np.cos(lat_j) * np.sin(np.radians(d["lon"][i] - d["lon"][j]) / 2) ** 2
            keep = 2 * sphere * np.arcsin(np.sqrt(np.minimum(a, 1))) <= radius
            i, j = i[keep], j[keep]
            less = (d["hstrip"][i] < d["hstrip"][j]) | ((d["hstrip"][i] == d["hstrip"][j]) & (d["hseg"][i] <= d["hseg"][j]))
            o = np.where(less, i, j)
            own = (d["hstrip"][o] == d["strip"][i]) & (d["hseg"][o] == d["seg"][i]) & ~(d["ghost"][i] & d["ghost"][j])
            i, j = i[own], j[own]
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[c][k]) if c != "one" else pa.array(d[c][k], pa.string()) for k in (i, j) for c in ("lat", "lon", "n", "one")],
                    [f"{c}_{s}" for s in "ab" for c in ("lat", "lon", "n", "one")],
                )
        keep = key >= key[-1] - d["dlon"][-1] * (1 + 1e-9) - 1e-6
        keep &= turn == turn[-1]
        tail = {c: v[keep] for c, v in d.items()}


def _boxes(cell: float, south: Column, north: Column, west: Column, east: Column) -> Column:
    """Cells (row, col) of a grid of `cell` degrees that a box touches."""
    at = lambda c: F.floor(c / cell).cast("int")
    cols = F.transform(F.sequence(at(west), at(east)), lambda x: F.struct(F.lit(0).alias("row"), x.alias("col")))
    return F.flatten(F.transform(F.sequence(at(south), at(north)), lambda r: F.transform(cols, lambda x: F.struct(r.alias("row"), x["col"].alias("col")))))


def near_places(points: DataFrame, key: str, lat: str, lon: str, places: DataFrame, place: str, place_lat: str, place_lon: str, radius: float, sphere: float = 3958.8) -> DataFrame:
    """(key, place, distance) of every point within `radius` of a place.

    Both sides meet in grid cells of the radius's height: a point lies in one cell, a place in all that its circle
    touches, so that only neighbours in both directions meet. Circles that reach the 180th meridian go on beyond it; a
    circle that holds a pole touches all longitudes. Rows without a place (see `placed`) or with a null key meet nothing;
    repeated rows repeat their result.
    """
    cell = math.degrees(radius / sphere) * (1 + 1e-9)
    la, lo = F.col(f"`{place_lat}`").cast("double"), F.col(f"`{place_lon}`").cast("double")
    c = places.filter(placed(la, lo)).select(F.col(f"`{place}`").alias("__place"), la.alias("__pla"), lo.alias("__plo")).filter("__place is not null")
    top = F.least(F.abs("__pla") + cell, F.lit(90.0))
    ratio = F.lit(math.sin(min(radius / sphere, math.pi / 2))) / F.cos(F.radians(F.abs("__pla")))
    wide = F.when((top >= 89.999) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    whole = wide >= 180
    box = lambda shift: _boxes(cell, F.col("__pla") - cell, F.col("__pla") + cell, F.when(whole, F.lit(-180.0)).otherwise(F.col("__plo") - wide + shift), F.when(whole, F.lit(180.0)).otherwise(F.col("__plo") + wide + shift))
    cells = F.when(whole, box(0)).when(F.col("__plo") - wide < -180, F.array_union(box(0), box(360))).when(F.col("__plo") + wide > 180, F.array_union(box(0), box(-360))).otherwise(box(0))
    c = c.withColumn("__cell", F.explode(cells)).select("__place", "__pla", "__plo", F.col("__cell.row").alias("__row"), F.col("__cell.col").alias("__col"))
    la, lo = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double")
    p = points.filter(placed(la, lo)).select(F.col(f"`{key}`").alias("__key"), la.alias("__la"), lo.alias("__lo")).filter("__key is not null")
    p = p.withColumns({"__row": F.floor(F.col("__la") / cell).cast("int"), "__col": F.floor(F.col("__lo") / cell).cast("int")})
    met = p.join(c, ["__row", "__col"]).withColumn("distance", haversine(F.col("__la"), F.col("__lo"), F.col("__pla"), F.col("__plo"), sphere))
    return met.filter(F.col("distance") <= radius).select(F.col("__key").alias(key), F.col("__place").alias(place), "distance")


def _inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of (lat, lon) corners: the edges that a line eastwards crosses are odd in number."""
    n = F.size(ring)

    def crossed(i: Column) -> Column:
        a, b = ring[i], ring[(i + 1) % n]
        split = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(split & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crossed(i)) % 2 == 1


def containing_regions(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, ring: str, cell: float = 0.05) -> DataFrame:
    """(key, region) of every point and each region that contains it.

    ring: a list of struct(lat, lon), the corners in order; an edge's southern end belongs to it, its northern end does
    not, so that regions with common borders share no point between them. A region meets points through the grid cells
    (of `cell` degrees) of its bounding box; regions must not cross the 180th meridian. Rings of fewer than three
    corners or with null corners, null keys and points without a place contain, or lie in, nothing; regions may overlap.
    """
    c = F.col(f"`{ring}`")
    ok = (F.size(c) >= 3) & ~F.exists(c, lambda x: x["lat"].isNull() | x["lon"].isNull() | F.isnan(x["lat"]) | F.isnan(x["lon"]))
    edge = lambda f, g: g(F.transform(c, lambda x: x[f].cast("double")))
    r = regions.filter(F.coalesce(ok, F.lit(False))).select(F.col(f"`{region}`").alias("__region"), c.alias("__ring"), F.explode(_boxes(cell, edge("lat", F.array_min), edge("lat", F.array_max), edge("lon", F.array_min), edge("lon", F.array_max))).alias("__cell"))
    r = r.select("__region", "__ring", F.col("__cell.row").alias("__row"), F.col("__cell.col").alias("__col")).filter("__region is not null")
    la, lo = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double")
    p = points.filter(placed(la, lo)).select(F.col(f"`{key}`").alias("__key"), la.alias("__la"), lo.alias("__lo")).filter("__key is not null")
    p = p.withColumns({"__row": F.floor(F.col("__la") / cell).cast("int"), "__col": F.floor(F.col("__lo") / cell).cast("int")})
    met = p.join(r, ["__row", "__col"]).filter(_inside(F.col("__la"), F.col("__lo"), F.col("__ring")))
    return met.select(F.col("__key").alias(key), F.col("__region").alias(region))


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius: float, sphere: float = 3958.8) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of rows at most `radius` apart, keys as strings.

    Rows with a null key or without a place (see `placed`) pair with nothing; points at the 180th meridian and at
    the poles meet across it. Repeated rows change nothing; a key with several places pairs by any of them. Other
    columns are ignored; an empty table gives no rows.
    """
    la, lo = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double")
    rows = points.filter(placed(la, lo)).select(F.col(f"`{key}`").cast("string").alias("k"), (la + 0.0).alias("lat"), (lo + 0.0).alias("lon")).filter("k is not null")
    sites = rows.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("one"))

    dlat = math.degrees(radius / sphere) * (1 + 1e-9)
    height = 4 * dlat
    reach = math.sin(min(radius / sphere / 2, math.pi / 2))

    def dlon(strip: Column) -> Column:
        top = F.greatest(F.abs(strip * height - dlat), F.abs((strip + 1) * height + dlat))
        ratio = F.lit(reach) / F.cos(F.radians(F.least(top, F.lit(90.0))))
        return F.when((top >= 89.999) | (ratio >= 0.7), 360.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 2 * (1 + 1e-9))

    def seg(x: Column, w: Column) -> Column:
        return F.when(w >= 360, F.lit(0)).otherwise(F.floor(x / (w * 8))).cast("int")

    home = F.floor(F.col("lat") / height).cast("int")
    s = sites.withColumn("hstrip", home).withColumn("w", dlon(F.col("hstrip"))).withColumn("below", dlon(F.col("hstrip") - 1))
    wide = F.greatest("w", "below")
    shifted = F.when((wide < 180) & (F.col("lon") - wide <= -180), F.array(F.lit(0.0), F.lit(360.0))).otherwise(F.array(F.lit(0.0)))
    s = s.withColumn("turn", F.explode(shifted)).withColumn("x", F.col("lon") + F.col("turn")).withColumn("ghost", F.col("turn") > 0)
    s = s.withColumn("hseg", seg(F.col("x"), F.col("w")))
    cell = lambda strip, g, w: F.struct(strip.cast("int").alias("strip"), g.cast("int").alias("seg"), w.alias("dlon"))
    here = F.transform(F.sequence(seg(F.col("x") - F.col("w"), F.col("w")), F.col("hseg")), lambda g: cell(F.col("hstrip"), g, F.col("w")))
    low = F.transform(
        F.sequence(seg(F.col("x") - F.col("below"), F.col("below")), seg(F.col("x") + F.col("below"), F.col("below"))),
        lambda g: cell(F.col("hstrip") - 1, g, F.col("below")),
    )
    cells = F.when(F.col("lat") - F.col("hstrip") * height <= dlat, F.concat(here, low)).otherwise(here)
    s = s.withColumn("cell", F.explode(cells)).select("cell.*", "x", "lat", "lon", "ghost", "hseg", "hstrip", "n", "one")
    swept = s.repartitionByRange("strip", "seg").sortWithinPartitions("strip", "seg", "x")
    pairs = swept.mapInArrow(
        lambda it: _sweep(it, radius, sphere), "lat_a double, lon_a double, n_a bigint, one_a string, lat_b double, lon_b double, n_b bigint, one_b string"
    )
    single = pairs.filter("n_a = 1 and n_b = 1").select(F.col("one_a").alias("a"), F.col("one_b").alias("b"))

    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    same = sites.filter("n > 1").select(*[F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("lat", "lon", "n", "one")])
    many = pairs.filter("n_a > 1 or n_b > 1").unionByName(same)
    many = many.withColumn("c_a", F.explode(F.sequence(F.lit(0), chunks("n_a") - 1))).withColumn("c_b", F.explode(F.sequence(F.lit(0), chunks("n_b") - 1)))
    members = rows.join(sites.select("lat", "lon", "n"), ["lat", "lon"]).withColumn("c", F.pmod(F.hash("k"), chunks("n")))
    side = lambda s: members.select(F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("c").alias(f"c_{s}"), F.col("k").alias(s))
    spread = many.join(side("a"), ["lat_a", "lon_a", "c_a"]).select("a", "lat_b", "lon_b", "c_b").join(side("b"), ["lat_b", "lon_b", "c_b"]).select("a", "b")
    both = single.unionByName(spread).filter("a <> b")
    return both.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
