"""Projection, containment, nearest neighbour and centroid as joins and Column expressions.

Points are columns x and y (or lon and lat); lines and polygons are array<array<struct<x,y>>>: parts or
rings. No operator compares all pairs: points and shapes meet in grid cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.operators.joins import join_cells, small_side, spread
from hearthframe.staging import stage

#: Nodes of a cell in the mean.
FEW = 4
#: Nodes that a point meets in one array, about, at most.
PACK = 256
#: POSGAR 94 / Argentina zone 5 (EPSG:22185) on the WGS 84 ellipsoid.
SEMI_MAJOR, FLATTENING, LON0, LAT0, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, -60.0, -90.0, 5_500_000.0, 0.0


def _series() -> tuple[float, list[float], list[float]]:
    """The rectifying radius, and the coefficients of the series there and back, to the fourth order of n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, alpha, beta


def _plain(values: list[Column], body):
    """body of these values as they stand, for columns, whose common parts Spark computes once."""
    return body(*values)


def project(lon: Column, lat: Column, let=_plain):
    """Degrees to metres east and north by the transverse Mercator series: (x, y), or with let=_let their struct."""
    radius, alpha, _ = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))

    def metres(xi: Column, eta: Column):
        east, north = eta, xi
        for j, a in enumerate(alpha, 1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return _point(let, EASTING + radius * east, NORTHING + radius * north - radius * math.radians(LAT0))

    def angles(t: Column, turn: Column):
        return let([F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))], metres)

    return let([F.sin(F.radians(lat)), F.radians(lon - LON0)], lambda s, turn: let([F.sinh(F.atanh(s) - e * F.atanh(e * s)), turn], angles))


def unproject(x: Column, y: Column, let=_plain):
    """Metres to degrees: (lon, lat), or with let=_let their struct. The conformal latitude is turned into the geographic one by three Newton steps."""
    radius, _, beta = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))

    def newton(t: Column, goal: Column) -> Column:
        sigma = lambda t: F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t)))

        def step(t: Column, now: Column) -> Column:
            slope = (1 - e * e) * F.sqrt(1 + now * now) * F.sqrt(1 + t * t) / (1 + (1 - e * e) * t * t)
            return t + (goal - now) / slope

        return let([t, sigma(t)], lambda t, sigma: let([t, t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + t * t)], step))

    def degrees(xi: Column, eta: Column, goal: Column):
        steps = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), goal, lambda t, _: newton(t, goal))
        return _point(let, LON0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(F.atan(steps)))

    def angles(eta0: Column, xi0: Column):
        xi, eta = xi0, eta0
        for j, b in enumerate(beta, 1):
            xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        return let([xi, eta], lambda xi, eta: let([xi, eta, F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))], degrees))

    return let([(x - EASTING) / radius, (y - NORTHING) / radius + math.radians(LAT0)], angles)


def _point(let, x: Column, y: Column):
    return (x, y) if let is _plain else F.struct(x.alias("x"), y.alias("y"))


def projected(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with x and y, written once so that the long expression isn't repeated in later plans."""
    x, y = project(F.col(lon), F.col(lat))
    return stage(df.withColumns({"x": x, "y": y}), "projected")


def edges(polygons: DataFrame, pid: str, rings: str = "rings") -> DataFrame:
    """(pid, x1, y1, x2, y2): the sides of all rings, closed if they aren't."""
    ring = polygons.select(pid, F.explode(rings).alias("r")).where("size(r) > 1")
    closed = F.concat(F.col("r"), F.array(F.col("r")[0]))
    pairs = F.zip_with(F.slice(closed, F.lit(1), F.size(closed) - 1), F.slice(closed, F.lit(2), F.size(closed) - 1), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))
    return ring.select(pid, F.inline(pairs)).where("NOT (x1 <=> x2 AND y1 <=> y2)")


def _let(values: list[Column], body) -> Column:
    """body of these values, each computed once: inside a lambda Spark computes an expression again wherever it is used."""
    one = F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values)))
    return F.transform(F.array(one), lambda v: body(*(v[f"v{k}"] for k in range(len(values)))))[0]


def project_parts(parts: Column, to=None) -> Column:
    """Lines or rings (arrays of parts of (x, y) in degrees) in metres; with to=unproject the other way round."""

    def point(p: Column) -> Column:
        return (to or project)(p.x, p.y, let=_let)

    return F.transform(parts, lambda part: F.transform(part, point))


def within(points: DataFrame, polygons: DataFrame, pid: str, band: float, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """points x polygons that contain them, by the even-odd rule, so holes and many parts need nothing more.

    points must have a column id. Points on a side are outside. A point in two polygons is there twice.
    Sides fall into bands of equal height. The stretch of a band between a polygon's westernmost and
    easternmost side in it is cut into cells as wide as they are high; a point meets the polygons of its
    cell, and of these the sides in its band, wherever on the map the others are.
    """
    sides = edges(polygons, pid, rings)
    low, high = F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)
    sides = stage(sides.select("*", F.explode(F.sequence(low, high)).alias("_band")), "sides")
    spans = sides.groupBy(pid, "_band").agg(F.min(F.least("x1", "x2")).alias("_west"), F.max(F.greatest("x1", "x2")).alias("_east"))
    cells = spans.select(pid, "_band", "_west", "_east", F.explode(F.sequence(F.floor(F.col("_west") / band), F.floor(F.col("_east") / band))).alias("_cell"))
    at = points.select("id", F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(y) / band).alias("_band"), F.floor(F.col(x) / band).alias("_cell"))
    near = join_cells(at, stage(cells, "cells"), ["_band", "_cell"], "id").where("_x BETWEEN _west AND _east").select("id", "_x", "_y", "_band", pid)
    met = join_cells(near, sides, [pid, "_band"], "id")
    straddles = (F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))
    cross = F.try_divide((F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    hit = straddles & (F.col("_x") < cross)
    turn = (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("_x") - F.col("x1"))
    on = (turn == 0) & F.col("_x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("_y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    inside = met.groupBy("id", pid).agg(F.count_if(hit).alias("_hits"), F.coalesce(F.bool_or(on), F.lit(False)).alias("_on"))
    return points.join(inside.where("_hits % 2 = 1 AND NOT _on").select("id", pid), "id")


def _fine(nodes: DataFrame, cell: float) -> float:
    """cell, or the half, quarter, ... of it at which a cell that has nodes has FEW of them in the mean, from one pass."""
    widths = [cell / 2**k for k in range(12)]
    at = [F.approx_count_distinct(F.struct(F.floor(F.col("x") / w), F.floor(F.col("y") / w))).alias(f"c{k}") for k, w in enumerate(widths)]
    found = nodes.agg(F.count("*").alias("n"), *at).first()
    return next((w for k, w in enumerate(widths) if found["n"] <= FEW * found[f"c{k}"]), widths[-1])


def nearest(points: DataFrame, nodes: DataFrame, cell: float, grow: int = 4) -> DataFrame:
    """(id, node_id, d): the nearest node (node_id, x, y) of each point (id, x, y), the smallest node_id on ties.

    A node within one cell's width lies in the nine cells around a point, so nearer matches are final.
    Cells begin at a width that fits how densely the nodes lie, at most cell, so that a point meets few
    nodes; points without a match meet coarser cells, until one cell is wider than all points and nodes.
    The nodes around a cell come as arrays of at most PACK, and a point's nearest of an array is found where they meet, so that
    it is never there once for each node. Few arrays are broadcast; else the points of a crowded cell are spread over as many tasks as they ask for. Of nodes
    with the same coordinates only the smallest node_id is looked at. Points and nodes without coordinates match nothing.
    """
    has = "x IS NOT NULL AND y IS NOT NULL"
    # dealt out and written: points of one file would be one task, and each round reads them again
    left, nodes, done = stage(spread(points.where(has).select("id", "x", "y")), "points"), stage(nodes.where(has).groupBy("x", "y").agg(F.min("node_id").alias("node_id")), "nodes"), None
    extent = nodes.select("x", "y").union(left.select("x", "y")).agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    width = max(extent.w or 0.0, extent.h or 0.0)
    cell = _fine(nodes, cell)
    while True:
        last = cell > 2 * width
        cells = F.struct(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
        around = F.explode(F.array(*(F.struct((F.floor(F.col("x") / cell) + a).alias("cx"), (F.floor(F.col("y") / cell) + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        # nodes go to the cells around them, so points, which are more, are not multiplied
        there = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), around.alias("c")).select("node_id", "nx", "ny", "c.*")
        there = stage(_packed(there), "around")
        here = left.select("id", "x", "y", cells.alias("c")).select("id", "x", "y", "c.*")
        best = join_cells(here, there, ["cx", "cy"], "id").select("id", _nearest_of(F.col("packed"), F.col("x"), F.col("y")).alias("b"))
        found = best.groupBy("id").agg(F.min("b").alias("b")).select("id", "b.node_id", "b.d")
        if not last:
            found = found.where(F.col("d") <= cell)
        found = stage(found, "nearest")
        done = found if done is None else done.union(found)
        left = left.join(found.select("id"), "id", "left_anti")
        if last or left.isEmpty():
            return done
        left, cell = stage(left, "unmatched"), cell * grow


def _packed(there: DataFrame) -> DataFrame:
    """Nodes (node_id, nx, ny) of cells (cx, cy) as arrays of at most about PACK of them, several of a crowded cell."""
    counts = there.groupBy("cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > PACK)
    crowded = small_side(counts.select("cx", "cy", F.ceil(F.col("n") / PACK).alias("_packs")))
    dealt = there.join(crowded, ["cx", "cy"], "left").withColumn("_pack", F.pmod(F.xxhash64("node_id"), F.coalesce("_packs", F.lit(1))))
    return dealt.groupBy("cx", "cy", "_pack").agg(F.collect_list(F.struct("node_id", "nx", "ny")).alias("packed")).drop("_pack")


def _nearest_of(packed: Column, x: Column, y: Column) -> Column:
    """The least (d, node_id) of an array of nodes."""
    d = lambda n: F.sqrt(F.pow(x - n.nx, 2) + F.pow(y - n.ny, 2))
    return F.array_min(F.transform(packed, lambda n: F.struct(d(n).alias("d"), n.node_id.alias("node_id"))))


def centroid(rings: Column) -> tuple[Column, Column]:
    """The area centroid of all rings (holes wind the other way); of shapes without area the mean of their vertices."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def ring(total: Column, r: Column) -> Column:
        after = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        sides = F.zip_with(r, after, lambda p, q: F.struct(p.x.alias("x1"), p.y.alias("y1"), q.x.alias("x2"), q.y.alias("y2")))

        def side(t: Column, s: Column) -> Column:
            w = s.x1 * s.y2 - s.x2 * s.y1
            return F.struct((t.a + w).alias("a"), (t.x + (s.x1 + s.x2) * w).alias("x"), (t.y + (s.y1 + s.y2) * w).alias("y"))

        return F.aggregate(sides, total, side)

    sums = F.aggregate(rings, zero, ring)
    flat = F.flatten(rings)
    mean = lambda axis: F.try_divide(F.aggregate(flat, F.lit(0.0), lambda t, p: t + p[axis]), F.size(flat))
    return F.coalesce(F.try_divide(sums.x, 3 * sums.a), mean("x")), F.coalesce(F.try_divide(sums.y, 3 * sums.a), mean("y"))
