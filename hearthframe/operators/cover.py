"""Containment by covers: polygons as quadtree cells of several sizes.

Each polygon is cut into cells by itself: a cell that no side touches is wholly inside or outside, and only those
inside are kept; a cell with sides is cut into four until it has few and is small beside its polygon, and then carries these
sides and the parity of all others. A point meets the cells that hold it by equal keys, one for each size in use. In an inner cell
it is inside at once; in an edge cell it is tested against the cell's own few sides. No point meets a whole
polygon, and nothing is grouped by point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthframe.operators.joins import join_cells, spread
from hearthframe.operators.spatial import edges
from hearthframe.staging import stage

#: Sides of an edge cell at most, and how often its width goes into its polygon's at least, unless it is of the smallest
#: size; cuts in four down to that size.
SIDES, PARTS, DEPTH = 8, 4, 20
#: Only these sizes are kept, so that a point has few keys: cells of others are cut on.
STEP = 2
#: Sides of polygons that are cut at once, about.
TOGETHER = 4_096
#: How near, of a cell's width, a side may be to count as touching it.
NEAR = 1e-9
_CELL = "level int, cx long, cy long, inner boolean, odd int, sides array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _touches(s: np.ndarray, x: np.ndarray, y: np.ndarray, w: float) -> np.ndarray:
    """Which sides (x1, y1, x2, y2) may touch the closed square of width w at their (x, y): none that does is missed."""
    e = NEAR * w
    x1, y1, x2, y2 = s.T
    box = (np.minimum(x1, x2) <= x + w + e) & (np.maximum(x1, x2) >= x - e) & (np.minimum(y1, y2) <= y + w + e) & (np.maximum(y1, y2) >= y - e)
    # all four corners well on one side of the line through a side: it passes by
    turns = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (x, x + w) for cy in (y, y + w)]
    far = (np.abs(x2 - x1) + np.abs(y2 - y1)) * e * 4
    return box & ~((np.min(turns, axis=0) > far) | (np.max(turns, axis=0) < -far))


def _hit(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which sides a ray from their point to the east crosses."""
    x1, y1, x2, y2 = s.T
    up = (y1 > y) != (y2 > y)
    return up & (x < (x2 - x1) * (y - y1) / np.where(up, y2 - y1, 1.0) + x1)


def cut(sides: np.ndarray, starts: np.ndarray, x0: float, y0: float, width: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """The covers of polygons, whose sides begin at starts, in the square of this width at (x0, y0), a level at a time and all
    polygons at once: level, and of its cells the polygon, column and row, whether they are inner, and of the others the
    parity of sides wholly to the east, how many sides a point must be tested with, and these sides one after the other."""
    if not len(sides):
        return
    low, high = np.minimum(sides[:, :2], sides[:, 2:]), np.maximum(sides[:, :2], sides[:, 2:])
    wide = (np.maximum.reduceat(high, starts) - np.minimum.reduceat(low, starts)).max(1)
    own = np.arange(len(starts))
    cx, cy, odd = (np.zeros(len(own), np.int64) for _ in range(3))
    # each cell with each of its sides
    at, side = np.repeat(own, np.diff(np.append(starts, len(sides)))), np.arange(len(sides))
    level = 0
    while len(own):
        w = width / 2**level
        x, y, e, n = x0 + cx * w, y0 + cy * w, NEAR * w, len(own)
        px, py = x[at], y[at]
        touch = _touches(sides[side], px, py, w)
        beside = ~touch & (high[side, 1] >= py - e) & (low[side, 1] <= py + w + e) & (high[side, 0] >= px - e)
        # a side to the east that is taller than the cell is crossed by the ray of each of its points
        whole = beside & (low[side, 1] <= py - e) & (high[side, 1] >= py + w + e) & (low[side, 0] > px + w + e)
        odd = (odd + np.bincount(at[whole], minlength=n)) % 2
        touched = np.bincount(at[touch], minlength=n) > 0
        kept = touch | (beside & ~whole)
        at, side = at[kept], side[kept]
        many = np.bincount(at, minlength=n)
        hits = np.bincount(at[_hit(sides[side], x[at] + w / 2, y[at] + w / 2)], minlength=n)
        inside = ~touched & ((odd + hits) % 2 == 1)
        inner = inside & (level % STEP == 0)
        edge = touched & (level % STEP == 0) & (((many <= SIDES) & (PARTS * w <= wide[own])) | (level >= DEPTH))
        if inner.any():
            none = np.zeros(int(inner.sum()), np.int64)
            yield level, own[inner], cx[inner], cy[inner], True, none, none, sides[:0]
        if edge.any():
            yield level, own[edge], cx[edge], cy[edge], False, odd[edge], many[edge], sides[side[edge[at]]]
        rest = (touched | inside) & ~inner & ~edge
        at, side = at[rest[at]], side[rest[at]]
        at = (np.cumsum(rest) - 1)[at]
        n = int(rest.sum())
        quarter = np.repeat(np.arange(4), n)
        own, cx, cy, odd = np.tile(own[rest], 4), 2 * np.tile(cx[rest], 4) + quarter // 2, 2 * np.tile(cy[rest], 4) + quarter % 2, np.tile(odd[rest], 4)
        # cells and their sides stay in the same order, so that the sides of a cell are together
        at, side = np.concatenate([at + k * n for k in range(4)]), np.tile(side, 4)
        level += 1


def _hits(s: np.ndarray, x: float, y: float) -> int:
    """Sides that a ray from a point to the east crosses."""
    return int(_hit(s, x, y).sum())


def cells(sides: np.ndarray, x0: float, y0: float, width: float) -> Iterator[tuple[int, int, int, bool, int, np.ndarray]]:
    """The cover of one polygon: level, column and row of each cell, whether it is inner, and of the others the parity of
    sides wholly to the east and the sides that a point must be tested with."""
    for level, _, cx, cy, inner, odd, many, kept in cut(sides, np.zeros(1, np.int64), x0, y0, width):
        ends = np.cumsum(many)
        for k in range(len(cx)):
            yield level, int(cx[k]), int(cy[k]), inner, int(odd[k]), kept[ends[k] - many[k] : ends[k]]


def covered(polygons: DataFrame, pid: str, square: tuple[float, float, float], rings: str = "rings") -> DataFrame:
    """polygons (pid, rings) -> their written covers (pid, level, cx, cy, inner, odd, sides) in a square (x, y, width) around all of them."""
    kind = polygons.schema[pid].dataType
    out = T.StructType([T.StructField(pid, kind), *polygons.sparkSession.createDataFrame([], _CELL).schema.fields])
    arrow = to_arrow_schema(out)
    side = F.struct("x1", "y1", "x2", "y2")
    own = edges(polygons, pid, rings).where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL").groupBy(pid).agg(F.collect_list(side).alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            begins = np.cumsum(sizes) - sizes
            # polygons together as long as they are small
            groups = np.unique(begins // TOGETHER, return_index=True)[1]
            for lo, hi in zip(groups, [*groups[1:], b.num_rows], strict=True):
                part = b.slice(int(lo), int(hi - lo))
                flat = part.column(1).flatten()
                given = np.stack([flat.field(n).to_numpy(zero_copy_only=False) for n in ("x1", "y1", "x2", "y2")], 1)
                for level, own, cx, cy, inner, odd, many, kept in cut(given, begins[lo:hi] - begins[lo], *square):
                    n, ends = len(own), np.concatenate([[0], np.cumsum(many)])
                    for k in range(0, n, 4096):
                        m = min(n - k, 4096)
                        texts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(kept[ends[k] : ends[k + m], c])) for c in range(4)], ["x1", "y1", "x2", "y2"])
                        lists = pa.ListArray.from_arrays(pa.array((ends[k : k + m + 1] - ends[k]).astype(np.int32)), texts).cast(arrow.field(6).type)
                        took = [part.column(0).take(pa.array(own[k : k + m])), np.full(m, level, np.int32), cx[k : k + m], cy[k : k + m], np.full(m, inner), odd[k : k + m].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([took[0], *(pa.array(t) for t in took[1:]), lists], schema=arrow)

    # few polygons are much work: each task gets some
    tasks = 2 * polygons.sparkSession.sparkContext.defaultParallelism
    return stage(own.repartition(tasks).mapInArrow(run, out), "cover")


def _inside(x: Column, y: Column) -> Column:
    """Whether a point of an edge cell is inside and on none of the cell's sides."""

    def crossed(s: Column) -> Column:
        return ((s.y1 > y) != (s.y2 > y)) & (x < F.try_divide((s.x2 - s.x1) * (y - s.y1), s.y2 - s.y1) + s.x1)

    def on(s: Column) -> Column:
        turn = (s.x2 - s.x1) * (y - s.y1) - (s.y2 - s.y1) * (x - s.x1)
        return (turn == 0) & x.between(F.least(s.x1, s.x2), F.greatest(s.x1, s.x2)) & y.between(F.least(s.y1, s.y2), F.greatest(s.y1, s.y2))

    hits = F.size(F.filter("sides", crossed)) + F.col("odd")
    return (hits % 2 == 1) & ~F.exists("sides", on)


def tried(points: DataFrame, cover: DataFrame, square: tuple[float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Each row of points (id, x, y, ...), as _point, with each cell of a cover that holds it: the cell's columns and whether the point is inside."""
    x0, y0, width = square
    levels = sorted(r.level for r in cover.select("level").distinct().collect())
    at = points.where(F.col(x).between(x0, x0 + width) & F.col(y).between(y0, y0 + width))
    at = at.select(F.struct("*").alias("_point"), "id", F.col(x).alias("_x"), F.col(y).alias("_y"), F.explode(F.array(*map(F.lit, levels or [0]))).alias("level"))
    per = F.pow(F.lit(2.0), F.col("level"))
    # a point at a border may come out one cell off, and both cells know the sides there
    column = lambda p, lo: F.floor((F.col(p) - lo) / (width / per))
    held = join_cells(at.withColumns({"cx": column("_x", x0), "cy": column("_y", y0)}), cover, ["level", "cx", "cy"], "id")
    return held.withColumn("inside", F.col("inner") | _inside(F.col("_x"), F.col("_y")))


def within(points: DataFrame, polygons: DataFrame, pid: str, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """points x polygons that contain them, by the even-odd rule, so holes and many parts need nothing more.

    points must have a column id. Points on a side are outside. A point in two polygons is there twice, and repeated
    rows of points each. Points and sides without coordinates match nothing; polygons of one pid are one; no points or no
    polygons give an empty table. Covers are broadcast if they are small; else points are shuffled by cell,
    those of a crowded cell over several tasks.
    """
    corner = edges(polygons, pid, rings).agg(F.min(F.least("x1", "x2")).alias("x"), F.min(F.least("y1", "y2")).alias("y"), F.max(F.greatest("x1", "x2")).alias("xx"), F.max(F.greatest("y1", "y2")).alias("yy")).first()
    if corner.x is None:
        return points.join(polygons.select(pid), F.lit(False))
    square = (corner.x, corner.y, max(corner.xx - corner.x, corner.yy - corner.y) * (1 + 1e-6) or 1.0)
    cover = covered(polygons, pid, square, rings)
    found = points.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct(x, y)).alias("places")).first()
    if 2 * found.places > found.rows:
        return tried(points, cover, square, x, y).where("inside").select("_point.*", pid)
    # many points at few places: a place is tested once, and its points get what it lies in
    held = tried(_places(points, x, y), cover, square).where("inside").select(F.col("_point.x").alias("_px"), F.col("_point.y").alias("_py"), F.col(pid).alias("_pid"))
    here = spread(points).withColumns({"_px": F.col(x), "_py": F.col(y)})
    return join_cells(here, stage(held, "held"), ["_px", "_py"], "id").drop("_px", "_py").withColumnRenamed("_pid", pid)


def _places(points: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, times, id): where points are, and how many."""
    return points.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("times")).withColumn("id", F.xxhash64("x", "y"))


def counts(points: DataFrame, polygons: DataFrame, pid: str, x: str = "x", y: str = "y", rings: str = "rings") -> tuple[int, int]:
    """The rows of points, and those of within(), of which none is made: a place is tested once and counts as often as points are there."""
    places = stage(_places(points, x, y), "places")
    before = places.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("rows")).first().rows
    return before, within(places, polygons, pid, rings=rings).agg(F.coalesce(F.sum("times"), F.lit(0)).alias("rows")).first().rows


def within_and_counted(points: DataFrame, polygons: DataFrame, pid: str, **named) -> tuple[DataFrame, Observation, Observation]:
    """within(), with the points before and the pairs after, and the points among these (about), counted as they pass when the
    result is first computed: rows, and rows and points."""
    before, after = Observation(), Observation()
    held = within(points.observe(before, F.count("*").alias("rows")), polygons, pid, **named)
    return held.observe(after, F.count("*").alias("rows"), F.approx_count_distinct("id", 0.01).alias("points")), before, after
