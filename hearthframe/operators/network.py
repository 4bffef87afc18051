"""Street graphs and distance-bounded shortest paths."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.staging import drop_stage, stage, tidy

#: Written rounds of found distances that are merged into one.
ROUNDS = 8
#: Nodes of a cell, and ways that one task takes into a cell at once.
CELL, WAYS = 512, 20_000
_ENTRY = "origin long, node long, d double"


def graph(lines: DataFrame, parts: str = "parts") -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y) and links (src, dst, w) of lines in metres.

    Nodes are the ends of each part, equal coordinates one node, named by their place in x, y order;
    links run both ways with the part's length, the shortest of parallel ones.
    """
    part = lines.select(F.explode(parts).alias("p")).where("size(p) > 1")
    steps = F.zip_with("p", F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.coalesce(F.sqrt(F.pow(a.x - b.x, 2) + F.pow(a.y - b.y, 2)), F.lit(0.0)))
    ends = stage(part.select(F.col("p")[0].alias("a"), F.element_at("p", -1).alias("b"), F.aggregate(steps, F.lit(0.0), lambda t, d: t + d).alias("w")), "parts")
    nodes = ends.select("a.*").union(ends.select("b.*")).distinct().withColumn("node_id", F.xxhash64("x", "y"))
    both = ends.select(F.xxhash64("a.x", "a.y").alias("src"), F.xxhash64("b.x", "b.y").alias("dst"), "w")
    both = both.union(both.select("dst", "src", "w")).groupBy("src", "dst").agg(F.min("w").alias("w"))
    return nodes.select("node_id", "x", "y"), both


def reach(origins: DataFrame, links: DataFrame, cutoff: float) -> DataFrame:
    """(origin, node, d): shortest distances up to cutoff, included, from each distinct origin (node) along links (src, dst, w).

    Each round extends only the distances that the last one found or made shorter, compares them with
    the known ones of the same places, and writes those that are better; what was written before is not
    written again until ROUNDS rounds are merged. Weights are not negative. Rounds are as many as the
    links of the longest shortest path.
    """
    first = origins.select(F.col("node").alias("origin"), "node").where("node IS NOT NULL").distinct().select("origin", "node", F.lit(0.0).alias("d"))
    links = stage(links.where(F.col("w") <= cutoff).select(F.col("src").alias("node"), "dst", F.col("w").cast("double")), "links")
    found = [stage(first, "reach")]

    def best(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, tables).groupBy("origin", "node").agg(F.min("d").alias("d"))

    while not found[-1].isEmpty():
        step = found[-1].join(links, "node").select("origin", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d")).where(F.col("d") <= cutoff)
        step = stage(step.groupBy("origin", "node").agg(F.min("d").alias("d")), "step")
        places = step.select("origin", "node")  # written, so Spark knows its size and broadcasts it while it is small
        known = best([t.join(places, ["origin", "node"], "left_semi") for t in found]).withColumnRenamed("d", "old")
        found.append(stage(step.join(known, ["origin", "node"], "left").where("old IS NULL OR d < old").select("origin", "node", "d"), "reach"))
        drop_stage(step)
        if len(found) > ROUNDS:
            merged = stage(best(found[:-1]), "reach")
            for t in found[:-1]:
                drop_stage(t)
            found = [merged, found[-1]]
    drop_stage(links)
    return best(found)


def curve_cells(nodes: DataFrame, size: int = CELL) -> DataFrame:
    """(node, cell): nodes (node_id, x, y) in runs of at most size along a Z-curve through the plane, so near nodes mostly share one.

    Nodes without coordinates come together at the end. The runs are cut where the curve's order is sorted, by tasks,
    so a crowded place has more cells and no cell is larger than another.
    """
    box = nodes.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("xx"), F.max("y").alias("yy")).first()
    wide = max((box.xx or 0) - (box.x or 0), (box.yy or 0) - (box.y or 0)) or 1.0
    x0, y0 = box.x or 0.0, box.y or 0.0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.zeros(b.num_rows, np.int64)
            for shift, (column, low) in enumerate(((1, x0), (2, y0))):
                at = b.column(column).to_numpy(zero_copy_only=False)
                at = np.where(np.isnan(at), 2.0**20 - 1, np.floor((at - low) / wide * (2**20 - 1))).astype(np.int64)
                for bit in range(20):
                    key |= (at >> bit & 1) << (2 * bit + shift)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key)], ["node", "key"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = 0, TaskContext.get().partitionId() << 40
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own + (at + np.arange(b.num_rows)) // size)], ["node", "cell"])
            at += b.num_rows

    keyed = nodes.select(F.col("node_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).where("node_id IS NOT NULL").distinct().mapInArrow(keys, "node long, key long")
    # staged first: the cuts of a range are sampled, and must not be drawn twice
    sorted_ = stage(keyed, "keys").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return stage(sorted_.mapInArrow(number, "node long, cell long").dropDuplicates(["node"]), "cells")


def _walks(links: pa.Table, ways: pa.Table, cutoff: float) -> pa.Table:
    """From ways (origin, node, d) into a cell with these links (src, dst, w, inside): distances (origin, node, d, out) of
    the nodes reached in it, and, as out, of the nodes beyond that its links lead to."""
    src, dst, w, inside = (links.column(c).to_numpy() for c in ("src", "dst", "w", "inside"))
    names, at = np.unique(src, return_inverse=True)
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(names) + 1)).tolist()
    to, cost, stays = dst[order].tolist(), w[order].tolist(), inside[order].tolist()
    place = dict(zip(names.tolist(), range(len(names)), strict=True))
    origin, node, d = (ways.column(c).to_numpy() for c in ("origin", "node", "d"))
    by = np.argsort(origin, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(origin[by], prepend=origin[by][:1] - 1)), len(by)) if len(by) else [0]
    out: tuple[list, list, list, list] = ([], [], [], [])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        who = int(origin[by[lo]])
        heap = [(float(d[k]), int(node[k])) for k in by[lo:hi]]
        heapq.heapify(heap)
        best: dict[int, float] = {}
        beyond: dict[int, float] = {}
        while heap:
            far, at_ = heapq.heappop(heap)
            if at_ in best:
                continue
            best[at_] = far
            k = place.get(at_)
            if k is None:
                continue
            for j in range(begin[k], begin[k + 1]):
                further = far + cost[j]
                if further <= cutoff:
                    if not stays[j]:
                        if further < beyond.get(to[j], np.inf):
                            beyond[to[j]] = further
                    elif to[j] not in best:
                        heapq.heappush(heap, (further, to[j]))
        for found, leaves in ((best, False), (beyond, True)):
            out[0].extend([who] * len(found))
            out[1].extend(found)
            out[2].extend(found.values())
            out[3].extend([leaves] * len(found))
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_())], names=["origin", "node", "d", "out"])


def settled(origins: DataFrame, links: DataFrame, cells: DataFrame, cutoff: float) -> tuple[DataFrame, int]:
    """What reach() finds, (origin, node, d), and in how many rounds, with the graph cut into cells (node, cell).

    A round takes all ways that enter a cell through it at once, by a heap search for each origin in the cell's links;
    only the distances at nodes beyond the cell are exchanged, and of these only those that are shorter than the known
    ones go on. So rounds are as many as the cells on the longest shortest path, not its links. Many ways into one cell
    are dealt out over tasks by their origin, each of which gets the cell's links. Nodes without a cell are one
    each. Weights are not negative; null nodes and weights lead nowhere.
    """
    home = lambda df, c: df.join(cells.select(F.col("node").alias(c), "cell"), c, "left").withColumn("cell", F.coalesce("cell", -1 - F.col(c)))
    edges = links.where((F.col("w") <= cutoff) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double"))
    edges = home(home(edges, "src").withColumnRenamed("cell", "own"), "dst").select(F.col("own").alias("cell"), "src", "dst", "w", (F.col("own") == F.col("cell")).alias("inside"))
    edges = stage(edges, "cell-links")
    first = origins.select(F.col("node").cast("long").alias("origin")).where("origin IS NOT NULL").distinct()
    ways = stage(home(first.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("d")), "node"), "ways")
    found, rounds = [], 0

    def best(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, tables).groupBy("origin", "node").agg(F.min("d").alias("d"))

    while not ways.isEmpty():
        rounds += 1
        crowd = stage(ways.groupBy("cell").agg(F.ceil(F.count("*") / WAYS).cast("int").alias("tasks")), "crowd")
        entering = ways.join(crowd, "cell").select("cell", F.pmod(F.xxhash64("origin"), F.col("tasks")).cast("int").alias("task"), "origin", "node", "d")
        streets = edges.join(crowd, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "src", "dst", "w", "inside")
        walked = entering.groupBy("cell", "task").cogroup(streets.groupBy("cell", "task")).applyInArrow(lambda a, b: _walks(b, a, cutoff), f"{_ENTRY}, out boolean")
        walked = stage(walked, "walked")
        drop_stage(crowd)
        drop_stage(ways)
        found.append(walked)
        step = stage(best([walked.where("out").drop("out")]), "step")
        places = step.select("origin", "node")  # written, so Spark knows its size and broadcasts it while it is small
        known = best([t.where("NOT out").drop("out").join(places, ["origin", "node"], "left_semi") for t in found]).withColumnRenamed("d", "old")
        better = step.join(known, ["origin", "node"], "left").where("old IS NULL OR d < old").select("origin", "node", "d")
        ways = stage(home(better, "node"), "ways")
        drop_stage(step)
        if len(found) > ROUNDS:
            merged = stage(best([t.where("NOT out").drop("out") for t in found]).withColumn("out", F.lit(False)), "walked")
            for t in found:
                drop_stage(t)
            found = [merged]
    drop_stage(edges)
    return best([t.where("NOT out").drop("out") for t in found] or [first.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("d")).limit(0)]), rounds


@tidy
def reach_by_cells(origins: DataFrame, links: DataFrame, nodes: DataFrame, cutoff: float, size: int = CELL) -> DataFrame:
    """reach(), in rounds over cells of at most size nodes (node_id, x, y) that lie near each other; see settled()."""
    return settled(origins, links, curve_cells(nodes, size), cutoff)[0]
