"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by a hash of doc_id, a quarter as many as its documents' square
root; so a source's list of blocks and a single block both stay small against the source. A source
whose target is r times its size has floor(r) whole passes of its blocks drawn, and as many blocks of
one more permuted pass as fit; of the block at the edge, documents are drawn in permuted order as far
as they fit.

The drawn blocks of all sources are then dealt out to the output shards by a tree: each node splits
its exact quotas (blocks by source) in two by one multivariate-hypergeometric draw, until a node is
one shard. A shard takes its quota as the next blocks of the source's permuted sequence, and orders
its documents by a hash of its own. All draws follow from the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthframe.llm.common import table, word_count
from hearthframe.operators.joins import small_side
from hearthframe.staging import stage, tidy

#: Drawn blocks for each output shard, and output shards at least.
PER_SHARD, FEWEST = 8, 16
#: A source of n documents has sqrt(n) / SHARE blocks.
SHARE = 4
#: Documents on either side of the edge of an edge block of which the best subset is taken.
NEAR = 32


@dataclass(frozen=True)
class Mix:
    """weights: by the rank of a source in code point order (null last), repeating; share: what the mix takes of
    all words; most: the passes of a source at most; shards: output shards, by default one for each PER_SHARD drawn
    blocks, FEWEST at least."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    shards: int | None = None
    seed: int = 17


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block quotas: the tree from all blocks at the root to one shard at each leaf."""
    out = np.zeros((shards, len(quotas)), np.int64)
    every = np.arange(len(quotas))
    for lo, _, source, n, _ in nodes_of(0, shards, every, np.asarray(quotas, np.int64), np.zeros(len(quotas), np.int64), 1, seed):
        out[lo, source] = n
    return out


def nodes_of(lo: int, hi: int, source: np.ndarray, n: np.ndarray, begin: np.ndarray, width: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes (first shard, end, sources, quotas, first blocks) of at most width shards below the node of shards lo to hi.

    A node knows only the sources that it has blocks of, and draws by its own seed.
    """
    nodes = [(lo, hi, source, n, begin)]
    while nodes:
        lo, hi, source, n, begin = nodes.pop()
        if hi - lo <= width:
            yield lo, hi, source, n, begin
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(n, int(n.sum()) * (mid - lo) // (hi - lo), method="marginals")
        for x, y, part, at in ((lo, mid, left, begin), (mid, hi, n - left, begin + left)):
            some = part > 0
            nodes.append((x, y, source[some], part[some], at[some]))


def targets(sources: DataFrame, how: Mix) -> DataFrame:
    """sources (source, source_size) -> with source_no and target: words by weight, none above most times its size.

    Sources are ordered by how soon their cap binds; the level (words for a weight of 1) at the first
    source that isn't capped is the level of all that aren't.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    out = sources.withColumn("source_no", F.row_number().over(order) - 1)
    weights = F.array(*(F.lit(float(w)) for w in how.weights))
    out = out.withColumn("weight", F.element_at(weights, (F.col("source_no") % len(how.weights) + 1).cast("int")))
    out = out.withColumn("cap", how.most * F.col("source_size")).withColumn("binds", F.col("cap") / F.col("weight"))
    before = Window.orderBy("binds", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = how.share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    out = out.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = F.min(F.when(F.col("binds") > F.col("level"), F.struct("binds", "source_no", "level"))).over(every)
    out = out.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return out.withColumn("target", target.cast("double")).drop("weight", "cap", "binds", "level")


def _block(how: Mix) -> Column:
    return F.pmod(F.xxhash64(F.lit(how.seed), F.col("doc_id").cast("long")), "n_blocks")


def fitted(sizes: list[int], room: float) -> np.ndarray:
    """Which of the documents in this order to take: the first ones that fit, but of the NEAR documents on either
    side of the edge the subset that fills the room best (in steps of a millionth of it)."""
    upto = np.cumsum(np.asarray(sizes, np.int64))
    edge = int(np.searchsorted(upto, room, side="right"))
    lo, hi = max(0, edge - NEAR), min(len(sizes), edge + NEAR)
    room = int(room) - (int(upto[lo - 1]) if lo else 0)
    step = room // 1_000_000 + 1
    near = [-(-int(s) // step) for s in sizes[lo:hi]]
    within = (1 << (room // step + 1)) - 1
    sums = [1]
    for s in near:
        sums.append((sums[-1] | sums[-1] << s) & within)
    taken = np.arange(len(sizes)) < lo
    left = sums[-1].bit_length() - 1
    for k in reversed(range(len(near))):
        if not sums[k] >> left & 1:
            taken[lo + k] = True
            left -= near[k]
    return taken


@dataclass
class Plan:
    """sources: source, source_size, source_no, target, n_blocks; draws: source_no, block, drawn (array of shard,
    pass, edge); picks: source_no, doc_id of the edge blocks' drawn documents; shards: output shards."""

    sources: DataFrame
    draws: DataFrame
    picks: DataFrame
    shards: int


def plan(sizes: DataFrame, how: Mix) -> Plan:
    """sizes (doc_id, source, size), a written table -> which blocks and edge documents the mix draws, and where to."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = found.withColumn("n_blocks", F.ceil(F.sqrt("n") / SHARE).cast("long")).drop("n")
    sources = small_side(targets(found, how))
    numbered = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).select("source_no", _block(how).alias("block"), "doc_id", "size")
    blocks = numbered.groupBy("source_no", "block").agg(F.sum("size").alias("words"))

    # whole passes, then the blocks of a permuted last pass that fit, then the block at the edge
    levels = sources.select("source_no", F.expr("CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END").alias("passes"), "source_size", "target")
    blocks = blocks.join(levels, "source_no")
    order = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(how.seed + 1), "source_no", "block"), "block")
    blocks = blocks.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    last = F.when(F.col("upto") <= rest, "whole").when((F.col("upto") - F.col("words")) < rest, "edge")
    blocks = blocks.withColumn("last", last).withColumn("room", rest - (F.col("upto") - F.col("words")))
    times = F.expr("sequence(1, CAST(passes AS INT) + IF(last IS NULL, 0, 1))")
    drawn = blocks.where("passes + IF(last IS NULL, 0, 1) > 0").select("source_no", "block", "passes", "room", "last", F.explode(times).alias("pass"))
    drawn = drawn.withColumn("edge", F.expr("pass > passes AND last = 'edge'"))
    order = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(how.seed + 2), "source_no", "block", "pass"), "block", "pass")
    drawn = stage(drawn.select("source_no", "block", "pass", "edge", "room", (F.row_number().over(order) - 1).alias("at")), "drawn")

    shards = how.shards or max(FEWEST, drawn.count() // PER_SHARD)

    # the upper half of the tree, then each of its leaves by itself: no task holds all shards' quotas
    upper = 1 << (max(shards - 1, 1).bit_length() + 1) // 2
    columns = "lo int, hi int, source_no int, n long, begin long"

    def grown(width: int):
        def tree(key, rows):
            rows = rows.sort_values("source_no")
            lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
            made = nodes_of(lo, hi, *(rows[c].to_numpy(np.int64) for c in ("source_no", "n", "begin")), width, how.seed)
            parts = [pd.DataFrame({"lo": x, "hi": y, "source_no": s, "n": n, "begin": at}) for x, y, s, n, at in made if len(s)]
            return pd.concat(parts).astype({"lo": np.int32, "hi": np.int32, "source_no": np.int32})

        return tree

    quotas = drawn.groupBy("source_no").agg(F.count("*").alias("n"))
    root = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "source_no", "n", F.lit(0).cast("long").alias("begin"))
    dealt = root.groupBy("lo").applyInPandas(grown(upper), columns).groupBy("lo").applyInPandas(grown(1), columns)
    dealt = dealt.select("source_no", F.col("lo").alias("shard"), "begin", (F.col("begin") + F.col("n")).alias("end"))
    dealt = dealt.select("source_no", "shard", F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
    draws = drawn.join(dealt, ["source_no", "at"]).groupBy("source_no", "block")
    draws = draws.agg(F.collect_list(F.struct("shard", "pass", "edge")).alias("drawn"))

    def fit(key, docs):
        docs = docs.sort_values(["order", "doc_id"])
        return docs[fitted(docs["size"].tolist(), docs["room"].iloc[0])][["source_no", "doc_id"]].astype({"doc_id": "Int64"})

    edges = small_side(drawn.where("edge").select("source_no", "block", "room"))
    near = numbered.join(edges, ["source_no", "block"]).groupBy("source_no", "doc_id").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    near = near.withColumn("order", F.xxhash64(F.lit(how.seed + 3), "doc_id"))
    picks = near.groupBy("source_no").applyInPandas(fit, "source_no int, doc_id long")
    return Plan(sources, small_side(draws), small_side(picks), shards)


def drawn(rows: DataFrame, made: Plan, how: Mix) -> DataFrame:
    """rows (doc_id, source, ...) -> with source_size, target and mixed, an array of (shard, pass) for each time it is drawn."""
    s, d, p = made.sources, made.draws, made.picks.withColumn("picked", F.lit(True))
    held = rows.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_source"))
    held = held.join(s, held._source.eqNullSafe(s.source)).select("row", "_id", "source_no", "source_size", "target", F.pmod(F.xxhash64(F.lit(how.seed), "_id"), "n_blocks").alias("block"))
    held = held.join(d, ["source_no", "block"], "left")
    held = held.join(p.select(F.col("source_no").alias("_no"), F.col("doc_id").alias("_pick"), "picked"), F.expr("source_no = _no AND _id <=> _pick"), "left")
    mixed = F.expr("filter(drawn, x -> NOT x.edge OR picked IS NOT NULL)")
    return held.select("row", "source_size", "target", F.coalesce(mixed, F.expr("filter(array(struct(0 AS shard, 0 AS pass, false AS edge)), x -> false)")).alias("mixed"))


def sizes_of(docs: DataFrame) -> DataFrame:
    return stage(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size")), "sizes")


@tidy
def mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mixed documents: the columns of docs, one row for each time a row is drawn, shard by shard in shuffled order.

    Rows of one doc_id in one source are drawn together, those without a doc_id in one block as well.
    Null texts have no words and null sources are one source; sources without words have target 0 and
    give no rows beyond whole passes; long texts are documents like any other; an empty table gives an
    empty one. Whole-number doc_ids of any type draw the same; all columns stay, whatever their names.
    """
    made = plan(sizes_of(docs), how)
    out = drawn(docs, made, how).select("row", F.explode("mixed").alias("at"))
    out = out.withColumn("order", F.xxhash64(F.lit(how.seed + 4), "at.shard", F.col("row.doc_id").cast("long"), "at.pass"))
    out = out.repartitionByRange(made.shards, F.col("at.shard")).sortWithinPartitions(F.col("at.shard"), "order")
    return out.select("row.*")


@tidy
def op1(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document."""
    how = Mix()
    sizes = sizes_of(table(spark, sf_dir, "documents"))
    out = drawn(sizes, plan(sizes, how), how)
    taken = (F.col("row.size") * F.size("mixed")).cast("long")
    return out.select("row.doc_id", "row.size", "source_size", "target", taken.alias("taken"), F.col("mixed.shard").alias("shards"))
