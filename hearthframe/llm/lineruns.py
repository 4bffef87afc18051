"""Removal of repeated line runs by a suffix array over line sequences.

Lines are numbered by their 128-bit hashes, and each document is a sequence of its lines that hold a
word. Prefix doubling sorts the suffixes of all documents by their first 1, 2, 4, ... lines: the rank of
a suffix is the place in the suffix array where the interval of suffixes with the same beginning starts.
Suffixes whose beginning occurs once leave the table, so each round is smaller than the one before.

A run of at least MIN_WORDS words that occurs twice is one whose every shortest stretch of so many words,
from any of its lines on or up to any of its lines, occurs twice, as these stretches cover it. A stretch
of m lines is named by m and the ranks, in the array of depth 2^k <= m, of its first and its last 2^k
lines; so equal names are one interval of suffixes with at least m common lines, and MIN_WORDS bounds the
rounds. Of each interval the first suffix in the order of doc_id and line stays, and the lines of the
others' stretches go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthframe.llm.common import fresh, small_batches, table
from hearthframe.operators.joins import join_hot
from hearthframe.staging import drop_stage, stage, tidy

#: Words of a run at least.
MIN_WORDS = 50
#: Rows of lines in one Arrow batch.
ROWS = 50_000
_LINES = "doc_id long, doc long, seq int, h1 long, h2 long, ahead int, back int"
PLACE = ["doc_id", "doc"]


def stretches(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest stretch of so many words from each line on, and up to each line; 0 if there is none."""
    upto = np.concatenate(([0], np.cumsum(words)))
    ahead = np.searchsorted(upto, upto[:-1] + least) - np.arange(len(words))
    ahead[upto[:-1] + least > upto[-1]] = 0
    back = np.arange(1, len(words) + 1) - (np.searchsorted(upto, upto[1:] - least, side="right") - 1)
    back[upto[1:] < least] = 0
    return ahead, back


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """docs (doc_id, text) -> one row for each line that holds a word: its document (doc_id and a hash of the text), its
    number among these lines, two hashes, and stretches()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = [x for x in map(bytes.strip, (text or b"").split(b"\n")) if x]
                if not lines:
                    continue
                hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<i8").reshape(-1, 2)
                ahead, back = stretches(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), least)
                doc = xxhash.xxh3_64_intdigest(text) - 2**63
                n = len(lines)
                rows.append([pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, doc)), pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(ahead.astype(np.int32)), pa.array(back.astype(np.int32))])
                held += n
                if held >= ROWS:
                    yield from _joined(rows)
                    rows, held = [], 0
            yield from _joined(rows)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _LINES)


def _joined(rows: list[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows, strict=True)], [x.split()[0] for x in _LINES.split(", ")])


def first_ranks(lines: DataFrame) -> DataFrame:
    """(doc_id, doc, seq, rank) of the lines that occur twice, by depth 1: ranks follow the hashes.

    The ranks are running sums in two steps: over the cells of equal high bits, and inside each cell.
    """
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("cell", F.shiftright("h1", 48))
    counts = stage(counts, "lines-twice")
    cells = counts.groupBy("cell").agg(F.sum("n").alias("size"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    before = Window.partitionBy("cell").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranks = stage(counts.join(cells, "cell").select("h1", "h2", (F.col("start") + F.col("inside")).alias("rank"), "n"), "line-ranks")
    return join_hot(lines, ranks, ["h1", "h2"], "n").select(*PLACE, "seq", "rank")


def doubled(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks by 2 * depth lines from those by depth lines, written, of the suffixes whose first 2 * depth lines occur twice."""
    after = ranks.select(*PLACE, (F.col("seq") - depth).alias("seq"), F.col("rank").alias("next"))
    pairs = stage(_beside(ranks, after, "seq"), "pairs")
    counts = stage(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).withColumn("cell", F.shiftright("next", 16)), "followers")
    # sums in two steps, as one line may have very many followers: over cells of ranks, and inside each cell
    before = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("rank", "cell").agg(F.sum("n").alias("size"))
    cells = cells.select("rank", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    before = Window.partitionBy("rank", "cell").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    deep = counts.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 1").join(cells, ["rank", "cell"])
    deeper = stage(deep.select("rank", "next", (F.col("rank") + F.col("start") + F.col("inside")).alias("deeper"), "n"), "deeper")
    found = stage(join_hot(pairs, deeper, ["rank", "next"], "n").select(*PLACE, "seq", F.col("deeper").alias("rank")), "ranks")
    for used in (pairs, counts, deeper):
        drop_stage(used)
    return found


def _beside(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """The rows of left with those of right at the same place of the same document, null doc_ids included."""
    right = right.select(*(F.col(c).alias(f"{c}_") if c in (*PLACE, *by) else F.col(c) for c in right.columns))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_"))
    for c in ("doc", *by):
        same = same & (F.col(c) == F.col(f"{c}_"))
    return left.join(right, same).drop(*(f"{c}_" for c in (*PLACE, *by)))


def later_copies(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, doc, begin, n): stretches of n lines that occur earlier, by lines that hold a word."""
    lines = line_table(docs, least)
    ids = docs.select("doc_id", F.xxhash64("text").alias("hash")).groupBy("doc_id", "hash").count()
    if not ids.where("count > 1").isEmpty():
        lines = lines.distinct()
    lines = stage(lines, "lines")
    ranks, depth, levels = stage(first_ranks(lines), "ranks"), 1, []
    while True:
        levels.append(ranks.withColumn("depth", F.lit(depth)))
        if 2 * depth > least:
            break
        ranks, depth = doubled(ranks, depth), 2 * depth
    ranks = levels[0]
    for level in levels[1:]:
        ranks = ranks.union(level)
    ahead = lines.where("ahead > 0").select(*PLACE, F.col("seq").alias("begin"), F.col("ahead").alias("n"))
    back = lines.where("back > 0").select(*PLACE, (F.col("seq") - F.col("back") + 1).alias("begin"), F.col("back").alias("n"))
    found = ahead.union(back).withColumn("depth", F.expr("CAST(shiftleft(1, CAST(floor(log2(n)) AS INT)) AS INT)")).withColumnRenamed("begin", "seq")
    found = _beside(found, ranks, "depth", "seq").withColumnRenamed("rank", "head").withColumnRenamed("seq", "begin")
    found = found.withColumn("seq", F.col("begin") + F.col("n") - F.col("depth"))
    found = _beside(found, ranks, "depth", "seq").select(*PLACE, "begin", "n", "head", F.col("rank").alias("tail")).distinct()
    found = stage(found, "stretches")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", "begin")
    first = found.groupBy("n", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    joined = join_hot(found, stage(first, "first"), ["n", "head", "tail"], "times")
    return joined.where(place > F.col("first")).select(*PLACE, "begin", "n")


def _cut(text: bytes | None, begins: list[int] | None, counts: list[int] | None) -> tuple[bytes | None, int, int]:
    """A text without these stretches, its lines, and how many of them went."""
    lines = text.split(b"\n") if text else []
    if not begins:
        return text, len(lines), 0
    holds = np.flatnonzero([bool(x.strip()) for x in lines])
    edge = np.zeros(len(holds) + 1, np.int64)
    np.add.at(edge, np.array(begins), 1)
    np.add.at(edge, np.array(begins) + np.array(counts), -1)
    gone = set(holds[np.cumsum(edge)[:-1] > 0].tolist())
    return b"\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)


@tidy
def without_repeats(docs: DataFrame, least: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with the later copies of repeated line runs taken out of text; counts adds n_lines and n_removed.

    Lines are compared without ASCII white space at either end; lines without a word are passed over and
    stay. Documents are ordered by doc_id, null last, then by a hash of the text; repeated rows are one
    document. A run may overlap its copy, as when one line repeats: then its first period stays. A null
    text stays null and an empty one empty; a text may become empty; an empty table gives an empty one.
    """
    copies = later_copies(docs.select("doc_id", "text"), least).distinct()
    spans = copies.groupBy(*PLACE).agg(F.collect_list("begin").alias("begins"), F.collect_list("n").alias("counts"))

    def cut(texts: pa.Array, begins: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = [_cut(*x) for x in zip(texts.to_pylist(), begins.to_pylist(), sizes.to_pylist(), strict=True)]
        made = [pa.array([None if r[0] is None else r[0].decode("utf-8") for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
        return pa.StructArray.from_arrays(made, ["text", "n_lines", "n_removed"])

    def name(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else xxhash.xxh3_64_intdigest(x) - 2**63 for x in texts.to_pylist()], pa.int64())

    taken = list(docs.columns)
    doc, out, own_id, own_doc, begins, sizes = (taken.append(c) or c for c in map(lambda c: fresh(c, taken), ("doc", "out", "own_id", "own_doc", "begins", "sizes")))
    text = F.col("text").cast("binary")
    held = docs.select("*", F.arrow_udf(name, "long")(text).alias(doc))
    spans = spans.select(F.col("doc_id").alias(own_id), F.col("doc").alias(own_doc), F.col("begins").alias(begins), F.col("counts").alias(sizes))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(doc) == F.col(own_doc))
    held = held.join(spans, same, "left").withColumn(out, F.arrow_udf(cut, "text string, n_lines long, n_removed long")(text, begins, sizes))
    kept = [F.col(f"{out}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return held.select(*kept, *([F.col(f"{out}.n_lines"), F.col(f"{out}.n_removed")] if counts else []))


@tidy
def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines, n_removed: one row for each document."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
