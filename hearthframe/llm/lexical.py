"""Ranked lexical search: MaxScore over the shards of an inverted index.

index() cuts the documents into shards of about SHARD terms, each made by one task without a shuffle, and
writes a row for each term of a shard: its documents in ascending doc_id, how often each holds it, and the two
numbers that bound what the term can add to a score there. search() reads only the terms of its items. In each
shard, the terms of an item are split by these bounds: the lists of the essential ones are read, those of the
others are only probed for documents that can still come among the best, a block of documents after the other
with a rising threshold. The threshold starts at what one term alone proves, and, where there are many shards,
at what some of them have found.

Scores are whole numbers, so results are the same in any cut of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthframe.llm.common import small_batches, table
from hearthframe.operators.joins import small_side
from hearthframe.staging import stage, tidy

#: Documents that an item gets at most.
BEST = 50
#: Terms of a shard, about; a longer document is a shard of its own.
SHARD = 2_000_000
#: Documents between two looks at the threshold.
STEP = 512
#: Terms of items that are sent to the executors at once; more items are gone through in blocks.
BLOCK = 500_000
#: One of so many shards is searched first, for thresholds of the others.
FIRST = 16
#: Bytes of a text that are split at once, and rows of one Arrow batch.
AT_ONCE, ROWS = 1 << 20, 20_000
#: A document's m is FLAT and LENGTH times its share of the mean length; SCALE and the factors of tf and m.
FLAT, LENGTH, SCALE, OF_TF, OF_M, WEIGHT = 50, 50, 1_000_000_000, 1000, 20, 1000
#: Bytes of terms: digits, letters (A-Z lower-cased) and all that is not ASCII; the others part them.
_TERMS = bytes(k if k > 127 or chr(k).isalnum() else 32 for k in range(256)).lower()
_INDEX = "shard long, term binary, most long, least long, docs binary, tfs binary, doc_ids array<long>, sizes array<long>"


class _Codes(dict):
    """Numbers of terms, in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text with repeats, those of some AT_ONCE bytes at a time."""
    raw, lo = (text or b"").translate(_TERMS), 0
    while lo < len(raw):
        hi = len(raw) if len(raw) - lo <= AT_ONCE else raw.rfind(b" ", lo, lo + AT_ONCE)
        if hi <= lo:  # a very long term
            hi = raw.find(b" ", lo + 1)
            hi = len(raw) if hi < 0 else hi
        yield raw[lo:hi].split()
        lo = hi


class _Shard:
    """Documents and their terms until they are written."""

    def __init__(self) -> None:
        self.codes, self.ids, self.sizes, self.keys, self.times, self.held, self.full = _Codes(), [], [], [], [], 0, 2 * SHARD

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        size = 0
        for terms in pieces(text):
            if terms:
                codes = np.fromiter(map(self.codes.__getitem__, terms), np.int64, len(terms))
                self.keys.append(codes << 32 | len(self.ids))
                self.times.append(np.ones(len(codes), np.int64))
                self.held += len(codes)
                size += len(codes)
            if self.held > self.full:
                self._count()
                self.full = max(2 * SHARD, 2 * self.held)
        if size:
            self.ids.append(doc_id)
            self.sizes.append(size)

    def _count(self) -> None:
        """Puts equal pairs of term and document together."""
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.times = [keys[first]], [np.add.reduceat(times, first)]
        self.held = len(first)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row with the documents, and one for each term."""
        if not self.ids:
            return
        names = [x.split()[0] for x in _INDEX.split(", ")]
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        sizes = np.array(self.sizes, np.int64)[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        one = [[shard], [None], [None], [None], [None], [None], [[self.ids[k] for k in order]], [sizes.tolist()]]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], names)
        self._count()
        self.keys = [self.keys[0] >> 32 << 32 | place[self.keys[0] & 0xFFFFFFFF]]
        self._count()
        keys, times = self.keys[0], self.times[0].astype(np.int32)
        terms = list(self.codes)
        begin = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
        docs = (keys & 0xFFFFFFFF).astype(np.int32)
        most, least = np.maximum.reduceat(times, begin).astype(np.int64), np.minimum.reduceat(sizes[docs], begin)
        edges = np.append(begin, len(keys))
        for lo in range(0, len(terms), ROWS):
            hi = min(lo + ROWS, len(terms))
            offsets = ((edges[lo : hi + 1] - edges[lo]) * 4).astype(np.int32)
            lists = (pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(x[edges[lo] : edges[hi]].tobytes())]) for x in (docs, times))
            made = [pa.array(np.full(hi - lo, shard)), pa.array(terms[lo:hi], pa.binary()), pa.array(most[lo:hi]), pa.array(least[lo:hi]), *lists, *(pa.nulls(hi - lo, k) for k in kinds[6:])]
            yield pa.RecordBatch.from_arrays(made, names)


def index(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the written index of all of them: rows of _INDEX, one without a term for the documents of a shard.

    Documents without a term are not in it. Null doc_ids come last in a shard; repeated rows are documents of
    their own; texts of any length are read whole; an empty table gives an empty index. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n = _Shard(), TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                shard.add(doc_id.as_py(), text.as_py())
                if shard.held >= SHARD:
                    yield from shard.rows(n)
                    shard, n = _Shard(), n + 1
        yield from shard.rows(n)

    return stage(small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _INDEX), "index")


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> (item_id, term): the distinct terms of each item; rows of one item_id, null too, are one item."""
    kind = items.schema["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = sorted({t for part in pieces(b.column(1)[k].as_py()) for t in part})
                for lo in range(0, len(found), ROWS):
                    terms = found[lo : lo + ROWS]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(terms), pa.int64())), pa.array(terms, pa.binary())], ["item_id", "term"])

    out = T.StructType([T.StructField("item_id", kind), T.StructField("term", T.BinaryType())])
    return small_batches(items).select("item_id", F.col("text").cast("binary")).mapInArrow(run, out).distinct()


class Lists:
    """The postings of one shard: for each term its documents and what it adds to the score of each."""

    def __init__(self, sizes: np.ndarray, n_docs: int, n_terms: int, best: int) -> None:
        self.m = FLAT + (LENGTH * sizes * n_docs) // n_terms
        self.edges = np.arange(0, len(sizes) + STEP, STEP)
        self.n_docs, self.n_terms, self.best = n_docs, n_terms, best
        self.raw: dict[bytes, tuple[int, np.ndarray, np.ndarray]] = {}
        self.read: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bound: dict[bytes, int] = {}
        self.sure: dict[bytes, int] = {}

    def add(self, term: bytes, weight: int, docs: np.ndarray, tfs: np.ndarray, most: int, least: int) -> None:
        m = FLAT + (LENGTH * least * self.n_docs) // self.n_terms
        self.bound[term] = weight * ((SCALE * most) // (OF_TF * most + OF_M * m))
        self.raw[term] = (weight, docs, tfs)

    def postings(self, term: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, what the term adds, and where each block begins; computed when a list is first read."""
        if term not in self.read:
            weight, docs, tfs = self.raw.pop(term)
            adds = weight * ((SCALE * tfs.astype(np.int64)) // (OF_TF * tfs.astype(np.int64) + OF_M * self.m[docs]))
            self.sure[term] = int(np.partition(adds, len(adds) - self.best)[len(adds) - self.best]) if len(adds) >= self.best else 0
            self.read[term] = docs, adds, np.searchsorted(docs, self.edges)
        return self.read[term]

    def search(self, terms: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by place, ascending in doc_id) and scores of the best that reach at least this score, best first, earlier first on ties."""
        terms = sorted((t for t in terms if self.bound.get(t)), key=self.bound.__getitem__)
        upto = np.cumsum([self.bound[t] for t in terms])
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not terms or upto[-1] < least:
            return docs, scores
        for t in terms[-3:]:  # the best documents of one term have that score at least
            self.postings(t)
            least = max(least, self.sure[t])
        acc = np.zeros(STEP, np.int64)
        for k in range(len(self.edges) - 1):
            essential = int(np.searchsorted(upto, least))
            if essential == len(terms):
                break
            acc[:] = 0
            for t in terms[essential:]:
                own, adds, at = self.postings(t)
                acc[own[at[k] : at[k + 1]] - self.edges[k]] += adds[at[k] : at[k + 1]]
            left = np.flatnonzero(acc)
            for j in range(essential - 1, -1, -1):
                left = left[acc[left] + upto[j] >= least]
                if not len(left):
                    break
                own, adds, at = self.postings(terms[j])
                here = own[at[k] : at[k + 1]]
                if len(here):
                    p = np.minimum(np.searchsorted(here, left + self.edges[k]), len(here) - 1)
                    acc[left] += np.where(here[p] == left + self.edges[k], adds[at[k] + p], 0)
            left = left[acc[left] >= least]
            if len(left):
                docs, scores = np.concatenate((docs, left + self.edges[k])), np.concatenate((scores, acc[left]))
                if len(docs) >= self.best:
                    order = np.lexsort((docs, -scores))[: self.best]
                    docs, scores = docs[order], scores[order]
                    least = max(least, int(scores[-1]) + 1)  # later documents have larger doc_ids
        order = np.lexsort((docs, -scores))
        return docs[order], scores[order]


def _found(postings: DataFrame, block: list, least: list[int], numbers: tuple[int, int], best: int, kind: T.DataType) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each shard for the items of a block (item_id, [(term, weight)])."""
    sent = postings.sparkSession.sparkContext.broadcast(([(i, [bytes(t) for t, _ in terms]) for i, terms in block], {bytes(t): int(w) for _, terms in block for t, w in terms}, least))
    out = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        items, weights, lows = sent.value
        row = group.filter(group.column("term").is_null()).slice(0, 1)
        ids = row.column("doc_ids")[0].values
        lists = Lists(row.column("sizes")[0].values.to_numpy(), *numbers, best)
        for b in group.to_batches():
            for term, most, low, docs, tfs in zip(*(b.column(c) for c in ("term", "most", "least", "docs", "tfs")), strict=True):
                if (t := term.as_py()) in weights:
                    lists.add(t, weights[t], np.frombuffer(docs.as_py(), np.int32), np.frombuffer(tfs.as_py(), np.int32), most.as_py(), low.as_py())
        whose, docs, scores = [], [], []
        for (item, terms), low in zip(items, lows, strict=True):
            d, s = lists.search(terms, low)
            whose += [item] * len(d)
            docs.append(d)
            scores.append(s)
        d = pa.array(np.concatenate(docs) if docs else np.zeros(0, np.int64))
        return pa.table([pa.array(whose, kinds.field(0).type), ids.take(d), pa.array(np.concatenate(scores) if scores else np.zeros(0, np.int64))], names=["item_id", "doc_id", "score"])

    kinds = to_arrow_schema(out)
    return postings.groupBy("shard").applyInArrow(run, out)


def _top(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """Rows of queries (item_id, terms), as many at once as have about so many terms."""
    block, held = [], 0
    for r in queries.toLocalIterator():
        if block and held + len(r.terms) > size:
            yield block
            block, held = [], 0
        block.append((r.item_id, [(t.term, t.weight) for t in r.terms]))
        held += len(r.terms)
    if block:
        yield block


def search(postings: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """An index() and items (item_id, text) -> (item_id, rank, doc_id, score): the best documents of each item, best first.

    Only documents with a score above 0 count; equal scores go by ascending doc_id, null last. Rows of one item_id,
    null too, are one item with the terms of all; items without a term, or whose terms no document holds, have no
    rows, and so have null and empty texts. An empty index or no items give an empty table. Other columns are ignored.
    """
    kind = items.schema["item_id"].dataType
    sizes = postings.where("term IS NULL")
    n = sizes.agg(F.sum(F.size("doc_ids")).alias("docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms"), F.count("*").alias("shards")).first()
    asked = stage(item_terms(items), "item-terms")
    terms = small_side(stage(asked.select("term").distinct(), "terms"), written=True)
    lists = postings.join(terms, "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("df"))
    weight = F.floor(WEIGHT * F.log(F.lit(2.0 * (n.docs or 0) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = asked.join(df.select("term", weight.alias("weight")).where("weight > 0"), "term")
    queries = stage(weights.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "queries")
    both = lists.select(postings.columns).union(sizes)
    found = postings.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for block in _blocks(queries, BLOCK):
        least = [1] * len(block)
        rest = both
        if n.shards > 4 * FIRST:
            early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
            some = stage(_top(_found(both.where(early), block, least, (n.docs, n.terms), best, kind), best), "first")
            low = {r.item_id: r.score for r in some.where(F.col("rank") == best).collect()}
            least = [low.get(i, 1) for i, _ in block]
            found, rest = found.union(some.drop("rank")), both.where(~early)
        found = found.union(_found(rest, block, least, (n.docs, n.terms), best, kind))
    return _top(found, best).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


@tidy
def op11(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score over all documents and items; nulls, ties and long texts as in search() and index().

    The index is built, and the terms are weighed, when the query is made; the shards are searched when it is read.
    """
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP11_SQL = f"""
WITH held AS (SELECT doc_id, {_TERMS_SQL} FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor({WEIGHT} * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, docs),
m AS (SELECT doc_id, {FLAT} + ({LENGTH} * n * docs) // terms AS m FROM sizes, total),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS_SQL} FROM benchmark)),
scores AS (SELECT item_id, doc_id, CAST(sum(w * (({SCALE} * tf) // ({OF_TF} * tf + {OF_M} * m))) AS BIGINT) AS score FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {BEST}
"""
