"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share enough runs of SHORTEST words are compared. Tiles are runs of words
that both hold; the longest tile among the words not yet marked is marked again and again, down to
SHORTEST words, so passages whose parts were put in another order are still covered. The share of an
item's words that is covered decides.

Seeds are found by rolling hashes over the hashes of words, which are taken from the bytes of a text at
once; only a text that holds a seed is taken apart into words. Runs that meet are then extended along
their diagonal, and words and not hashes are compared.
"""

from __future__ import annotations

import functools
import heapq
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hearthframe.llm.common import fresh, small_batches, table
from hearthframe.staging import stage, tidy

#: Words of a seed and of a tile at least, and covered share of an item from which a document holds it.
SHORTEST, COVER = 3, 0.5
#: Words of the benchmark that are sent to the executors at once; a larger benchmark is gone through in blocks.
BLOCK = 2_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes(32 if chr(k) in "\t\n\v\f\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else k for k in range(256))
#: Bytes that are hashed at once.
AT_ONCE = 1 << 20
#: Bits of the table that says which words may be the benchmark's.
TABLE = 18


def plain(text: str | None) -> bytes:
    """A text in lower case with ASCII punctuation and white space as spaces."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES) if text else b""


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte; the powers of an odd number, and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    of = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
    up, down = (np.full(AT_ONCE + 1, x, np.uint64) for x in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return of, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a plain() text, the same wherever the word stands."""
    of, up, down = _powers()
    out, lo = [], 0
    while lo < len(raw):
        hi = len(raw)
        if hi - lo > AT_ONCE:
            cut = raw.rfind(b" ", lo, lo + AT_ONCE)
            hi = lo + AT_ONCE if cut <= lo else cut
        data = np.frombuffer(raw, np.uint8, hi - lo, lo)
        edge = np.flatnonzero(np.diff(data == 32, prepend=True, append=True))
        begin, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(of[data] * up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin]
        out.append((h ^ (h >> np.uint64(31))) * _PRIME)
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rolling_at(numbers: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k numbers that begin at these places."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = (out * _PRIME) + numbers[at + j].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out


def rolling(numbers: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k numbers."""
    return rolling_at(numbers, np.arange(max(0, len(numbers) - k + 1)), k)


def _matches(item: np.ndarray, text: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of at least shortest words that both hold: places in item and text, and words.

    Only where a run begins is kept, so memory follows the runs and the text, not all pairs of equal words.
    """
    keys, which = np.unique(rolling(item, shortest), return_inverse=True)
    other = rolling(text, shortest)
    at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
    held = np.flatnonzero(keys[at] == other)
    order = np.argsort(at[held], kind="stable")
    ends = np.searchsorted(at[held][order], np.arange(len(keys) + 1))
    places, item_at, text_at = held[order], [], []
    for i, c in enumerate(which.tolist()):
        j = places[ends[c] : ends[c + 1]]
        if i:
            j = j[(j == 0) | (text[j - 1] != item[i - 1])]
        for k in range(shortest):
            j = j[text[j + k] == item[i + k]]
        item_at.append(np.full(len(j), i, np.int32))
        text_at.append(j)
    i, j = np.concatenate(item_at), np.concatenate(text_at)
    size, going, k = np.full(len(i), shortest, np.int32), np.arange(len(i)), shortest
    while len(going):
        going = going[(i[going] + k < len(item)) & (j[going] + k < len(text))]
        going = going[item[i[going] + k] == text[j[going] + k]]
        k += 1
        size[going] = k
    return i, j, size


def tiles(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in text, words) of tiles that overlap in neither, longest first, then first in item and text."""
    shortest = min(shortest, len(item))
    i, j, size = _matches(item, text, shortest)
    order = np.lexsort((j, i, -size))
    used, taken, out, heap, lo = np.zeros(len(item), bool), np.zeros(len(text), bool), [], [], 0
    while True:
        if lo < len(order) and not heap:
            # runs that the marked words of the item leave too little of are passed over together
            upto = np.concatenate(([0], np.cumsum(~used)))
            part = order[lo : lo + AT_ONCE]
            left = np.flatnonzero(upto[i[part] + size[part]] - upto[i[part]] >= shortest)
            lo += int(left[0]) if len(left) else len(part)
        if lo >= len(order) and not heap:
            return out
        run = (-int(size[order[lo]]), int(i[order[lo]]), int(j[order[lo]])) if lo < len(order) else None
        if run and (not heap or run <= heap[0]):
            lo += 1
        else:
            run = heapq.heappop(heap)
        m, a, b = -run[0], run[1], run[2]
        free = ~(used[a : a + m] | taken[b : b + m])
        if free.all():
            used[a : a + m] = taken[b : b + m] = True
            out.append((a, b, m))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= shortest:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))


class Benchmark:
    """Items as word numbers, their seeds, and a table of the first bits of their words' hashes.

    A tile of m words holds m - 2 seeds of SHORTEST = 3 words, at least a third of m, so an item that is
    covered has a third of COVER of its words as seeds in the text; items of fewer words are one seed.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        self.numbers: dict[bytes, int] = {}
        self.items = [(i, np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(t)], np.int64)) for i, t in items]
        self.table = np.zeros(1 << TABLE, bool)
        self.least = np.array([max(1, -(-int(np.ceil(COVER * len(x))) // SHORTEST)) if len(x) >= SHORTEST else 1 for _, x in self.items], np.int64)
        found: dict[int, list] = {}
        for at, (_, text) in enumerate(items):
            hashes = word_hashes(plain(text))
            if len(hashes):
                self.table[hashes >> np.uint64(64 - TABLE)] = True
                runs, times = np.unique(rolling(hashes, min(SHORTEST, len(hashes))), return_counts=True)
                found.setdefault(min(SHORTEST, len(hashes)), []).append((runs, np.full(len(runs), at), times))
        self.seeds = {}
        for k, parts in found.items():
            runs, owner, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(runs, kind="stable")
            keys, first = np.unique(runs[order], return_index=True)
            self.seeds[k] = keys, np.append(first, len(order)), owner[order], times[order]

    def near(self, raw: bytes) -> list[int]:
        """The items that share enough seeds with a plain() text."""
        hashes, found = word_hashes(raw), []
        known = self.table[hashes >> np.uint64(64 - TABLE)]
        for k, (keys, ends, owner, times) in self.seeds.items():
            full = known[: max(0, len(known) - k + 1)].copy()
            for j in range(1, k):
                full &= known[j : j + len(full)]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            runs = rolling_at(hashes, at, k)
            place = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            hit = np.unique(place[keys[place] == runs])
            n = ends[hit + 1] - ends[hit]
            rows = np.repeat(ends[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            who, which = np.unique(owner[rows], return_inverse=True)
            found += who[np.bincount(which, times[rows], len(who)) >= self.least[who]].tolist()
        return sorted(found)

    def _numbered(self, raw: bytes) -> Iterator[np.ndarray]:
        """The numbers of a plain() text's words, 0 for those of no item, a stretch at a time."""
        lo = 0
        while lo < len(raw):
            hi = raw.find(b" ", lo + AT_ONCE)
            words = raw[lo : hi if hi >= 0 else len(raw)].split()
            yield np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
            lo = hi if hi >= 0 else len(raw)

    def hits(self, text: str | None) -> list[dict]:
        """item_id and coverage of the items that a text holds, by item_id."""
        raw = plain(text)
        near = self.near(raw)
        if not near:
            return []
        numbers, out = np.concatenate([*self._numbered(raw)]), []
        for at in near:
            item_id, item = self.items[at]
            share = sum(m for _, _, m in tiles(item, numbers, SHORTEST)) / len(item)
            if share >= COVER:
                out.append({"item_id": item_id, "coverage": share})
        return sorted(out, key=lambda x: (x["item_id"] is not None, x["item_id"] or 0))


@functools.lru_cache(maxsize=1)
def _built(held) -> Benchmark:
    """The benchmark of a broadcast, made once in each worker; of one block at a time."""
    return Benchmark(held.value)


class _Held:
    """A broadcast that tasks of one worker recognise."""

    def __init__(self, broadcast):
        self.broadcast, self.name = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items with a block each, dealt out row by row so that equal rows are spread, and how many blocks there are.

    Blocks are more until none has more than twice BLOCK words, or one item.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x20!-/:-@\[-`{-~]+")), F.lit(0))
    items = stage(benchmark.select(F.col("item_id").cast("long"), "text", words.alias("words"), F.monotonically_increasing_id().alias("row")), "items")
    order = F.pmod(F.xxhash64("row"), F.lit(1 << 40))
    blocks = (items.agg(F.sum("words")).first()[0] or 0) // BLOCK + 1
    while blocks > 1:
        each = items.groupBy(F.pmod(order, F.lit(blocks)).alias("block")).agg(F.sum("words").alias("words"), F.count("*").alias("n"))
        if each.where((F.col("words") > 2 * BLOCK) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    return items.withColumn("block", F.pmod(order, F.lit(blocks))), blocks


def tiled(docs: DataFrame, benchmark: DataFrame, kept: list[str], hits: str) -> DataFrame:
    """docs (text, ...) and benchmark (item_id, text) -> the kept columns and hits, an array of (item_id, coverage).

    The benchmark goes to the executors in blocks of about BLOCK words. Of several blocks each is a
    pass over the documents that writes what it hits, so one block is held at a time. Null and empty
    texts and items match nothing; items of fewer than SHORTEST words match as a whole; an item that is
    there twice is found twice; repeated documents stay; long texts are compared whole; without
    documents or items there are no hits.
    """
    spark = small_batches(docs).sparkSession
    items, blocks = _blocks(benchmark)
    cells = "array<struct<item_id:long,coverage:double>>"

    def against(df: DataFrame, block: int, names: list[str], only: bool) -> DataFrame:
        part = items.where(F.col("block") == block) if blocks > 1 else items
        held = _Held(spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.select("item_id", "text").collect()]))
        schema = df.select(*names, F.lit(None).cast(cells).alias(hits)).schema
        kinds = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = _built(held)
            for b in batches:
                now = pa.array([bench.hits(t) for t in b.column("text").to_pylist()], kinds.field(hits).type)
                found = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), now], schema=pa.schema([*(b.schema.field(c) for c in names), (hits, now.type)]))
                yield found.filter(pc.greater(pc.list_value_length(now), 0)) if only else found

        return df.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)

    if blocks == 1:
        return against(docs, 0, kept, False)
    row = fresh("row", [*docs.columns, hits])
    rows = stage(docs.select(*dict.fromkeys([*kept, "text"])).withColumn(row, F.monotonically_increasing_id()), "docs")
    found = reduce(DataFrame.union, [stage(against(rows, k, [row], True), "hits") for k in range(blocks)])
    found = found.groupBy(row).agg(F.flatten(F.collect_list(hits)).alias(hits))
    order = F.array_sort(hits, lambda x, y: F.when(x.item_id.eqNullSafe(y.item_id), 0).when(x.item_id.isNull(), -1).when(y.item_id.isNull(), 1).when(x.item_id < y.item_id, -1).otherwise(1))
    out = rows.join(found, row, "left").withColumn(hits, F.coalesce(order, F.array().cast(cells)))
    return out.select(*kept, hits)


@tidy
def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that hold no benchmark item; other rules as in tiled()."""
    hits = fresh("hits", docs.columns)
    return tiled(docs, benchmark, docs.columns, hits).where(F.size(hits) == 0).drop(hits)


@tidy
def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, coverage (the largest): one row for each document."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = tiled(docs.select("doc_id", "text"), benchmark, ["doc_id"], "hits")
    most = F.coalesce(F.array_max("hits.coverage"), F.lit(0.0))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"), most.alias("coverage"))
