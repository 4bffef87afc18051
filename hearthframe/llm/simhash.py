"""Near-duplicate documents by SimHash fingerprints and a binary trie self-join.

Fingerprints are leaves of a binary trie. The self-join walks pairs of trie nodes of equal depth,
adds up the bits in which their prefixes differ, and drops a pair of nodes once the sum is over the
budget. The upper levels are walked in Spark: rows meet under the key of their node pair, and pairs
with too many rows go some levels deeper. Below, each node pair is walked to its leaves in numpy.

Exact copies share one fingerprint and are one leaf, however many they are. Leaves within the budget
of each other are at most 2,080 for 2 bits of 64, so dense groups stay linear; each walk hands on a
spanning star of the links it found instead of the pairs.

one_of_similar asks for a Jaccard similarity of word runs instead. Fingerprints of such texts can be 17
bits and more apart, which no bounded budget covers, so the trie's links and stars around shared rare
runs come first, and what they left apart meets under the rare runs that similar texts must share. Pairs
that bitmaps of the runs don't rule out are confirmed by the runs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthframe.llm.common import BATCH_ROWS, small_batches, table
from hearthframe.llm.components import components
from hearthframe.llm.decontam import rolling, rolling_at, word_hashes
from hearthframe.operators.joins import join_hot, small_side
from hearthframe.staging import drop_stage, stage, tidy

BITS = 64
SEED = 42
#: Leaves under one trie node, about, where the numpy walk takes over.
LEAVES = 16_384
#: Levels that an overfull node pair goes deeper at once.
DEEPER = 4
#: Node pairs in numpy's frontier at once.
FRONTIER = 1 << 18
#: Node pairs with so few leaf pairs are finished by comparing these.
FINISH = 24
#: One of so many distinct texts tells which word runs are common, whatever the corpus' size, and most runs kept; they order runs and exclude none.
SHARE, COMMON = 8, 1_000_000
#: Rounds of stars after the first.
STARS = 1
#: Bits of the places in the bitmap of texts that may be in a pair.
SLOTS = 25


def simhash(text: bytes | None, words: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer; 0 if it has no word."""
    return _folded(shingles(text, words))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of the runs of so many words of one text; a shorter text is one run."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    runs = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(found) - words + 1)


def _folded(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = np.unpackbits(hashes[at : at + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, BITS)
        for k in range(0, len(part), 255):
            counts += part[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, raw, fp), one row for each row: a hash of the text, and the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(x.as_py(), words) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "raw", "fp"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, raw long, fp long")


def _masks(width: int, budget: int) -> list[int]:
    """All numbers of so many bits with at most budget of them set."""
    return [sum(1 << k for k in c) for n in range(min(width, budget) + 1) for c in combinations(range(width), n)]


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the classes of u[i] and v[i]; parent always points at each class's root."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def walk(a: np.ndarray, b: np.ndarray | None, budget: int, depth: int, diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the leaves of two trie nodes that differ in at most budget bits.

    a, b: sorted distinct uint64 leaves below two nodes at this depth, whose prefixes differ in diff
    bits; b None walks a against itself, each pair once.
    """
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    stack = [(depth, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b))), np.array([diff], np.int8))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        done = (ah - al) * (bh - bl) <= FINISH if d < BITS else np.ones(len(al), bool)
        if done.any():
            na, nb = (ah - al)[done], (bh - bl)[done]
            each = na * nb
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            wide = np.repeat(nb, each)
            i, j = np.repeat(al[done], each) + at // wide, np.repeat(bl[done], each) + at % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, err = (x[~done] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        high, bit = np.uint64(((1 << d) - 1) << (BITS - d)), np.uint64(1 << (BITS - 1 - d))
        am, bm = np.searchsorted(a, (a[al] & high) | bit), np.searchsorted(b, (b[bl] & high) | bit)
        own = (al == bl) & same
        kids = []
        for x0, x1, y0, y1, more in ((al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1)):
            ok = (x0 < x1) & (y0 < y1) & (err + more <= budget)
            if more and x0 is am:
                ok &= ~own  # the mirror image of the pair before
            kids.append([x[ok] for x in (x0, x1, y0, y1, err + np.int8(more))])
        joined = [np.concatenate(x) for x in zip(*kids, strict=True)]
        for k in range(0, len(joined[0]), FRONTIER):
            stack.append((d + 1, *(x[k : k + FRONTIER] for x in joined)))


def links(leaves: DataFrame, budget: int = 2) -> DataFrame:
    """leaves (fp) distinct -> (u, v): links that connect all fingerprints within budget bits of each other."""
    n = leaves.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / LEAVES)))
    own = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(depth, budget)))
    rows = leaves.select("fp", own.alias("own"), F.explode(masks).alias("mask"))
    rows = rows.select("fp", "own", F.col("own").bitwiseXOR(F.col("mask")).alias("other"), F.bit_count("mask").alias("diff"))
    ready = []
    while True:
        rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
        if depth + DEEPER >= BITS - 1:
            break
        met = rows.groupBy("lo", "hi").agg(F.count("*").alias("n"))
        over = stage(met.where(F.col("n") > 8 * LEAVES).select("lo", "hi"), "over")
        if over.isEmpty():
            break
        ready.append((depth, rows.join(over, ["lo", "hi"], "left_anti")))
        deep = rows.join(over, ["lo", "hi"], "left_semi")
        depth += DEEPER
        step = F.explode(F.array(*(F.lit(m).cast("long") for m in _masks(DEEPER, budget)))).alias("mask")
        deep = deep.select("fp", "other", "diff", F.shiftrightunsigned("fp", BITS - depth).alias("own"), step)
        deep = deep.where(F.col("diff") + F.bit_count("mask") <= budget)
        bits = F.col("own").bitwiseAND(F.lit((1 << DEEPER) - 1)).bitwiseXOR(F.col("mask"))
        rows = deep.select("fp", "own", F.shiftleft("other", DEEPER).bitwiseOR(bits).alias("other"), (F.col("diff") + F.bit_count("mask")).alias("diff"))
    ready.append((depth, rows))

    def local(level: int):
        def run(key, group):
            fp = group["fp"].to_numpy().view(np.uint64)
            diff = int(group["diff"].iloc[0])
            if key[0] == key[1]:
                leaves, parts = np.sort(fp), None
                found = walk(leaves, None, budget, level, diff)
            else:
                low = (group["own"] == group["lo"]).to_numpy()
                parts = np.sort(fp[low]), np.sort(fp[~low])
                leaves = np.concatenate(parts)
                found = walk(*parts, budget, level, diff)
            parent = np.arange(len(leaves))
            for i, j in found:
                _joined(parent, i, j if parts is None else j + len(parts[0]))
            out = np.flatnonzero(parent != np.arange(len(leaves)))
            return pd.DataFrame({"u": leaves[out].view(np.int64), "v": leaves[parent[out]].view(np.int64)})

        return run

    found = [r.groupBy("lo", "hi").applyInPandas(local(level), "u long, v long") for level, r in ready]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _classes(rows: DataFrame, budget: int) -> DataFrame:
    """rows (doc_id, raw, fp) -> (fp, n, root, least), one row for each fingerprint: its rows, its component's name, and
    the component's first row as a struct of none (no doc_id), doc_id and raw."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    leaves = stage(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(order).alias("first")), "leaves")
    linked = components(stage(links(leaves.select("fp"), budget), "links"))
    leaves = leaves.join(linked, leaves.fp == linked.node, "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("root"))
    leaves = stage(leaves, "leaves")
    least = leaves.groupBy("root").agg(F.min("first").alias("least"))
    return leaves.join(least, "root").select("fp", "n", "root", "least")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint, component_id), one row for each row.

    Texts whose fingerprints differ in at most budget bits are linked; component_id is the smallest
    doc_id that links reach. Null and empty texts have fingerprint 0 and are linked like any other; a
    null doc_id gets its component but names none; repeated rows stay; long texts are read whole; an
    empty table gives an empty one. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, words), "fingerprints")
    leaves = stage(_classes(rows, budget).select("fp", "n", F.col("least.doc_id").alias("component_id")), "leaves")
    found = join_hot(rows.select("doc_id", "fp"), leaves, "fp", "n")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@tidy
def one_of_each(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """One row of docs for each group of texts that links connect: the first by doc_id, null last, then by a hash of the text.

    Of rows alike in doc_id and text one stays.
    """
    rows = stage(fingerprints(docs, words), "fingerprints")
    first = _classes(rows, budget).select("least.*").distinct()
    keep = small_side(first.select(F.col("doc_id").alias("_keep"), F.col("raw").alias("_raw")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")) & (F.xxhash64("text") == F.col("_raw"))
    kept = docs.join(keep, same, "left_semi")
    repeated = rows.groupBy("doc_id", "raw").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_COLUMNS = "doc_id long, raw long, key long, fp long, n long, bits binary, rare array<long>"


def runs_of(raw: bytes | None, words: int) -> np.ndarray:
    """64-bit hashes of the runs of so many words, lower-case A-Z, of one text; a shorter text is one run."""
    hashes = word_hashes(raw.translate(_LOWER)) if raw else np.zeros(0, np.uint64)
    runs = rolling_at(hashes, np.zeros(1, np.int64), len(hashes)) if 0 < len(hashes) < words else rolling(hashes, words)
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return runs ^ (runs >> np.uint64(32))


def _key(own: np.ndarray) -> int:
    """A hash of a set of word runs; 0 if it is empty."""
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], np.uint64).view(np.int64)[0]) if len(own) else 0


def _bits(own: np.ndarray) -> bytes:
    """A bitmap of a set of runs, of the least power of two of bits that is twice their number."""
    size = max(64, 1 << (2 * len(own) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[(own & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _least_shared(n: int, m: int, similarity: float) -> int:
    """Runs that sets of n and m runs share if their Jaccard similarity is so much."""
    return math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def _may_be_similar(n: int, a: bytes, m: int, b: bytes, similarity: float) -> bool:
    """False only if the bitmaps show that too few runs are shared: a run whose bit the other lacks is not in the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    least = _least_shared(n, m, similarity)
    return n - int(np.bitwise_count(x & ~y).sum()) >= least and m - int(np.bitwise_count(y & ~x).sum()) >= least


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word runs that several of each SHARE distinct texts hold, in order, and how many hold each. They only order runs.

    If they are more than COMMON, those that the most texts hold are kept, all of the same number or none.
    """
    texts = docs.select(F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                found = np.unique(runs_of(x.as_py(), words))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).distinct()
    met = stage(sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "common")
    least, held = 2, 0
    for r in met.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect():
        held += r["count"]
        if held > COMMON:
            least = r.n + 1
            break
    top = met.where(F.col("n") >= least).toArrow()
    drop_stage(met)
    runs, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(runs)
    return runs[by], n[by]


def _marked(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """docs (doc_id, text) -> a row for each row: hashes of the text and of its set of runs, its fingerprint, and the
    set's size, bitmap and rarest runs.

    Of the runs in any one order, two sets of this similarity share one of the first
    n - ceil(similarity * n) + 1 of each.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common(small_batches(docs), words))

    def one(raw: bytes | None) -> tuple[int, int, int, bytes, np.ndarray]:
        runs, n = common.value
        hashes = runs_of(raw, words)
        own = np.unique(hashes)
        if not len(own):
            return 0, 0, 0, b"", own.view(np.int64)
        often = np.zeros(len(own), np.int64)
        if len(runs):
            at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            often = np.where(runs[at] == own, n[at], 0)
        first = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
        rare = own[np.argsort(often, kind="stable")[:first]]
        return _key(own), int(np.array([_folded(hashes)], np.uint64).view(np.int64)[0]), len(own), _bits(own), rare.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            for lo in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(lo, BATCH_ROWS)
                more = [pa.array(list(x), k) for x, k in zip(zip(*(one(x.as_py()) for x in part.column(2)), strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *more], [x.split()[0] for x in _COLUMNS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _COLUMNS)


def _possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of keys that neither the sizes nor the bitmaps of sets (key, n, bits) rule out."""
    x = sets.select(F.col("key").alias("u"), F.col("n").alias("un"), F.col("bits").alias("ub"))
    y = sets.select(F.col("key").alias("v"), F.col("n").alias("vn"), F.col("bits").alias("vb"))
    both = pairs.join(x, "u").join(y, "v").where(F.least("un", "vn") >= similarity * F.greatest("un", "vn") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("un", "ub", "vn", "vb")), strict=True)
            yield b.select(["u", "v"]).filter(pa.array([_may_be_similar(*r, similarity) for r in rows], pa.bool_()))

    return both.select("u", "v", "un", "ub", "vn", "vb").mapInArrow(run, "u long, v long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """hashes (at) -> a bitmap of 2^SLOTS bits of their low bits, made slice by slice on the executors."""
    wide = SLOTS - 5
    at = hashes.select(F.col("at").bitwiseAND(F.lit((1 << SLOTS) - 1)).alias("at")).distinct().withColumn("slice", F.shiftright("at", wide))

    def fill(key, group):
        own = np.zeros(1 << wide, np.uint8)
        own[group["at"].to_numpy() & ((1 << wide) - 1)] = 1
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(1 << SLOTS - 3, np.uint8)
    for r in at.groupBy("slice").applyInPandas(fill, "slice long, bits binary").collect():
        lo = r.slice << wide - 3
        out[lo : lo + (1 << wide - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def _packed(own: np.ndarray) -> bytes:
    """A sorted set of runs, 40 bits of each."""
    low = (own >> np.uint64(24)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of keys whose texts have sets of word runs of this similarity.

    Only the sets of texts in pairs are shuffled, by 40 bits of each run; a bitmap of a fixed size says
    which texts these may be.
    """
    pairs = stage(_possible(pairs, sets, similarity), "possible")
    nodes = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    bitmap = _bitmap(sets.join(nodes, "key", "left_semi").select(F.col("raw").alias("at")))
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, owns = set(), [], []

        def row() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(owns, pa.binary())], ["key", "own"])
            keys.clear(), owns.clear()
            return out

        for b in batches:
            slot = b.column(0).to_numpy() & ((1 << SLOTS) - 1)
            for k in np.flatnonzero(held.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).tolist():
                raw = b.column(0)[k].as_py()
                if raw in seen:
                    continue
                seen.add(raw)
                own = np.unique(runs_of(b.column(1)[k].as_py(), words))
                keys.append(_key(own))
                owns.append(_packed(own))
                if len(keys) == 64:
                    yield row()
        yield row()

    found = docs.select(F.xxhash64("text").alias("raw"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, own binary")
    owns = found.groupBy("key").agg(F.first("own").alias("own"))
    both = pairs.join(owns.select(F.col("key").alias("u"), F.col("own").alias("a")), "u")
    both = both.join(owns.select(F.col("key").alias("v"), F.col("own").alias("b")), "v")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = _unpacked(x), _unpacked(y)
                ok.append(len(np.intersect1d(x, y, assume_unique=True)) >= _least_shared(len(x), len(y), similarity))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    out = stage(both.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long"), "links")
    drop_stage(pairs)
    return out


def similar(docs: DataFrame, marked: DataFrame, words: int, similarity: float) -> DataFrame:
    """docs (text) and marked, of _marked -> (node, component): keys that links of this similarity connect."""
    some = marked.where("n > 0")
    sets = stage(some.groupBy("key").agg(F.min("raw").alias("raw"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits")), "sets")

    def pairs(found: DataFrame) -> DataFrame:
        return found.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()

    leaves = stage(sets.groupBy("fp").agg(F.min("key").alias("least")), "leaves")
    u, v = leaves.select(F.col("fp").alias("u"), F.col("least").alias("x")), leaves.select(F.col("fp").alias("v"), F.col("least").alias("y"))
    trie = links(leaves.select("fp")).join(u, "u").join(v, "v").select("x", "y")
    trie = trie.union(sets.select("fp", F.col("key").alias("x")).join(leaves, "fp").select("x", F.col("least").alias("y")))
    # runs that different sets hold
    rows = some.select("key", "n", F.posexplode("rare").alias("pos", "shingle"))
    met = rows.groupBy("shingle").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("times"))
    met = stage(met.where("least < most").select("shingle", "times"), "met")
    hits = join_hot(rows, met, "shingle", "times").select("key", "n", "pos", "shingle").distinct()
    # a text that others were made from shares its rarest runs, and they hold rare ones of their own: it comes first
    hits = stage(hits, "hits")
    alone = hits.groupBy("key").agg((F.max("pos") + 1 - F.count("*")).alias("alone"))
    # runs that the very same sets hold, as those of one passage, are one: the first of them, so pairs don't meet under each
    names = hits.groupBy("shingle").agg(F.count("*").alias("times"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    names = stage(names.select("shingle", "times", F.xxhash64("times", "a", "b").alias("same")), "names")
    once = join_hot(hits, names, "shingle", "times").groupBy("same", "key", "n").agg(F.min("pos").alias("pos"))
    ranked = once.withColumnRenamed("same", "shingle").join(alone, "key").withColumn("alone", F.floor(1_000 * F.col("alone") / F.col("n")))
    ranked = stage(ranked.select("key", "shingle", "n", "pos", "alone"), "ranked")
    drop_stage(hits)
    drop_stage(names)

    def first_shared(x: str, y: str) -> Column:
        """Whether two sets of these sizes can be similar if the run at these places is the first that they share."""
        xn, xp, yn, yp = (F.col(f"{k}.{c}") for k in (x, y) for c in ("n", "pos"))
        share = F.lit(similarity / (1 + similarity)) * (xn + yn) - 1e-9
        return (F.least(xn - xp, yn - yp) >= share) & (F.least(xn, yn) >= similarity * F.greatest(xn, yn) - 1e-9)

    def stars(of: DataFrame) -> DataFrame:
        """Pairs of each set (shingle, key, n, pos, alone, at) with the first one of another component under its runs."""
        cell = F.struct("alone", "key", "n", "pos", "at")
        lead = of.groupBy("shingle").agg(F.min(cell).alias("lead"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("times"))
        lead = stage(lead.where("lo < hi").select("shingle", "lead", "times"), "leads")
        both = join_hot(of.select("shingle", cell.alias("x")), lead, "shingle", "times").where((F.col("x.at") != F.col("lead.at")) & first_shared("x", "lead"))
        return pairs(both.select(F.col("x.key").alias("x"), F.col("lead.key").alias("y")))

    def placed(of: DataFrame, sure: DataFrame) -> DataFrame:
        """of with the component of each set, only the runs under which several components meet."""
        joined = stage(components(sure), "components")
        found = of.drop("at").join(joined, F.col("key") == joined.node, "left").withColumn("at", F.coalesce("component", "key")).drop("node", "component")
        found = stage(found, "found")
        apart = found.groupBy("shingle").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("times"))
        apart = stage(apart.where("lo < hi").select("shingle", "times"), "shingles")
        out = stage(join_hot(found, apart, "shingle", "times").select(found.columns), "apart")
        for used in (joined, found, apart):
            drop_stage(used)
        return out

    tried = stage(pairs(trie).union(stars(ranked.withColumn("at", F.col("key")))).distinct(), "pairs")
    sure = _confirmed(tried, sets, docs, words, similarity)
    left = placed(ranked, sure)
    drop_stage(ranked)
    for _ in range(STARS):
        more = stage(stars(left).join(tried, ["u", "v"], "left_anti"), "pairs")
        if more.isEmpty():
            break
        sure, tried = sure.union(_confirmed(more, sets, docs, words, similarity)), tried.union(more)
        later = placed(left, sure)
        drop_stage(left)
        left = later
    # what is left apart meets one by one, sets of like size only, where the run may be the first that they share
    cell = F.struct("key", "n", "pos", "at")
    size = F.floor(F.log("n") / math.log(1 / similarity) + 1e-9)
    x = left.select("shingle", size.alias("size"), cell.alias("x"))
    y = left.select("shingle", F.explode(F.sequence(size - 1, size + 1)).alias("size"), cell.alias("y"))
    across = x.join(y, ["shingle", "size"]).where((F.col("x.at") < F.col("y.at")) & first_shared("x", "y"))
    across = stage(pairs(across.select(F.col("x.key").alias("x"), F.col("y.key").alias("y"))).join(tried, ["u", "v"], "left_anti"), "across")
    drop_stage(left)
    return components(sure.union(_confirmed(across, sets, docs, words, similarity)))


@tidy
def one_of_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of texts that links of this Jaccard similarity connect: the smallest doc_id's.

    Sets of runs of so many words are compared, of lower-case words as in simhash. Texts of equal sets are
    one group, null texts and those without a word another. A null doc_id comes after all others; rows
    that are alike in doc_id are ordered by the set's hash, and one of those that are alike in both stays.
    Long texts are compared whole; an empty table gives an empty one; all columns stay, whatever their names.
    """
    marked = stage(_marked(docs, words, similarity), "marked")
    joined = stage(similar(docs, marked, words, similarity), "components")
    rows = stage(marked.select("doc_id", "key").join(joined, F.col("key") == joined.node, "left").select("doc_id", "key", F.coalesce("component", "key").alias("at")), "rows")
    drop_stage(marked)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    least = stage(rows.groupBy("at").agg(F.min(order).alias("x")).select("x.doc_id", "x.key"), "least")
    # doc_ids that name one row tell which rows go; of the others the sets are looked at again
    named = rows.groupBy("doc_id").agg(F.count("*").alias("times"))
    unsure = small_side(named.where("times > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_unsure")))
    gone = rows.join(least, rows.doc_id.eqNullSafe(least.doc_id) & (rows.key == least.key), "left_anti")
    gone = small_side(gone.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct())
    at = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"))
    kept = at.join(unsure, F.col("_id").eqNullSafe(F.col("_unsure")), "left_anti").join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("row.*")
    if unsure.isEmpty():
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([_key(np.unique(runs_of(x.as_py(), words))) for x in b.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("_id"), keys], ["row", "_id", "_key"])

    row = T.StructField("row", T.StructType(docs.schema.fields))
    again = at.join(unsure, F.col("_id").eqNullSafe(F.col("_unsure")), "left_semi").withColumn("_text", F.col("row.text").cast("binary"))
    again = again.mapInArrow(run, T.StructType([row, T.StructField("_id", T.LongType()), T.StructField("_key", T.LongType())]))
    again = again.join(least, F.col("_id").eqNullSafe(least.doc_id) & (F.col("_key") == least.key), "left_semi").dropDuplicates(["_id", "_key"])
    return kept.union(again.select("row.*"))


@tidy
def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
