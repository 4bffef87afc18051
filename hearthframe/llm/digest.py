"""Document fingerprints from statistically improbable features.

Every window of WINDOW bytes of a text has an entropy. How common each entropy (in STEPS steps) is among
all windows of the corpus gives its rank, the rarest first; very low and very high entropies carry
nothing and have no rank. Among every run of RUN neighbouring windows the one of least rank, leftmost if
several, wins; windows with at least WINS wins are the text's features. Features go in order into a chain
of Bloom filters, FULL to a filter. Two filters are compared by the overlap of their bits between what
chance gives and what is possible; two fingerprints by the mean, over the filters of the shorter, of the
best filter of the longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.llm.common import small_batches, table

WINDOW, STEPS, RUN, WINS = 64, 1_000, 64, 16
#: Steps of entropy outside of which a window is no feature.
LOW, HIGH = 100, 990
#: Bits and features of a filter, and bits set for a feature.
BITS, FULL, EACH = 2_048, 160, 5
#: Bytes that are scanned, and filters that are compared with all others of a text, at once.
AT_ONCE, AT_A_TIME = 1 << 17, 64
#: Bits for a place among so many windows and a run.
PLACE = 18
#: Bytes of documents in one range of doc_ids, about, and ranges at most: beyond, ranges grow, which are streamed.
RANGE_BYTES, RANGES = 32 << 20, 20_000
_SCALE = 1 << 20
#: c * log2(c) for the counts of a byte in a window, in whole numbers so that running sums stay exact.
_CLOGC = np.array([0, *(round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1))], np.int64)
_GAIN = np.diff(_CLOGC).astype(np.int32)
_MIX = np.random.default_rng(7).integers(1, 2**63, (EACH, WINDOW // 8), dtype=np.uint64) | np.uint64(1)


def _repeats(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the WINDOW - 1 bytes before each byte, and of those after it, equal it."""
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    same = np.empty(len(data), bool)
    for k in range(1, min(WINDOW, len(data))):
        found = np.equal(data[k:], data[:-k], out=same[k:]).view(np.uint8)
        before[k:] += found
        after[:-k] += found
    return before, after


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy, in STEPS steps, of each window of these bytes."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    counts = np.bincount(data[:WINDOW], minlength=256)
    total = np.empty(n, np.int64)
    total[0] = _CLOGC[counts].sum()
    if n > 1:
        before, after = _repeats(data)
        # the window moves from k to k+1: byte k leaves (it has after[k] equals left), byte k+WINDOW comes in; its
        # equals among the WINDOW-1 bytes between are before[k+WINDOW]
        moved = _GAIN[before[WINDOW:]] - _GAIN[after[: n - 1]]
        np.cumsum(moved, out=total[1:])
        total[1:] += total[0]
    return np.clip(STEPS - total * (STEPS / (WINDOW * np.log2(WINDOW) * _SCALE)), 0, STEPS - 1).astype(np.int16)


def _stretches(size: int, step: int, over: int) -> Iterator[tuple[int, int]]:
    """Ranges of so many bytes that overlap by over, to the end."""
    lo = 0
    while True:
        hi = min(size, lo + step + over)
        yield lo, hi
        if hi == size:
            return
        lo += step


def entropies_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """entropies() of each whole text; texts are scanned together, long ones in overlapping stretches."""
    group, size = [], 0
    for t in [*texts, None]:
        if group and (t is None or size + len(t) > AT_ONCE):
            found = entropies(np.frombuffer(b"".join(group), np.uint8)) if size <= AT_ONCE else _long(group[0])
            lo = 0
            for g in group:
                yield found[lo : lo + max(0, len(g) - WINDOW + 1)]
                lo += len(g)
            group, size = [], 0
        if t is not None:
            group.append(t)
            size += len(t)


def _long(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return np.concatenate([entropies(data[lo : hi + WINDOW - 1]) for lo, hi in _stretches(len(data) - WINDOW + 1, AT_ONCE, 0)])


def histogram(texts: list[bytes]) -> np.ndarray:
    """Windows of each entropy, of whole texts."""
    return sum((np.bincount(x, minlength=STEPS) for x in _joined(entropies_of(texts))), np.zeros(STEPS, np.int64))


def _joined(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same numbers in larger arrays."""
    held, size = [], 0
    for x in parts:
        held.append(x)
        size += len(x)
        if size >= AT_ONCE:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy, the rarest first; STEPS for those without one."""
    order = np.lexsort((np.arange(STEPS), counts))
    out = np.empty(STEPS, np.int64)
    out[order] = np.arange(STEPS)
    out[:LOW] = out[HIGH:] = STEPS
    return out


def _sets(windows: np.ndarray) -> np.ndarray:
    """The bits that each feature sets."""
    words = np.ascontiguousarray(windows).view("<u8")
    out = np.empty((len(words), EACH), np.int64)
    for k in range(EACH):
        h = (words * _MIX[k]).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(32)
        out[:, k] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)
    return out


class Filters:
    """A fingerprint: the chained filters, as rows of bits."""

    def __init__(self, rows: np.ndarray, text: bytes):
        self.rows = rows
        self.ones = rows.sum(axis=1).astype(np.int64)
        self.short = text if len(text) < WINDOW else None

    def __str__(self) -> str:
        if self.short is not None:
            return f"0:{hashlib.sha256(self.short).hexdigest()}"
        return f"{len(self.rows)}:{np.packbits(self.rows, axis=1).tobytes().hex()}"

    def likeness(self, other: Filters) -> float:
        """0 to 1. Texts shorter than a window are alike if equal; without features on both sides only if both have none."""
        if self.short is not None or other.short is not None:
            return float(self.short == other.short)
        a, b = (self, other) if len(self.rows) <= len(other.rows) else (other, self)
        if not len(a.rows):
            return float(not len(b.rows))
        other, best = b.rows.T.astype(np.float32), np.zeros(len(a.rows))
        for lo in range(0, len(a.rows), AT_A_TIME):
            ones = a.ones[lo : lo + AT_A_TIME, None]
            common = a.rows[lo : lo + AT_A_TIME].astype(np.float32) @ other
            most = np.minimum(ones, b.ones[None, :])
            chance = np.minimum(ones * b.ones[None, :] / BITS, most - 0.5)
            best[lo : lo + AT_A_TIME] = np.clip((common - chance) / (most - chance), 0, 1).max(axis=1)
        return float(best.mean())


def fingerprint(text: bytes, rank: np.ndarray) -> Filters:
    """The fingerprint of one whole text; it depends on the text and the ranks alone."""
    return fingerprint_all([text], rank)[0]


def fingerprint_all(texts: list[bytes], rank: np.ndarray) -> list[Filters]:
    shifted = (rank << PLACE).astype(np.int32)
    return [_fingerprint(t, e, shifted) for t, e in zip(texts, entropies_of(texts), strict=True)]


def _fingerprint(text: bytes, entropy: np.ndarray, shifted: np.ndarray) -> Filters:
    n = len(entropy)
    if n <= 0:
        return Filters(np.zeros((0, BITS), np.uint8), text)
    data, picked = np.frombuffer(text, np.uint8), []
    for lo, hi in _stretches(n, AT_ONCE, RUN - 1):
        key = shifted[entropy[lo:hi]] | np.arange(hi - lo, dtype=np.int32)
        run, width = key, 1
        while width < min(RUN, len(key)):
            step = min(width, RUN - width)
            run = np.minimum(run[: len(run) - step], run[step:]) if len(run) > step else run
            width += step
        picked.append((run[run < STEPS << PLACE] & ((1 << PLACE) - 1)).astype(np.int64) + lo)
    wins = np.bincount(np.concatenate(picked), minlength=n) if picked else np.zeros(n, np.int64)
    at = np.flatnonzero(wins >= min(WINS, max(1, n - RUN + 1)))
    rows = np.zeros((-(-len(at) // FULL), BITS), np.uint8)
    if len(at):
        windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]
        rows[np.repeat(np.arange(len(at)) // FULL, EACH), _sets(windows).ravel()] = 1
    return Filters(rows, text)


def learn_ranks(docs: DataFrame) -> np.ndarray:
    """Entropy ranks from every window of every text of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS, np.int64)
        for b in batches:
            total += histogram([x for x in b.column(0).to_pylist() if x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS)), pa.array(total)], ["step", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "step long, n long")
    counts = np.zeros(STEPS, np.int64)
    for r in rows.groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r.step] = r.n
    return ranks(counts)


def edited(text: str, following: str) -> str:
    """The text whose last floor(half) code points are replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (part, halo, doc_id, text), dealt and sorted so that in a partition each row of a part
    is followed by the next document by descending doc_id, the last row of a part by a halo row.

    Parts are ranges of doc_ids of about RANGE_BYTES, RANGES of them at most, so that what the driver knows of
    them (a bound and a first doc_id each) and the broadcast of it are bounded. The first document of each part goes to the part
    before it as well; that of the first part to the last part.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count("doc_id").alias("known")).first()
    parts = min(RANGES, (sizes.n or 0) // RANGE_BYTES + 1)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 and sizes.known else []
    held = docs.sparkSession.sparkContext.broadcast(np.array(sorted(set(cuts or [])), np.int64))

    def place(ids: pa.Array) -> pa.Array:
        """Ranges by descending doc_id, null last: the cuts that a doc_id doesn't exceed."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        at = np.searchsorted(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(np.where(known, len(held.value) - at, len(held.value)).astype(np.int32))

    part = F.arrow_udf(place, "int")("doc_id")
    docs = docs.withColumn("part", part)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("hash"))
    firsts = [(r.part, r.first) for r in docs.groupBy("part").agg(F.max(order).alias("first")).orderBy("part").collect()]
    if not firsts:
        return docs.select("part", F.lit(0).alias("halo"), "doc_id", "text")
    before = {part: firsts[k - 1][0] for k, (part, _) in enumerate(firsts)}
    heads = docs.sparkSession.createDataFrame([(p, before[p], f.doc_id, f.hash) for p, f in firsts], "part int, to int, id long, h long")
    same = (docs.part == heads.part) & docs.doc_id.eqNullSafe(heads.id) & (F.xxhash64(docs.text) == heads.h)
    marked = docs.join(F.broadcast(heads), same, "left").select(docs.part, "to", "doc_id", "text")
    copies = F.when(F.col("to").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("halo"))))
    copies = copies.otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("halo")), F.struct(F.col("to").alias("part"), F.lit(1).alias("halo"))))
    dealt = marked.select(F.explode(copies).alias("at"), "doc_id", "text").select("at.*", "doc_id", "text")
    dealt = dealt.repartitionByRange(len(firsts), "part")
    return dealt.sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def _parts(rows: list) -> Iterator[list]:
    """Rows (..., text) in runs of about eight times AT_ONCE characters."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r[2])
        if size >= 8 * AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the fingerprint of each text, of its edited text, and their likenesses; one row for each row.

    The edited text is edited() with the next document by descending doc_id (null last; rows of one
    doc_id by a hash of the text), the first after the last. A null text is empty. Texts shorter than
    WINDOW bytes have a hash for a fingerprint and are alike only if equal. An empty table gives an
    empty one. Other columns are ignored.
    """
    docs = small_batches(docs).select("doc_id", "text")
    rank = docs.sparkSession.sparkContext.broadcast(learn_ranks(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = rank.value, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            held = list(zip(*(b.column(k).to_pylist() for k in ("halo", "doc_id", "text")), strict=True))
            for part in _parts(held):
                own = [(*r, f) for r, f in zip(part, fingerprint_all([t.encode("utf-8") for _, _, t in part], of), strict=True)]
                pairs = [(r, after) for r, after in zip([last, *own], own, strict=False) if r and not r[0]]
                last = own[-1]
                changed = [edited(r[2], after[2]) for r, after in pairs]
                raw = [t.encode("utf-8") for t in changed]
                rows = []
                for (r, after), t, x in zip(pairs, raw, fingerprint_all(raw, of), strict=True):
                    _, doc_id, text, print_ = r
                    rows.append((doc_id, len(text), hashlib.sha256(t).hexdigest(), str(print_), str(x), print_.likeness(x), print_.likeness(after[3])))
                if rows:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(made, [x.split()[0] for x in _OUT.split(", ")])

    return neighbours(docs).mapInArrow(run, _OUT)


def op7(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
