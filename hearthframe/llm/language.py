"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of 1 to 3 letters inside words, padded by one
space on either side, by falling count. A document gets the language whose profile is nearest to its
own by the out-of-place distance: for each of the document's n-grams the difference of its ranks, or
the length of a profile if the language's lacks it. N-grams are named by 32-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthframe.llm.common import fresh, small_batches, table

#: Length of a profile.
RANKS = 300
#: Distinct texts of each language, chosen by a hash, that its profile is learned from, about.
TRAIN = 4_000
#: Characters, and documents, that are counted at once.
AT_ONCE, MANY = 1 << 18, 1_024
NONE = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    """A text, or if it is long its parts, cut at spaces."""
    lo = 0
    while len(text) - lo > AT_ONCE:
        cut = text.rfind(" ", lo + AT_ONCE // 2, lo + AT_ONCE)
        cut = lo + AT_ONCE if cut < 0 else cut
        yield text[lo:cut]
        lo = cut
    yield text[lo:] if lo else text


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or the sum of its counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums


def _count(parts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner << 32 | n-gram, count) of these parts of texts."""
    points = np.frombuffer("".join(f"\n{p}\n" for p in parts).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if points.size != sum(map(len, parts)) + 2 * len(parts):  # lower case can be longer
        lower = [f"\n{p}\n".lower() for p in parts]
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = [len(p) for p in lower]
    else:
        sizes = [len(p) + 2 for p in parts]
    own = np.repeat(owner, sizes).astype(np.uint64)
    letter = _letters()[points]
    before = np.concatenate(([False], letter[:-1]))
    start = np.zeros(len(points), bool)
    start[np.cumsum([0, *sizes[:-1]])] = True
    keep = letter | before | start
    points, own, letter, start = np.where(letter, points, 32)[keep].astype(np.uint64), own[keep] << np.uint64(32), letter[keep], start[keep]
    one = points[letter]
    two = points[:-1] << np.uint64(21) | points[1:]
    ok2 = (letter[:-1] | letter[1:]) & ~start[1:]
    three = points[:-2] << np.uint64(42) | two[1:]
    ok3 = letter[1:-1] & ~start[2:]
    codes = np.concatenate([one, two[ok2], three[ok3]])
    owners = np.concatenate([own[letter], own[:-1][ok2], own[:-2][ok3]])
    return _tally(owners | (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32))


def counted(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner << 32 | n-gram, count) of whole texts; owner numbers each text."""
    found, parts, owners, size = [], [], [], 0

    def close() -> None:
        if parts:
            found.append(_count(parts, np.array(owners)))
        parts.clear(), owners.clear()

    for text, who in zip(texts, owner, strict=True):
        for part in _pieces(text):
            if size + len(part) > AT_ONCE:
                close()
                size = 0
            parts.append(part)
            owners.append(who)
            size += len(part) + 1
    close()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    return _tally(keys, counts) if len(found) > 1 else (keys, counts)


def ranked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, rank, n-gram) of the RANKS most frequent n-grams of each of at most MANY texts; ties by hash."""
    keys, counts = counted(texts, np.arange(len(texts)))
    own = (keys >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((-counts, own))  # stable: keys of a text are in n-gram order
    own = own[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    top = rank < RANKS
    return own[top], rank[top], (keys[order] & np.uint64(0xFFFFFFFF))[top].astype(np.int64)


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of at most MANY texts, and of about four times AT_ONCE characters."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if len(part) == MANY or size >= 4 * AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


class Profiles:
    """The learned profiles, from rows (lang, gram, rank)."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank

    def guess(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for part in _slices(texts):
            own, rank, gram = ranked(part)
            n = np.bincount(own, minlength=len(part))
            at = np.searchsorted(self.grams, gram)
            at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != gram) if len(self.grams) else slice(None)] = len(self.grams)
            known = self.ranks[at]
            off = np.where(known < 0, RANKS, np.abs(known - rank[:, None]))
            far = np.stack([np.bincount(own, off[:, k], len(part)) for k in range(len(self.langs))], 1) if self.langs else np.zeros((len(part), 0))
            for k in range(len(part)):
                best = int(np.argmin(far[k])) if n[k] and self.langs else -1
                langs.append(self.langs[best] if best >= 0 else NONE)
                scores.append(1 - float(far[k, best]) / (RANKS * int(n[k])) if best >= 0 else 0.0)
        return langs, scores


def learn(labelled: DataFrame) -> Profiles:
    """Profiles from labelled (doc_id, text, lang), of about TRAIN distinct texts of each language, chosen by a hash of the text.

    Copies of a text are chosen or not together and count once, so neither they nor null or repeated
    doc_ids widen the sample. Null texts and languages teach nothing.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    n = {r.lang: r.n for r in counts.collect()}
    if not n:
        return Profiles([])
    each = F.element_at(F.create_map(*(F.lit(x) for pair in n.items() for x in pair)), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("text"), each) < TRAIN).dropDuplicates(["text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, code = b.column("lang").to_pylist(), {}
            owner = np.array([code.setdefault(x, len(code)) for x in lang])
            keys, counts = counted(b.column("text").to_pylist(), owner)
            names = pa.array(list(code)).take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([names, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    grams = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < RANKS)
    return Profiles([(r.lang, r.gram, r.rank) for r in top.select("lang", "gram", "rank").collect()])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    """Whether a text holds a letter; not so if it is null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs -> with lang_pred and score (or what pred and score call them), from the whole text alone.

    score is 1 less the mean distance of an n-gram against the largest possible. A null text, or one
    without a letter, gives und and 0, as do empty profiles; ties go to the first language by name.
    Texts of any length are counted whole, in parts, without a cap on counts; repeated rows stay and get
    the same; an empty table gives an empty one. Columns of these names in docs are replaced.
    """
    text = fresh("_text", small_batches(docs).columns)
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = model.value.guess(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # not deterministic for the planner, or a filter on the guess would make it guess twice
    guessed = F.arrow_udf(guess, "lang_pred string, score double").asNondeterministic()
    out = docs.select(*kept, guessed("text").alias(text))
    return out.select(*kept, F.col(f"{text}.lang_pred").alias(pred), F.col(f"{text}.score").alias(score))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).drop("text")
