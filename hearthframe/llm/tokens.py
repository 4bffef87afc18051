"""Token counts and token files with public tokenizers.

Tokenizers are loaded once in each Python worker. Byte-level BPE cuts a text into pretokens by one
left-to-right pattern that looks at most LOOKS characters past the place where it stands, and merges
only inside pretokens. Two facts follow, which the operators here rest on:

* Once two scans of the same text both begin a pretoken at one place, they agree from there on, up to
  LOOKS characters before the end of the shorter. So chunks can be spliced at any common beginning.
* A single space between two other characters begins a pretoken. So a text may be cut before such
  spaces, and the pieces encoded once for all texts that hold them.

Tokenizers of any other kind get whole texts.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hearthframe.llm.common import small_batches, table
from hearthframe.operators.joins import small_side
from hearthframe.staging import drop_stage, stage, stage_path, tidy

BYTE_BPE = "byte_bpe_50k.json"
#: Characters of a chunk of a huge text, and of the overlap of neighbouring chunks to begin with.
CHUNK, OVERLAP = 32_768, 1_024
#: More than the characters that the pattern looks at beyond a beginning ('ll is the longest).
LOOKS = 8
#: Characters that are encoded at once.
AT_ONCE = 1 << 18
#: Pretokens that a worker keeps, of about 40 bytes each and as much again while they are sorted.
KEPT = 1_000_000
#: Bytes of compressed tokens, and documents, of a segment of a token file.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 4_096
#: Documents at most, and characters of each, that a dictionary is trained on, and its bytes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY = 2_000, 4_096, 65_536
WHOLE = 2**31 - 1


@functools.lru_cache(maxsize=4)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def byte_level(name: str) -> bool:
    """Whether the facts above hold: byte-level BPE by the usual pattern, and nothing that changes the text first."""
    if name.endswith(".model"):
        return False
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        parts = json.load(f)
    first = parts["pre_tokenizer"] or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    return plain and not parts["normalizer"] and parts["model"]["type"] == "BPE"


def _batched(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE characters."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _whole(name: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a text as the library gives them, where its pretokens begin, and the ids before each."""
    e = tokenizer(name).encode(text, add_special_tokens=False)
    first = np.flatnonzero(np.diff(np.array(e.word_ids, np.int64), prepend=-1))
    return np.array(e.ids, np.uint32), np.array(e.offsets, np.int64).reshape(-1, 2)[first, 0], first


def beginnings(name: str, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Offsets at which pretokens of a text begin, the tokens before each, and all its tokens."""
    ids, begins, before = pieces(name).each([text])[0]
    if begins is None:
        ids, begins, before = _whole(name, text)
    return begins, before, len(ids)


# --- pieces ---------------------------------------------------------------------------------------

#: Characters other than those whose letters, digits and white space are the same to Python and to the tokenizer.
_ODD = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: A space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Stands between texts that are scanned together.
_BETWEEN = "\uffff"
_SPACE, _LETTER, _DIGIT, _OTHER, _NONE = range(5)


def _shown() -> dict[int, str]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The class of each regular character; two numbers for each; powers of an odd number, and of its inverse, modulo 2^64."""
    kind = np.full(0x10000, _NONE, np.uint8)
    for c in map(chr, range(0x250)):
        kind[ord(c)] = _SPACE if c in " \t\n\v\f\r" else _LETTER if c.isalpha() else _DIGIT if c in "0123456789" else _OTHER
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(2 * AT_ONCE + 1, x, np.uint64) for x in (base, pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return kind, np.random.default_rng(3).integers(1, 2**64, (2, 0x250), dtype=np.uint64), np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pretokens begin in these characters, texts being parted by _BETWEEN, which is its own beginning.

    A run of letters, of digits or of others takes one plain space before it; of white space before a run
    the last character stands alone unless it is such a space; an apostrophe that begins a pretoken takes
    the letters of a contraction.
    """
    new = np.empty(len(code), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == _NONE
    after = np.flatnonzero((kind[1:] != _SPACE) & (kind[1:] != _NONE) & (kind[:-1] == _SPACE)) + 1
    new[after - 1] = True
    new[after[code[after - 1] == 32]] = False
    quote = np.flatnonzero(code == 39)
    for p in quote[new[quote]].tolist():
        follows = code[p + 1 : p + 3].tobytes().decode("utf-16-le")
        n = 1 if follows[:1] in ("s", "t", "m", "d") else 2 if follows in ("re", "ve", "ll") else 0
        if n:
            new[p + 1] = False
            new[p + 1 + n] = True
    return np.flatnonzero(new)


class Pieces:
    """Encodes texts pretoken by pretoken and keeps the ids of each distinct one.

    Pretokens are found in many texts at once and named by two 64-bit hashes; new ones are given to the
    library's model. What is kept are sorted arrays, a large one and one of the latest, not objects; once
    there are KEPT pretokens, those that were met again since the last time stay and the others go.
    Texts with other characters than the Latin ones, or with a special token's string, are cut at spaces
    and their pieces given to the whole tokenizer.
    """

    def __init__(self, name: str):
        self.name, self.shown, self.odd = name, _shown(), {}
        self.plain = byte_level(name)
        self.model = tokenizer(name).model if self.plain else None
        self.special = [t.content for t in tokenizer(name).get_added_tokens_decoder().values()] if self.plain else []
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tiers, self.begin, self.flat, self.n, self.size = [none, none], np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0
        self.again = np.zeros(1 << 16, bool)

    def _forget_rare(self) -> None:
        """Keeps the pretokens that were met again since the last time; none if they are too many."""
        stay = np.flatnonzero(self.again[: self.n])
        if len(stay) > KEPT // 2:
            self._forget()
            return
        sizes = self.begin[stay + 1] - self.begin[stay]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.flat[np.repeat(self.begin[stay] - upto[:-1], sizes) + np.arange(upto[-1])]
        number = np.full(self.n, -1, np.int64)
        number[stay] = np.arange(len(stay))
        keys, checks, old = self._merged(*self.tiers)
        held = number[old] >= 0
        self._forget()
        self.tiers[0] = keys[held], checks[held], number[old[held]]
        self.n, self.size = len(stay), int(upto[-1])
        self.begin = np.concatenate((upto, np.zeros(1 << 16, np.int64)))
        self.flat = np.concatenate((flat, np.zeros(1 << 18, np.uint32)))
        self.again = np.zeros(len(self.begin), bool)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        return [x[0].tobytes() for x in self.each(texts)]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x[0]) for x in self.each(texts)]

    def each(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """For each text its ids, and if it is regular where its pretokens begin and the ids before each."""
        out: list = [None] * len(texts)
        regular = [k for k, t in enumerate(texts) if self.regular(t)]
        rest = sorted(set(range(len(texts))).difference(regular))
        parts, owner = [], []
        for k in regular:
            lo = 0
            for hi in self._cuts(texts[k]):
                parts.append(texts[k][lo:hi])
                owner.append((k, lo))
                lo = hi
        for lo, hi in _batched(parts):
            for (k, at), found in zip(owner[lo:hi], self._together(parts[lo:hi]), strict=True):
                if out[k] is not None:
                    ids, begins, before = out[k]
                    found = np.concatenate((ids, found[0])), np.concatenate((begins, found[1] + at)), np.concatenate((before, found[2] + len(ids)))
                out[k] = found
        for lo, hi in _batched([texts[k] for k in rest]):
            for k, x in zip(rest[lo:hi], self._cut([texts[k] for k in rest[lo:hi]]), strict=True):
                out[k] = np.frombuffer(x, "<u4"), None, None
        return out

    def regular(self, text: str) -> bool:
        return self.plain and not _ODD.search(text) and not any(s in text for s in self.special)

    @staticmethod
    def _cuts(text: str) -> Iterator[int]:
        """Ends of stretches of about AT_ONCE characters that end before a space between two other characters."""
        at = 0
        while len(text) - at > AT_ONCE:
            found = _CUT.search(text, at + AT_ONCE // 2)
            if not found:
                break
            at = found.start()
            yield at
        yield len(text)

    def _together(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        text = "".join(t + _BETWEEN for t in texts)
        if len(text) > 2 * AT_ONCE:  # no place to cut
            return [_whole(self.name, t) for t in texts]
        code = np.frombuffer(text.encode("utf-16-le"), "<u2")
        kinds, numbers, up, down = _tables()
        kind = kinds[code]
        begin = _starts(code, kind)
        end = np.append(begin[1:], len(code))
        real = kind[begin] != _NONE
        last = np.flatnonzero(~real)
        begin, end = begin[real], end[real]
        names, own = [], np.minimum(code, 0x24F)
        for k in (0, 1):
            sums = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(numbers[k][own] * up[: len(code)], out=sums[1:])
            h = (sums[end] - sums[begin]) * down[begin]
            names.append(h ^ (h >> np.uint64(31)))
        keys, first, which = np.unique(names[0], return_index=True, return_inverse=True)
        if (names[1][first][which] != names[1]).any():
            return [_whole(self.name, t) for t in texts]
        at = self._places(keys, names[1][first], [(int(b), int(e)) for b, e in zip(begin[first], end[first], strict=True)], text)[which]
        sizes = self.begin[at + 1] - self.begin[at]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.begin[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        edges = np.concatenate(([0], last - np.arange(len(last)))).tolist()
        out, lo = [], 0
        for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
            out.append((ids[upto[a] : upto[b]], begin[a:b] - lo, upto[a:b] - upto[a]))
            lo += len(t) + 1
        return out

    def _places(self, keys: np.ndarray, checks: np.ndarray, spans: list[tuple[int, int]], text: str) -> np.ndarray:
        """The numbers of kept pretokens by their names; new ones are learned."""
        if self.n > KEPT:
            self._forget_rare()
        out = np.full(len(keys), -1, np.int64)
        for known, check, number in self.tiers:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = (known[at] == keys) & (check[at] == checks)
                out[hit] = number[at[hit]]
        new = np.flatnonzero(out < 0)
        self.again[out[out >= 0]] = True
        if len(new):
            made = [self._run(text[b:e]) for b, e in (spans[k] for k in new.tolist())]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            n, size = self.n + len(made), self.size + int(sizes.sum())
            while n + 1 > len(self.begin):
                self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
                self.again = np.concatenate((self.again, np.zeros_like(self.again)))
            while size > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.size : size] = np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))
            self.begin[self.n + 1 : n + 1] = self.size + np.cumsum(sizes)
            out[new] = np.arange(self.n, n)
            self.n, self.size = n, size
            late = self._merged(self.tiers[1], (keys[new], checks[new], out[new]))
            self.tiers = [self._merged(self.tiers[0], late), tuple(x[:0] for x in late)] if 8 * len(late[0]) > len(self.tiers[0][0]) else [self.tiers[0], late]
        return out

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        joined = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        return tuple(x[order] for x in joined)

    def _run(self, pretoken: str) -> list[int]:
        if pretoken.isascii() and pretoken[:1] == " " and pretoken[1:].isalpha():
            shown = self.shown[32] + pretoken[1:]
        else:
            shown = pretoken.encode("utf-8").decode("latin-1").translate(self.shown)
        return [t.id for t in self.model.tokenize(shown)]

    def _cut(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return [self._ids([t])[0] for t in texts]
        cuts = [_CUT.split(t) for t in texts]
        firsts = self._ids([c[0] for c in cuts])
        if len(self.odd) > KEPT // 8:
            self.odd.clear()
        new = list({p for c in cuts for p in c[1:]} - self.odd.keys())
        for lo, hi in _batched(new):
            self.odd.update(zip(new[lo:hi], self._ids([" " + p for p in new[lo:hi]]), strict=True))
        return [first + b"".join([self.odd[p] for p in c[1:]]) for first, c in zip(firsts, cuts, strict=True)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        t = tokenizer(self.name)
        if self.name.endswith(".model"):
            return [np.array(t.encode(x, num_threads=1), "<u4").tobytes() for x in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


# --- counts ---------------------------------------------------------------------------------------


_CHUNKS = "row long, doc_id long, hash long, n_bytes long, last int, part int, n long, text string"


def _chunks(docs: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """docs (doc_id, text) -> _CHUNKS: one row with its tokens n for each text of one chunk; of others each chunk's text.

    Each text is cut in one pass.
    """
    step, names = chunk - overlap, [x.split()[0] for x in _CHUNKS.split(", ")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, own = b.column("text").to_pylist(), b.select(names[:4])
            one = np.flatnonzero([len(t) <= chunk for t in texts])
            n = pieces(name).lengths([texts[k] for k in one.tolist()])
            zero = pa.array(np.zeros(len(one), np.int32))
            yield pa.RecordBatch.from_arrays([*own.take(pa.array(one)).columns, zero, zero, pa.array(n, pa.int64()), pa.nulls(len(one), pa.string())], names)
            for k in np.flatnonzero([len(t) > chunk for t in texts]).tolist():
                last = -(-(len(texts[k]) - chunk) // step)
                head = [c[0].as_py() for c in own.slice(k, 1).columns]
                for lo in range(0, last + 1, 64):
                    cut = [(*head, last, j, None, texts[k][j * step : j * step + chunk]) for j in range(lo, min(lo + 64, last + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut, strict=True), to_arrow_schema(kinds).types, strict=True)], names)

    kinds = docs.sparkSession.createDataFrame([], _CHUNKS).schema
    return rows.mapInArrow(run, _CHUNKS)


def _counted(docs: DataFrame, name: str, chunk: int, overlap: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, hash, n_bytes, n_tokens); n_tokens is null where chunks don't align."""
    step = chunk - overlap
    chunks = stage(_chunks(docs, name, chunk, overlap), "chunks")
    names = ["row", "doc_id", "hash", "n_bytes", "last", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lasts, nos = (b.column(k).to_pylist() for k in ("text", "last", "part"))
            n, marks, befores = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            for k, text in enumerate(texts):
                at, before, n[k] = beginnings(name, text)
                near = ((at < overlap) & (nos[k] > 0)) | ((at >= step) & (at < len(text) - LOOKS) & (nos[k] < lasts[k]))
                marks[k], befores[k] = at[near] + nos[k] * step, before[near]
            made = [pa.array(n, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(befores, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, *made], [*names, "n", "marks", "befores"])

    # the chunks of one document are dealt out to all tasks
    dealt = chunks.where("text IS NOT NULL").repartition("row", "part").select(*names, "text")
    done = stage(dealt.mapInArrow(run, "row long, doc_id long, hash long, n_bytes long, last int, part int, n long, marks array<long>, befores array<long>"), "ends")
    one = chunks.where("text IS NULL").select("doc_id", "hash", "n_bytes", F.col("n").alias("n_tokens"))
    beside = Window.partitionBy("row").orderBy("part")
    many = done.withColumn("marks_before", F.lag("marks").over(beside)).withColumn("marks_after", F.lead("marks").over(beside))
    begin, end = F.array_min(F.array_intersect("marks_before", "marks")), F.array_min(F.array_intersect("marks", "marks_after"))
    tokens = lambda mark: F.expr(f"get(befores, CAST(array_position(marks, {mark}) AS INT) - 1)")
    many = many.withColumn("begin", begin).withColumn("end", end)
    upto = F.when(F.col("part") == F.col("last"), F.col("n")).otherwise(tokens("end"))
    since = F.when(F.col("part") == 0, F.lit(0)).otherwise(tokens("begin"))
    many = many.withColumn("own", upto - since).groupBy("row", "doc_id", "hash", "n_bytes")
    many = many.agg(F.sum("own").alias("n"), F.count_if(F.col("own").isNull()).alias("apart"))
    found = stage(one.union(many.select("doc_id", "hash", "n_bytes", F.expr("IF(apart = 0, n, NULL)"))), "counts")
    drop_stage(chunks)
    drop_stage(done)
    return found


def token_counts(docs: DataFrame, name: str = BYTE_BPE, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit), one row for each row, as the library counts.

    Texts of more than chunk characters are encoded as overlapping chunks, which are dealt out to all
    tasks whatever document they are of, and neighbours are spliced where both begin a pretoken. Texts
    with an overlap without such a place are done again with overlaps four times as wide, until they
    align or one chunk holds them. Other tokenizers than byte-level BPE get whole texts. A null text is
    empty and has no tokens; a null doc_id and repeated rows stay; an empty table gives an empty one.
    Other columns are ignored.
    """
    docs = small_batches(docs).select("doc_id", "text")
    if not byte_level(name):
        chunk, overlap = WHOLE, 0
    out = None
    while True:
        if chunk == WHOLE:
            found = _chunks(docs, name, chunk, overlap).select("doc_id", "hash", "n_bytes", F.col("n").alias("n_tokens"))
        else:
            found = _counted(docs, name, chunk, overlap)
        done = found.where("n_tokens IS NOT NULL")
        out = done if out is None else out.union(done)
        if chunk == WHOLE or (lost := found.where("n_tokens IS NULL")).isEmpty():
            break
        lost = lost.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
        docs = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")
        overlap *= 4
        chunk = min(WHOLE, max(chunk, 4 * overlap))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@tidy
def op4(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


# --- token files ----------------------------------------------------------------------------------

def dictionary(docs: DataFrame, name: str = BYTE_BPE, size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary trained on the serialized ids of the beginnings of at most SAMPLE_DOCS documents.

    The documents are those of least hash of doc_id and text, so that repeated and null doc_ids don't
    widen the sample. Only this sample is cut; a dictionary that the sample is too small for is made
    smaller, and one of fewer than 16 samples or 4 KB of ids is empty, with which frames are plain.
    """
    n = docs.count()
    near = F.col("h") < F.lit(2**63 * (4 * SAMPLE_DOCS / max(n, 4 * SAMPLE_DOCS) * 2 - 1)).cast("long")
    some = docs.where(F.length("text") > 0).select(F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts = [r.text for r in some.where(near).orderBy("h", "text").limit(SAMPLE_DOCS).collect()]
    samples = pieces(name).encode(texts)
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 512:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # nothing in the samples repeats
        return b""


def _hash_of(trained: bytes) -> str:
    return hashlib.sha256(trained).hexdigest()


_SEGMENT = "shard int, segment int, first_doc long, last_doc long, dictionary string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"


def write_tokens(docs: DataFrame, path: str, name: str = BYTE_BPE, end_id: int | None = 2) -> None:
    """Writes docs (doc_id, text) as a token file at path, in ascending doc_id order (null first).

    path/dictionary holds the shared dictionary with its SHA-256, the tokenizer and the end id.
    path/segments holds one row for each run of documents of one shard: their doc_ids, token counts, the
    SHA-256 of the dictionary, and one zstandard frame for each document, with the offset of each frame
    and of the end. Shards and their segments ascend in doc_id. Any document can be read by itself.
    """
    spark = small_batches(docs).sparkSession
    trained = dictionary(docs, name)
    meta = [(_hash_of(trained), trained, name, end_id)]
    spark.createDataFrame(meta, "hash string, dictionary binary, tokenizer string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    held, mark = spark.sparkContext.broadcast(trained), _hash_of(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what the worker's earlier stages left
        shard, segment = TaskContext.get().partitionId(), 0
        shared = zstandard.ZstdCompressionDict(held.value) if held.value else None
        press = zstandard.ZstdCompressor(level=1, dict_data=shared, write_content_size=True)
        ids, counts, frames, offsets = [], [], [], [0]

        def row() -> pa.RecordBatch:
            known = [x for x in ids if x is not None]
            cells = [shard, segment, min(known, default=None), max(known, default=None), mark, ids, counts, offsets, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [x.split()[0] for x in _SEGMENT.split(", ")])

        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi in _batched(texts):
                for doc_id, raw in zip(doc_ids[lo:hi], pieces(name).encode(texts[lo:hi]), strict=True):
                    ids.append(doc_id)
                    counts.append((len(raw) + len(tail)) // 4)
                    frames.append(press.compress(raw + tail))
                    offsets.append(offsets[-1] + len(frames[-1]))
                    if offsets[-1] >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                        yield row()
                        segment += 1
                        ids, counts, frames, offsets = [], [], [], [0]
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")


def _frames(segments: DataFrame, path: str, wanted: bool, out: str, each) -> DataFrame:
    """Opens the frames of segments one by one, if wanted only those at their picked places; each(segment, k, raw) makes a row."""
    spark = segments.sparkSession
    meta = spark.read.parquet(f"{path}/dictionary").first()
    trained, held = meta.hash, spark.sparkContext.broadcast(bytes(meta.dictionary))
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces.cache_clear()  # the file is written; what its workers kept would only take memory from later stages
        shared = zstandard.ZstdCompressionDict(held.value) if held.value else None
        press = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            for s in b.to_pylist():
                if s["dictionary"] != trained:
                    raise ValueError(f"segment {s['shard']}.{s['segment']} was written with dictionary {s['dictionary']}, not {trained}")
                picked = s["picked"] if wanted else range(len(s["doc_ids"]))
                made = [each(s, k, press.decompress(s["frames"][s["offsets"][k] : s["offsets"][k + 1]])) for k in picked]
                if made:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], schema=kinds)

    kinds = to_arrow_schema(spark.createDataFrame([], out).schema)
    return segments.mapInArrow(run, out)


def read_tokens(spark, path: str, doc_ids: list[int | None] | DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of a token file; with doc_ids (a list, or a table with a column doc_id) only theirs, None being a doc_id too.

    Of all segments the doc_ids are read then, and joined with the wanted ones; of those that hold one, the frames, and
    only the wanted frames are opened. Repeated wanted ids count once, documents that share a doc_id are all found.
    """
    segments, out = spark.read.parquet(f"{path}/segments"), "doc_id long, ids array<long>"
    each = lambda s, k, raw: (s["doc_ids"][k], np.frombuffer(raw, "<u4").tolist())
    if doc_ids is None:
        return _frames(segments, path, False, out, each)
    asked = doc_ids if isinstance(doc_ids, DataFrame) else spark.createDataFrame([(x,) for x in doc_ids], "doc_id long")
    asked = small_side(asked.select(F.col("doc_id").cast("long").alias("asked")).distinct())
    places = segments.select("shard", "segment", F.posexplode("doc_ids").alias("place", "own"))
    places = places.join(asked, F.col("own").eqNullSafe(F.col("asked")), "left_semi")
    picked = small_side(places.groupBy("shard", "segment").agg(F.sort_array(F.collect_list("place")).alias("picked")))
    return _frames(segments.join(picked, ["shard", "segment"]), path, True, out, each)


def token_index(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a token file, from the frames themselves.

    start is the number of ids before the document: sums over shards, over the segments of a shard, and
    inside a segment; no window holds more than one of these.
    """
    segments = spark.read.parquet(f"{path}/segments")
    sizes = segments.select("shard", "segment", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("segment_start"))
    starts = small_side(sizes.join(shards, "shard"))
    rows = _frames(segments, path, False, "shard int, segment int, place int, doc_id long, n_tokens long, ids_crc32 long", lambda s, k, raw: (s["shard"], s["segment"], k, s["doc_ids"][k], len(raw) // 4, zlib.crc32(raw)))
    own = Window.partitionBy("shard", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    start = (F.col("shard_start") + F.col("segment_start") + F.col("inside")).alias("start")
    return rows.join(starts, ["shard", "segment"]).select("doc_id", start, "n_tokens", "ids_crc32")


@tidy
def encoded(docs: DataFrame, name: str = BYTE_BPE, end_id: int | None = 2) -> DataFrame:
    """Writes docs as a token file in the shared folder and returns its token_index().

    A null text is empty and has the end id only; rows of one doc_id follow each other in any order; an
    empty table gives an empty one. Other columns are ignored.
    """
    path = stage_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, name, end_id)
    return token_index(docs.sparkSession, path)


def op6(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
