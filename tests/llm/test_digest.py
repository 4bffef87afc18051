import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from hearthframe.llm import digest


def brute_entropy(data, k):
    c = Counter(data[k : k + 64])
    return -sum(n / 64 * math.log2(n / 64) for n in c.values())


def brute_features(data, rank):
    n = len(data) - 63
    r = [int(rank[x]) for x in digest.entropies(np.frombuffer(data, np.uint8))]
    wins = Counter()
    for k in range(max(1, n - 63)):
        run = r[k : k + 64]
        if min(run) < digest.STEPS:
            wins[k + run.index(min(run))] += 1
    return [k for k in sorted(wins) if wins[k] >= min(16, max(1, n - 63))]


def test_entropies():
    rng = np.random.default_rng(0)
    for size in (10, 64, 65, 700):
        data = rng.integers(0, 12, size).astype(np.uint8)
        got = digest.entropies(data)
        want = [brute_entropy(data.tobytes(), k) / 6 * 1000 for k in range(size - 63)]
        assert len(got) == max(0, len(want)) and all(abs(g - w) <= 1 for g, w in zip(got, want, strict=True))
    assert (digest.entropies(np.zeros(200, np.uint8)) == 0).all()


def test_histogram_counts_windows_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 110, n).astype(np.uint8).tobytes() for n in (0, 5, 64, 200, 900, 64, 3000)]
    want = sum(np.bincount(digest.entropies(np.frombuffer(t, np.uint8)), minlength=1000) for t in texts)
    for at_once in (1 << 17, 256):
        monkeypatch.setattr(digest, "AT_ONCE", at_once)
        assert (digest.histogram(texts) == want).all()


def test_features_and_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    rank = digest.ranks(np.bincount(rng.integers(0, 1000, 5000), minlength=1000))
    for size in (64, 80, 127, 128, 500, 5000):
        data = rng.integers(97, 120, size).astype(np.uint8).tobytes()
        want = digest.fingerprint(data, rank)
        at = brute_features(data, rank)
        rows = np.zeros((-(-len(at) // 160), 2048), np.uint8)
        for k, p in enumerate(at):
            rows[k // 160, digest._sets(np.frombuffer(data[p : p + 64], np.uint8)[None])[0]] = 1
        assert (want.rows == rows).all()
        with monkeypatch.context() as m:
            m.setattr(digest, "AT_ONCE", 300)
            assert str(digest.fingerprint(data, rank)) == str(want)


def test_likeness():
    rng = np.random.default_rng(3)
    rank = digest.ranks(np.zeros(1000, np.int64))
    a, b = (rng.integers(97, 122, 6000).astype(np.uint8).tobytes() for _ in range(2))
    of = lambda t: digest.fingerprint(t, rank)
    assert of(a).likeness(of(a)) == 1 and of(a).likeness(of(b)) < 0.1
    assert 0.3 < of(a).likeness(of(a[:3000] + b[:3000])) < 0.95
    assert of(b"").likeness(of(b"")) == 1 and of(b"").likeness(of(a)) == 0 and of(b"x").likeness(of(b"y")) == 0
    assert of(b"\0" * 500).likeness(of(b"\1" * 900)) == 1 and of(b"\0" * 500).likeness(of(a)) == 0


@pytest.mark.parametrize("range_bytes", [1 << 30, 40_000])
def test_query_against_the_contract(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(digest, "RANGE_BYTES", range_bytes)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    rank = digest.ranks(digest.histogram([t.encode() for t in docs.values()]))
    got = {r.doc_id: r for r in digest.op7(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs)
    for k, d in enumerate(ids):
        text, following = docs[d], docs[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        other = (text[:-half] if half else text) + following[:half]
        own, changed, after = (digest.fingerprint(t.encode(), rank) for t in (text, other, following))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (str(own), str(changed))
        assert (r.near_edited, r.near_next) == (own.likeness(changed), own.likeness(after))


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(digest, "RANGE_BYTES", 50_000)
    rows = [(3, None, 1), (2, "", 1), (None, "é" * 40, 1), (2, "", 1), (7, "text and more of it " * 20_000, 1), (5, "ab", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = digest.fingerprints(df).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 40), (2, 0), (2, 0), (3, 0), (5, 2), (7, 400_000)]
    five = next(r for r in got if r.doc_id == 5)
    assert five.edited_sha256 == hashlib.sha256(b"a").hexdigest() and five.near_edited == 0
    assert next(r for r in got if r.doc_id is None).edited_sha256 == hashlib.sha256(("é" * 20 + "text and more of it ").encode()).hexdigest()
    assert digest.fingerprints(df.limit(0)).count() == 0 and digest.fingerprints(df.limit(1)).count() == 1
