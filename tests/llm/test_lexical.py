import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from hearthframe.llm import lexical

SF = "/root/testdata/sf0.001"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=50):
    """Ranked rows by scoring every document for every item."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:best])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(rng, n):
    pool = [f"w{k}" for k in range(60)] + ["Ñandú", "x1"]
    weights = [1 / (k + 1) for k in range(len(pool))]
    return [" ".join(rng.choices(pool, weights, k=rng.randint(0, 40))) for _ in range(n)]


def test_against_scoring_all(spark):
    rng = random.Random(11)
    texts = corpus(rng, 400) + ["same text w3 w9"] * 60 + [None, "", "--- !", "W1\x00w2_w3", "w5" * 3]
    docs = list(enumerate(texts)) + [(7, "w59 w58"), (7, "w59 w58"), (None, "w59 w57")]
    rng.shuffle(docs)
    items = [(1, "w0 w1 W2"), (2, "w59 w58 w40 w3"), (3, None), (4, ""), (5, "nowhere"), (6, "same text"), (6, "Ñandú x1"), (None, "w9 w9"), (8, " ".join(f"w{k}" for k in range(60)))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for parts in (1, 7):
        assert got(lexical.search(lexical.index(d.repartition(parts)), q)) == want
    assert got(lexical.search(lexical.index(d.repartition(5)), q, best=3)) == brute(docs, items, 3)


def test_thresholds_of_first_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "BLOCK", 5)
    rng = random.Random(5)
    docs = list(enumerate(corpus(rng, 300)))
    items = list(enumerate(corpus(rng, 6)))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    built = lexical.index(d.repartition(12))
    assert built.select("shard").distinct().count() == 12
    assert got(lexical.search(built, q, best=4)) == brute(docs, items, 4)


def test_lists_that_are_probed_only(monkeypatch):
    """Common terms are not read while no document can qualify by them, and results are those of reading all."""
    monkeypatch.setattr(lexical, "STEP", 16)
    rng = np.random.default_rng(3)
    n, sizes = 400, rng.integers(5, 50, 400)
    weights = {f"t{k}".encode(): int(50 + 900 * k) for k in range(8)}
    held = {t: np.sort(rng.choice(n, 390 - 45 * k, replace=False)).astype(np.int32) for k, t in enumerate(weights)}
    lists = lexical.Lists(sizes, n, int(sizes.sum()), 10)
    scores = np.zeros(n, np.int64)
    for t, docs in held.items():
        tfs = rng.integers(1, 4, len(docs)).astype(np.int32)
        lists.add(t, weights[t], docs, tfs, int(tfs.max()), int(sizes[docs].min()))
        scores[docs] += weights[t] * ((10**9 * tfs.astype(np.int64)) // (1000 * tfs + 20 * lists.m[docs]))
    docs, found = lists.search(list(weights), 1)
    order = np.lexsort((np.arange(n), -scores))[:10]
    assert docs.tolist() == order.tolist() and found.tolist() == scores[order].tolist()
    again = lexical.Lists(sizes, n, int(sizes.sum()), 10)
    again.add(b"rare", 9000, held[b"t7"], np.ones(len(held[b"t7"]), np.int32), 1, int(sizes.min()))
    again.add(b"common", 1, held[b"t0"], np.ones(len(held[b"t0"]), np.int32), 1, int(sizes.min()))
    assert len(again.search([b"rare", b"common"], 2**62)[0]) == 0
    assert not again.read


def test_long_texts_and_terms():
    text = (" ".join(f"v{k % 500}" for k in range(400_000)) + " " + "Z" * 3_000_000 + " end").encode()
    found = Counter(t for part in lexical.pieces(text) for t in part)
    assert found[b"z" * 3_000_000] == found[b"end"] == 1 and found[b"v7"] == 800
    shard = lexical._Shard()
    shard.add(1, text)
    rows = [r for b in shard.rows(0) for r in b.to_pylist()]
    assert rows[0]["sizes"] == [400_002]
    assert {r["term"]: int(np.frombuffer(r["tfs"], np.int32)[0]) for r in rows[1:]} == found


def test_empty_tables_and_other_columns(spark):
    d = spark.createDataFrame([(1, "one two", 3)], "doc_id int, text string, shard int")
    q = spark.createDataFrame([("a", "two", 9)], "item_id string, text string, score int")
    out = lexical.search(lexical.index(d), q)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r)[:3] for r in out.collect()] == [("a", 1, 1)]
    assert lexical.search(lexical.index(d.limit(0)), q).count() == 0
    assert lexical.search(lexical.index(d), q.limit(0)).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(lexical.OP11_SQL)
    out = lexical.op11(spark, SF)
    assert out.columns == want.columns
    assert got(out) == sorted(want.fetchall(), key=str)
