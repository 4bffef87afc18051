import random

import numpy as np

from hearthframe.llm import decontam


def brute_tiles(item, text, shortest):
    shortest = min(shortest, len(item))
    used, taken, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                m = 0
                while a + m < len(item) and b + m < len(text) and item[a + m] == text[b + m] and a + m not in used and b + m not in taken:
                    m += 1
                if m > best[0]:
                    best = (m, a, b)
        if best[0] < shortest or not best[0]:
            return out
        m, a, b = best
        used |= set(range(a, a + m))
        taken |= set(range(b, b + m))
        out.append((a, b, m))


def test_word_hashes(monkeypatch):
    words = ["a", "b", "ab", "ba", "ñandú", "x" * 40, "the", "of"]
    text = " ".join(words * 30) + "  , \n" + " ".join(words)
    whole = decontam.word_hashes(decontam.plain(text))
    assert len(whole) == len(decontam.words_of(text)) == 31 * len(words)
    assert (whole.reshape(-1, len(words)) == whole[: len(words)]).all() and len(set(whole.tolist())) == len(words)
    monkeypatch.setattr(decontam, "AT_ONCE", 64)
    assert (decontam.word_hashes(decontam.plain(text)) == whole).all()
    assert len(decontam.word_hashes(b"")) == len(decontam.word_hashes(b"   ")) == 0


def test_tiles_against_greedy_search():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 18))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        got = decontam.tiles(np.array(item), np.array(text, np.int64), 3)
        assert sum(t[2] for t in got) == sum(t[2] for t in brute_tiles(item, text, 3))
        assert [t[2] for t in got] == sorted((t[2] for t in got), reverse=True)
        for a, b, m in got:
            assert item[a : a + m] == text[b : b + m]


def test_catches_reordered_passages(spark):
    parts = ["alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey"]
    items = [(7, ". ".join(parts)), (8, "tiny item"), (9, None), (10, ""), (7, ". ".join(parts))]
    docs = [
        (1, "Before! " + " - ".join(reversed(parts)).upper() + " after", 0), (2, parts[0] + " and nothing else of it", 0), (3, None, 0), (4, "", 0),
        (5, "some words " * 50_000 + parts[1] + " x " + parts[2], 0), (None, "tiny, ITEM", 0), (1, parts[0], 0), (6, "item tiny", 0),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6]
    found = {r.doc_id: r.found for r in decontam.tiled(df, bench, ["doc_id"], "found").collect()}
    assert [h.item_id for h in found[None]] == [8] and found[5][0].coverage == 12 / 18
    assert decontam.decontaminated(df.limit(0), bench).count() == 0 and decontam.decontaminated(df, bench.limit(0)).count() == len(docs)


def test_blocks_give_the_same(spark, monkeypatch):
    want = sorted(map(str, decontam.op9(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(decontam, "BLOCK", 400)
    got = decontam.op9(spark, "/root/testdata/sf0.001").collect()
    assert sorted(str(r.__class__(r.doc_id, r.contaminated, sorted(r.item_ids), r.coverage)) for r in got) == sorted(str(r.__class__(*r)) for r in decontam.op9(spark, "/root/testdata/sf0.001").collect())
    assert len(want) == len(got)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = {r.item_id: [w.decode() for w in decontam.words_of(r.text)] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: [w.decode() for w in decontam.words_of(r.text)] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {}
    for d, w in docs.items():
        seen = {tuple(w[k : k + 5]) for k in range(len(w))}
        want[d] = []
        for i, item in items.items():
            if any(tuple(item[k : k + 5]) in seen for k in range(len(item) - 4)):
                cover = sum(t[2] for t in brute_tiles(item, w, 3)) / len(item)
                if cover >= 0.5:
                    want[d].append(i)
    assert {r.doc_id: r.item_ids for r in decontam.op9(spark, sf).collect()} == {d: sorted(x) for d, x in want.items()}
    assert any(want.values())


def test_short_shared_pieces_and_equal_words():
    """Items cut into runs of three and four words are found; a long text of one word is tiled in bounded memory."""
    item = "a1 a2 a3 a4 b1 b2 b3 b4 c1 c2 c3 c4 d1 d2 d3 d4"
    bench = decontam.Benchmark([(1, item), (2, "word " * 40 + "then others follow")])
    edited = " x ".join([item[:11], item[12:23], item[24:35], item[36:47]])
    assert [h["item_id"] for h in bench.hits(edited)] == [1] and bench.hits("a1 a2 a3 q b1 b2") == []
    assert [(h["item_id"], h["coverage"]) for h in bench.hits("word " * 300_000)] == [(2, 40 / 43)]
