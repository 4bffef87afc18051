import numpy as np
import xxhash

from hearthframe.llm import simhash
from hearthframe.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in pairs:
            m = min(least[u], least[v])
            if least[u] != m or least[v] != m:
                least[u] = least[v] = m
                changed = True
    return least


def test_fingerprint_matches_definition(spark):
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "Ä b c d", "x " * 700, "q w e r t y u i o p " * 90]
    assert [simhash.simhash(None if t is None else t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]
    got = spark.sql("SELECT xxhash64('a b c') h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_walk_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    leaves = {int(x) for x in base}
    for x in base:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            leaves.add(int(x) ^ sum(1 << int(f) for f in flips))
    a = np.array(sorted(leaves), np.uint64)
    expected = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
    found = [(int(i), int(j)) for x, y in simhash.walk(a, None, 2, 0, 0) for i, j in zip(x, y, strict=True)]
    assert len(found) == len(set(found)) and set(found) == expected
    half = a[: len(a) // 2], a[len(a) // 2 :]
    across = {(int(i), int(j)) for x, y in simhash.walk(*half, 2, 0, 0) for i, j in zip(x, y, strict=True)}
    assert across == {(i, j - len(half[0])) for i, j in expected if i < len(half[0]) <= j}


def test_links_across_nodes_and_overfull_nodes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    leaves = sorted({int(x) ^ (1 << int(k)) ^ (1 << int(m)) for x in base for k, m in rng.integers(0, 64, (8, 2))})
    signed = [x - 2**64 if x >= 2**63 else x for x in leaves]
    pairs = [(i, j) for i in range(len(leaves)) for j in range(i) if (leaves[i] ^ leaves[j]).bit_count() <= 2]
    expected = brute_components([(signed[i], signed[j]) for i, j in pairs], signed)
    for size in (16_384, 16, 4):
        monkeypatch.setattr(simhash, "LEAVES", size)
        df = spark.createDataFrame([(x,) for x in signed], "fp long")
        got = {r.node: r.component for r in components(simhash.links(df)).collect()}
        assert got == {k: v for k, v in expected.items() if k in got}
        assert all(k == v for k, v in expected.items() if k not in got)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_with_hubs(spark):
    """Nodes that hold most links, below, among and above their neighbours, beside pairs and a chain."""
    rng = np.random.default_rng(9)
    links = [(h, h + k) for h in (10_000, 30_000, 50_000) for k in rng.choice(np.arange(-4_000, 4_000), 900, replace=False).tolist() if k]
    links += [(70_000, 70_000 - k) for k in range(1, 400)] + [(80_000 + 2 * k, 80_001 + 2 * k) for k in range(1_500)] + [(-k, -k - 1) for k in range(1, 30)]
    links += [(13_999, 26_001), (10_000, 13_999), (30_000, 26_001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == brute_components(links, {x for pair in links for x in pair})


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(5, long, "x"), (3, long + " more", "x"), (9, None, None), (8, "", "x"), (7, " \n", "x"), (2, "Solo", "x"), (2, "Solo", "x"), (None, "SOLO", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    hex_of = {t: f"{brute_fingerprint(t):016x}" for _, t, _ in rows}
    want = {5: 3, 3: 3, 9: 7, 8: 7, 7: 7, 2: 2, None: 2}
    assert got == sorted((d is None, d or 0, hex_of[t], want[d]) for d, t, _ in rows)
    kept = simhash.one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7] and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    ids = sorted(prints)
    a = np.array([prints[i] for i in ids], np.uint64)
    pairs = [(ids[i], ids[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 2)]
    want = brute_components(pairs, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_different_texts_of_one_id_stay(spark):
    rows = [(None, "the first text has no id at all"), (None, "and the second is about something else"), (7, "seven is shared by two rows of text"), (7, "which have no word in common but these")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(df).collect()) == sorted(t for _, t in rows)


def test_bitmaps_rule_out_no_similar_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        both, own, other = (rng.integers(0, 2**63, int(k), dtype=np.uint64) for k in (rng.integers(1, 300), *rng.integers(0, 60, 2)))
        a, b = np.unique(np.concatenate([both, own])), np.unique(np.concatenate([both, other]))
        similar = 5 * len(both) >= 4 * (len(both) + len(own) + len(other))
        assert simhash._may_be_similar(len(a), simhash._bits(a), len(b), simhash._bits(b), 0.8) or not similar
        assert (simhash._unpacked(simhash._packed(a)) == a >> np.uint64(24)).all()
