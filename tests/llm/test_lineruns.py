import random

import numpy as np

from hearthframe.llm import lineruns


def brute(docs, least):
    """Removed line numbers by document: every maximal run of least words that begins earlier too."""
    order = sorted(docs)
    lines = {d: [(k, x.strip()) for k, x in enumerate((docs[d] or "").split("\n")) if x.strip()] for d in order}
    flat = [(d, s) for d in order for s in range(len(lines[d]))]
    gone = {d: set() for d in order}
    for b, (d, s) in enumerate(flat):
        best = 0
        for e, t in flat[:b]:
            m = 0
            while s + m < len(lines[d]) and t + m < len(lines[e]) and lines[d][s + m][1] == lines[e][t + m][1]:
                m += 1
            best = max(best, m)
        run = lines[d][s : s + best]
        if sum(len(x.split()) for _, x in run) >= least:
            gone[d] |= {k for k, _ in run}
    return gone


def cut(docs, gone):
    return {d: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs.items()}


def test_stretches():
    for words in ([3, 1, 60, 2, 49, 1], [50], [1] * 120, [49], []):
        ahead, back = lineruns.stretches(np.array(words, np.int64), 50)
        for k in range(len(words)):
            want = next((m for m in range(1, len(words) - k + 1) if sum(words[k : k + m]) >= 50), 0)
            assert ahead[k] == want
            assert back[k] == next((m for m in range(1, k + 2) if sum(words[k - m + 1 : k + 1]) >= 50), 0)


def test_against_all_runs(spark):
    rng = random.Random(4)
    for least in (6, 1, 17):
        pool = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 5))) for _ in range(5)]
        docs = {k: "\n".join(rng.choice([*pool, f"own {k} {rng.random()}", "", "  "]) for _ in range(rng.randint(0, 14))) for k in range(25)}
        docs[25] = docs[3]
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r.doc_id: r.text for r in lineruns.without_repeats(df, least).collect()}
        assert got == cut(docs, brute(docs, least))


def test_edge_cases(spark):
    long = "\n".join(f"line {k} of it" for k in range(3000))
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, passage + "\nown", 0), (2, " before\r\n" + passage + " \nafter\n", 0), (3, None, 0), (4, "", 0), (5, "same two\n" * 60, 0), (6, "short boilerplate", 0), (7, "short boilerplate", 0)]
    rows += [(8, long, 0), (9, long, 0), (8, long, 0), (None, passage, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    out = lineruns.without_repeats(df, counts=True)
    assert out.columns == ["doc_id", "text", "doc", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or 0, r.text, r.n_removed) for r in out.collect()), key=str)
    want = [(0, "", 1), (1, passage + "\nown", 0), (2, " before\r\nafter\n", 1), (3, None, 0), (4, "", 0), (5, "same two\n", 59), (6, "short boilerplate", 0), (7, "short boilerplate", 0), (8, long, 0), (8, long, 0), (9, "", 3000)]
    assert got == sorted(want, key=str)
    assert lineruns.without_repeats(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = cut(docs, brute(docs, 50))
    assert {r.doc_id: r.text for r in lineruns.op8(spark, "/root/testdata/sf0.001").collect()} == want
    assert want != docs


def test_helper_columns_do_not_clash(spark):
    line = " ".join(f"w{k}" for k in range(60))
    names = ["row", "row_id", "row_doc", "row_begins", "row_counts", "doc", "own_id", "own_doc", "begins", "sizes", "out", "times", "n"]
    df = spark.createDataFrame([(1, f"{line}\nown one", *names), (2, f"{line}\nown two", *names)], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    out = lineruns.without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{line}\nown one", 2: "own two"}


def test_one_line_and_one_run_in_all_documents(spark):
    """A hot line, and a hot pair of lines, are joined apart from the others, with the results of a search."""
    head, foot = "every document begins like this", "and ends " + " ".join(f"e{k}" for k in range(50))
    docs = {k: "\n".join([head, foot] * (1 + k % 2) + [f"own line {k} {j}" for j in range(3)] + [foot]) for k in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for least in (50, 10):
        assert {r.doc_id: r.text for r in lineruns.without_repeats(df, least).collect()} == cut(docs, brute(docs, least))
