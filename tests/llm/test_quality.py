import random
import re

import duckdb

from hearthframe.llm import quality

SF = "/root/testdata/sf0.001"


def brute(text):
    """The measures of one text from their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    later = [x for k, x in enumerate(lines) if x in lines[:k]]
    inside = {}
    for n in quality.COVERED:
        runs = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        inside[n] = {k + j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(n)}
    total = sum(map(len, words))
    chars = {n: sum(len(words[k]) for k in inside[n]) for n in inside}
    line_chars = sum(len(w) for x in later for w in re.findall(r"[^\x20\x09-\x0D]+", x))
    failed = len(words) < 10 or 100 * len(inside[5]) > 20 * len(words)
    kept = not failed and 100 * line_chars <= 20 * total and all(100 * chars[n] <= most * total for n, most in quality.COVERED.items())
    return [len(words), total, sum(c in "#*$%&|<>" for c in text), len(lines), len(later), line_chars, len(inside[5]), *chars.values(), failed, kept]


def rows_of(df):
    return sorted((list(r) for r in df.collect()), key=str)


def test_against_definitions(spark):
    rng = random.Random(13)
    texts = [None, "", " \n\t ", "a", "\x1c\x1f", "a\x85b c", "# * $ %&|<>", "ñandú " * 12, "x\n" * 9, "same line here\n" * 4 + " ".join(map(str, range(80)))]
    for _ in range(150):
        pool = [f"w{k}é" for k in range(rng.choice([2, 5, 30, 400]))]
        words = [rng.choice(pool) for _ in range(rng.randint(0, 120))]
        if len(words) > 30 and rng.random() < 0.7:
            k, n = rng.randint(0, 20), rng.randint(5, 12)
            words[40:40] = words[k : k + n]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t", "\r\n"]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.judged(df).select("doc_id", "quality.*")
    assert rows_of(got) == sorted(([k, *brute(t)] for k, t in enumerate(texts)), key=str)
    assert {r.kept for r in got.collect()} == {True, False}


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(quality.OP13_SQL)
    got = quality.op13(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.select(*want.columns)) == sorted((list(r) for r in want.fetchall()), key=str)


def test_long_text():
    words = [f"v{k % 70_000}" for k in range(300_000)]
    got = dict(zip(quality._MEASURES, quality.measures(" ".join(words).encode()), strict=True))
    assert got["n_words"] == got["n_repeat_words"] == 300_000
    assert got["dup_chars_10"] == got["word_chars"] == sum(map(len, words))
    one = quality.measures(b"x" * 5_000_000)
    assert one[:2] == [1, 5_000_000]


def test_columns_repeats_and_empty_tables(spark):
    clean = " ".join(f"word{k}" for k in range(40))
    rows = [(None, clean, "mine", 7), (None, clean, "mine", 7), (3, None, None, None), (4, "again and again and again " * 5, "mine", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _measures string, kept int")
    out = quality.good(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == rows[:2]
    assert quality.judged(df).where("quality.base_failed").count() == 2
    assert quality.good(df.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    found = quality.judged(docs, "found").where("NOT found.base_failed")
    assert found.where("found.kept").count() >= 0.98 * found.count() > 100
