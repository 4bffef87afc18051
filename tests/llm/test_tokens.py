import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearthframe.llm import tokens

LIB = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


ODD = st.lists(st.sampled_from(list("ab'sltre \n\t.9é  \x1c漢²") + ["'ll", "<|endoftext|>", "  "]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_pieces_encode_as_the_library(texts):
    got = tokens.Pieces(tokens.BYTE_BPE).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids(t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(ODD, ODD, ODD)
def test_common_beginnings_are_stable(a, b, c):
    text = a + b + c
    whole, before, n = tokens.beginnings(tokens.BYTE_BPE, text)
    left, _, _ = tokens.beginnings(tokens.BYTE_BPE, a + b)
    right, since, m = tokens.beginnings(tokens.BYTE_BPE, b + c)
    safe = {int(x) for x in left if x < len(a + b) - tokens.LOOKS}
    assert safe <= {int(x) for x in whole}
    for x, k in zip(right, since, strict=True):
        if int(x) + len(a) in safe:
            assert before[list(whole).index(int(x) + len(a))] + m - k == n


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    long = "It's  the\n\n well-known 'll thing, 12345 times. " * 300
    stuck = "x" * 900 + " y " + "z" * 5000 + " end" * 50
    rows = [(1, long, 0), (2, stuck, 0), (2, stuck, 0), (3, "", 0), (4, None, 0), (None, "<|endoftext|> é", 0), (5, " " * 3000, 0), (6, "漢字" * 2000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    lib = tokens.tokenizer(name)
    count = (lambda t: len(lib.encode(t))) if name.endswith(".model") else (lambda t: len(lib.encode(t, add_special_tokens=False)))
    want = sorted((d or 0, len((t or "").encode()), count(t or ""), count(t or "") > 512) for d, t, _ in rows)
    got = tokens.token_counts(df, name, chunk=400, overlap=40).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokens.token_counts(df.limit(0), name).count() == 0


def test_queries_against_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.op4(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (len(t.encode()), len(ids(t))) for d, t in docs.items()}
    start, want = 0, {}
    for d in sorted(docs):
        all_ids = [*ids(docs[d]), 2]
        want[d] = (start, len(all_ids), zlib.crc32(np.array(all_ids, "<u4").tobytes()))
        start += len(all_ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.op6(spark, "/root/testdata/sf0.001").collect()} == want


def test_token_file(spark, tmp_path, monkeypatch):
    rows = [(5, "a b", "x"), (None, "null id", "x"), (5, "c", "x"), (7, None, "x"), (1, "", "x"), (9, "w " * 100_000, "x")]
    rows += [(k, f"word{k % 7} and text number {k} of the sample, which is said again and again " * 40, "x") for k in range(20, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens.write_tokens(df, f"{tmp_path}/t")
    back = sorted((r.doc_id or 0, r.ids) for r in tokens.read_tokens(spark, f"{tmp_path}/t").collect())
    assert back == sorted((d or 0, [*ids(t), 2]) for d, t, _ in rows)
    assert spark.read.parquet(f"{tmp_path}/t/dictionary").first().dictionary
    some = tokens.read_tokens(spark, f"{tmp_path}/t", [7, 33, 1000]).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == sorted((d, [*ids(t), 2]) for d, t, _ in rows if d in (7, 33))
    many = tokens.read_tokens(spark, f"{tmp_path}/t", [None, None, 5, *range(200, 100_200)]).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in many) == sorted((d or 0, [*ids(t), 2]) for d, t, _ in rows if d is None or d == 5 or d >= 200)
    asked = spark.createDataFrame([(9,), (None,), (9,)], "doc_id int")
    assert sorted(r.doc_id or 0 for r in tokens.read_tokens(spark, f"{tmp_path}/t", asked).collect()) == [0, 9]
    assert tokens.read_tokens(spark, f"{tmp_path}/t", []).count() == 0
    assert tokens.encoded(df.limit(0)).count() == 0
    assert sorted(r.start for r in tokens.encoded(df.where("doc_id IS NULL OR doc_id < 10")).collect())[0] == 0


def test_chunks_of_a_huge_text_are_dealt_out(spark):
    text = "It's one of many words, 123 of them.\n" * 60_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    chunks = tokens._chunks(df, tokens.BYTE_BPE, 32_768, 1_024).where("text IS NOT NULL")
    spread = chunks.repartition(8, "row", "part").select(F.spark_partition_id().alias("p")).distinct().count()
    assert chunks.count() == -(-(len(text) - 32_768) // 31_744) + 1 and spread > 4
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert got == {1: len(ids(text)), 2: len(ids("short"))}


def test_forgetting_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    held = tokens.Pieces(tokens.BYTE_BPE)
    sizes = []
    for k in range(40):
        text = " ".join(["the", "same", "words", *(f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(20))])
        assert np.frombuffer(held.encode([text])[0], "<u4").tolist() == ids(text)
        sizes.append(held.n)
    assert max(sizes) < 100 and any(b < a for a, b in zip(sizes, sizes[1:], strict=False))
