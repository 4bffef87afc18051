import pathlib
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from hearthframe import staging
from hearthframe.llm import decontam, mixing, tokens
from hearthframe.staging import stage

SF = "/root/testdata/sf0.001"


def runs(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages_against_brute_force(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = stage(spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(90_001, "12 34", None, "src1", 5), (90_002, None, "en", None, 0), (90_003, "the the of", None, None, 10)], "doc_id long, text string, lang string, source string, n_chars long")))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    (_, language), (_, dedup), (_, clean), (_, mix), (_, write) = corpus_pipeline.STAGES

    docs = stage(language(spark, docs, SF))
    assert docs.columns == columns and docs.where("lang IS NULL").count() == 0
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {d for d, t in texts.items() if t and any(c.isalpha() for c in t)}

    docs = stage(dedup(spark, docs, SF))
    sets = {d: runs(texts[d]) for d in kept}
    least = {d: d for d in kept}
    for _ in range(6):
        for a in sorted(kept):
            for b in sorted(kept):
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = {d for d in kept if least[d] == d}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == kept

    docs = stage(clean(spark, docs, SF))
    against = decontam.Benchmark(bench)
    kept = {d for d in kept if not against.hits(texts[d])}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == kept

    sizes = mixing.sizes_of(docs)
    drawn = mixing.drawn(sizes, mixing.plan(sizes, mixing.Mix()), mixing.Mix()).select("row.doc_id", "mixed")
    taken = {r.doc_id: len(r.mixed) for r in drawn.collect()}
    docs = stage(mix(spark, docs, SF))
    drawn = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == columns and drawn == {d: n for d, n in taken.items() if n}

    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in write(spark, docs, SF).collect())
    start, want = 0, []
    for d in sorted(drawn):
        ids = [*tokens.tokenizer(tokens.BYTE_BPE).encode(texts[d], add_special_tokens=False).ids, 2]
        for _ in range(drawn[d]):
            want.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert got == want
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
    assert docs.count() == 0


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    """Null and repeated ids, repeated rows, a huge text, and columns named like the stages' helpers."""
    huge = "huge text of many different words " + " ".join(f"w{k}" for k in range(60_000))
    rows = [(None, "one without an id", "en", "a"), (None, "another without an id", None, None), (7, "seven has a text", "en", "a"), (7, "seven has quite another text", "en", "b"), (8, "seven has a text", "en", "a"), (8, "seven has a text", "en", "a"), (9, None, None, None), (10, "", "en", "a"), (11, huge, "en", "a")]
    cols = ["key", "row", "hits", "at", "_id", "_text", "shard", "lang_pred", "size"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in cols)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *cols) for r in rows], schema)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
        if name != "token_file":
            assert {tuple(r)[5:] for r in docs.collect()} == {tuple(cols)}
        if name == "simhash_dedup":
            assert sorted(r.text for r in docs.collect()) == sorted([rows[0][1], rows[1][1], rows[2][1], rows[3][1], huge])
        if name != "token_file":
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert docs.count() > 0


def test_language_stage_keeps_columns_and_unlabelled_documents(spark):
    """A column lang_pred or score of the documents stays as it is, and without labels only texts without a letter go."""
    rows = [(1, "the cat sat on the mat", "en", "mine", 7.5), (2, "el gato come pescado", None, None, None), (3, "12 34 !", "en", "mine", 1.0), (4, None, "en", "mine", 2.0)]
    kinds = "doc_id long, text string, lang string, lang_pred string, score double"
    docs = spark.createDataFrame(rows, kinds)
    out = corpus_pipeline.identify_language(spark, docs, SF)
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, rows[1][1], "en", None, None)]
    none = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], kinds)
    assert sorted(map(tuple, corpus_pipeline.identify_language(spark, none, SF).collect())) == [(*r[:2], None, *r[3:]) for r in rows[:2]]


def test_run_leaves_the_token_file_only(spark):
    folder = pathlib.Path(staging.shared_dir(spark).removeprefix("file:"), "staged")
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} <= {"tokens", "side"}
    assert out.count() > 100
