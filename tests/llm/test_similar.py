from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from hearthframe.llm import simhash

SF = "/root/testdata/sf0.001"


def test_dedup_keeps_one_of_similar_texts(spark):
    """Near copies far apart in bits go; texts alike in few bits only stay; ids may be null or repeated."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IN (1, 177)").withColumn("doc_id", F.col("doc_id") + 50_000))
    docs = docs.where("length(trim(text)) > 0")
    more = [(None, "alone without an id"), (None, "another one without an id"), (70_000, "this id is there"), (70_000, "twice with two texts"), (70_001, "twice with TWO texts")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text, set(simhash.shingles(r.text.encode(), 5).tolist())) for r in docs.collect()]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    far = 0
    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows[:i]):
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                at[max(root(i), root(j))] = min(root(i), root(j))
                far = max(far, (simhash.simhash(a.encode(), 5) ^ simhash.simhash(b.encode(), 5)).bit_count())
    groups = {}
    for i, (d, t, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((d is None, d or 0, t))
    got = Counter((r.doc_id is None, r.doc_id or 0) for r in simhash.one_of_similar(docs).collect())
    assert far > 16 and got == Counter(min(g)[:2] for g in groups.values())
    kept = {r.text for r in simhash.one_of_similar(docs).where("doc_id IS NULL OR doc_id = 70000").collect()}
    assert kept == {t for _, t in more[:4]}
    one = (corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)).where("doc_id IN (1, 6, 145, 177)")
    assert sorted(r.doc_id for r in one.collect()) == [1, 6]
