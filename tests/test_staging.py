import os
from types import SimpleNamespace

import pytest

from hearthframe import staging
from hearthframe.operators.joins import join_hot, small_side


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    for master, fails in (("local-cluster[3,2,3000]", True), ("spark://host:7077", True), ("local[4]", False), ("local", False)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        if fails:
            with pytest.raises(RuntimeError):
                staging.shared_dir(session)
        else:
            assert staging.shared_dir(session) == staging.LOCAL_CHECKPOINTS


def test_tidy_keeps_what_the_result_reads(spark):
    paths = []

    @staging.tidy
    def inner(n):
        kept, gone = staging.stage(spark.range(n), "kept"), staging.stage(spark.range(n), "gone")
        paths.extend([kept.inputFiles()[0], gone.inputFiles()[0]])
        return kept

    @staging.tidy
    def outer():
        a, b = inner(3), inner(4)
        return a if b.count() == 4 else b

    there = lambda: [os.path.exists(p.removeprefix("file://")) for p in paths]
    out = outer()
    assert there() == [True, False, False, False] and out.count() == 3


def test_sides_and_hot_keys(spark):
    rows = spark.createDataFrame([(1, k) for k in range(2_000)] + [(2, 0), (3, 0)], "key int, k int")
    side = staging.stage(spark.createDataFrame([(1, 2_000, "a"), (2, 1, "b")], "key int, n int, name string"))
    got = join_hot(rows, side, "key", "n").groupBy("name").count().collect()
    assert {r.name: r["count"] for r in got} == {"a": 2_000, "b": 1}
    assert "broadcast" in small_side(side, written=True)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small_side(side, size=10, written=True)._jdf.queryExecution().logical().toString().lower()


def test_folders_with_odd_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"{tmp_path}/a b%ñ")
    df = staging.stage(spark.range(10), "t")
    assert staging.bytes_on_disk(df) > 0 and "broadcast" in small_side(df, written=True)._jdf.queryExecution().logical().toString().lower()
    staging.drop_stage(df)
    assert not any(p.is_file() for p in tmp_path.rglob("part-*"))
