import hashlib
import math
import random

import duckdb
import numpy as np

from hearthframe.llm import clustering

SF = "/root/testdata/sf0.001"


def brute(rows, k, rounds, dims):
    """Lloyd's rounds in plain whole numbers."""
    held = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    pick = lambda v: min(range(len(centroids)), key=lambda j: (apart(v, centroids[j]), j))
    for _ in range(rounds):
        of = [pick(v) for _, v in held]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(held, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, pick(v), apart(v, centroids[pick(v)])) for i, v in held]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out), names[c]) for i, c, d in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_plain_rounds(spark):
    rng = random.Random(12)
    middles = [[rng.uniform(-2, 2) for _ in range(5)] for _ in range(4)]
    rows = [(k, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for k in range(300)]
    rows += [(300 + k, [0.5] * 5) for k in range(90)] + [(7, rows[7][1]), (7, [0.1] * 5), (None, [0.25, -0.25, 0, 0, 1e-9]), (None, None)]
    rows += [(900, [1.0] * 4), (901, [1.0] * 6), (902, [1.0, None, 0, 0, 0]), (903, [math.nan] * 5), (904, [math.inf, 0, 0, 0, 0]), (905, [-1e-9] * 5), (906, [])]
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], "vec_id int, embedding array<double>, cluster int, distance string")
    want = brute(rows, 4, 6, 5)
    assert len(want) == 394
    for parts in (1, 5):
        assert got(clustering.clustered(df.repartition(parts), 4, 6, 5)) == want


def test_ties_and_equal_centroids(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(40)] + [(50, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(clustering.clustered(df, 3, 4, 2)) == brute(rows, 3, 4, 2)
    few = df.where("vec_id < 3")
    assert got(clustering.clustered(few, 8, 4, 2)) == brute(rows[:3], 8, 4, 2)
    assert clustering.clustered(df.limit(0), 3, 4, 2).count() == 0
    assert clustering.clustered(df, 3, 4, 2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_balls_are_assigned_whole():
    """Separate groups need few exact comparisons, and every label is the nearest centroid's."""
    rng = np.random.default_rng(4)
    middles = rng.integers(-4000, 4000, (6, 8))
    x = np.concatenate([m + rng.integers(-60, 60, (500, 8)) for m in middles] + [np.tile(middles[0], (200, 1))])
    order, balls = clustering.grown(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    own = x[order]
    for b in range(len(balls["low"])):
        rows = own[balls["low"][b] : balls["high"][b]]
        assert (rows.sum(axis=0) == balls["sums"][b]).all()
        assert np.sqrt(((rows - rows.mean(axis=0)) ** 2).sum(axis=1)).max() <= balls["radius"][b]
    for centroids in (middles, x[:6], np.concatenate((middles[:3], middles[:3])), x[rng.choice(len(x), 20)]):
        of, whole, single = clustering.labels(own, balls, centroids)
        far = ((own[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (of == far.argmin(axis=1)).all()
        covered = sum(int(balls["high"][b] - balls["low"][b]) for b, _ in whole)
        assert covered + single.sum() == len(x)
    assert clustering.labels(own, balls, middles)[2].sum() == 0


def test_large_numbers(spark):
    rows = [(k, [131071.0 - k, -131071.0 + 7 * k, 0.0]) for k in range(50)]
    assert got(clustering.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 5, 3)) == brute(rows, 3, 5, 3)


def test_query_against_sql_and_plain_rounds(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(clustering.OP12_SQL)
    out = clustering.op12(spark, SF)
    assert out.columns == want.columns
    assert got(out) == sorted(want.fetchall(), key=str)
    assert got(out) == brute(con.sql("SELECT vec_id, embedding FROM embeddings").fetchall(), 8, 10, 64)
