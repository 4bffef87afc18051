import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from hearthframe.operators import history, summaries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_as_of_with_a_hot_key_in_stretches(spark):
    """The key 1 has two thirds of all rows; cut into stretches or not, results are those of a search."""
    rng = random.Random(1)
    key = lambda: rng.choice([1, 1, 2, 3, None])
    left = [(k, key(), rng.choice([None, *range(60)])) for k in range(300)] + [(9, 1, 30), (9, 1, 30)]
    right = [(key(), rng.choice([None, *range(0, 60, 3)]), rng.choice([None, "a", "b"]), k) for k in range(120)] + [(1, 12, None, None)] * 2
    a, b = spark.createDataFrame(left, "id long, k int, t int"), spark.createDataFrame(right, "k int, s int, v string, w long")
    want = []
    for r in left:
        known = [x for x in right if x[0] is not None and x[0] == r[1] and x[1] is not None and r[2] is not None and x[1] <= r[2]]
        best = max(known, key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or 0), default=(None,) * 4)
        want.append((*r, *best[1:]))
    for many in (10**6, 25):
        out = history.as_of(a, b, ["k"], "t", "s", many)
        assert out.columns == ["id", "k", "t", "s", "v", "w"]
        assert rows(out) == sorted(want, key=str)
    days = lambda df, c: df.withColumn(c, F.date_add(F.lit("2024-01-01").cast("date"), F.col(c)))
    dated = history.as_of(days(a, "t"), days(b, "s"), ["k"], "t", "s", 25).select("id", "k", F.datediff("t", F.lit("2024-01-01")), F.datediff("s", F.lit("2024-01-01")), "v", "w")
    assert rows(dated) == sorted(want, key=str)
    assert history.as_of(a.limit(0), b, ["k"], "t", "s").count() == 0
    assert rows(history.as_of(a, b.limit(0), ["k"], "t", "s")) == sorted(((*r, None, None, None) for r in left), key=str)


def test_stretches_are_even(spark):
    events = spark.range(10_000).selectExpr("IF(id % 10 = 0, 2, 1) AS k", "CAST(id AS DOUBLE) AS _ticks")
    (cut,) = history._cuts(events, ["k"], 1_000).collect()
    assert cut.k == 1 and len(cut._cuts) == 8
    sizes = Counter(sum(c < t for c in cut._cuts) for t in range(10_000) if t % 10)
    assert len(sizes) == 9 and max(sizes.values()) < 1_200


def test_overlaps_report_each_pair_once(spark):
    rng = random.Random(2)
    period = lambda: (lambda s: (s, s + rng.choice([0, 1, 2, 7, 300, 5000, -3])))(rng.randint(-50, 50))
    a = [(k, rng.choice([1, 1, 2, None]), *period()) for k in range(80)] + [(900, 1, None, 5), (901, 1, -10**9, 10**9), (7, 1, 0, 4), (7, 1, 0, 4)]
    b = [(k, rng.choice([1, 2, 2, None]), *period()) for k in range(80)] + [(900, 1, 3, None), (901, 1, 0, 1)]
    x, y = spark.createDataFrame(a, "x long, k int, s long, e long"), spark.createDataFrame(b, "y long, k int, u long, w long")
    want = Counter((p[0], q[0]) for p in a for q in b if p[1] == q[1] is not None and None not in (*p[2:], *q[2:]) and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3])
    out = history.overlaps(x, y, ["k"], ("s", "e"), ("u", "w"))
    assert out.columns == ["x", "k", "s", "e", "y", "u", "w"]
    assert Counter((r.x, r.y) for r in out.collect()) == want
    assert history.overlaps(x.limit(0), y, ["k"], ("s", "e"), ("u", "w")).count() == 0


def test_long_periods_lie_in_few_cells(spark):
    long = spark.createDataFrame([(0.0, 10.0**9), (5.0, 6.0), (0.0, 0.001)], "s double, e double")
    laid = history._laid(long.withColumn("k", F.lit(1)), "s", "e", [0, 7, 20, 30])
    assert laid.groupBy("s", "e").count().agg(F.max("count")).first()[0] <= 2 * 5


def test_snapshot_changes(spark, tmp_path):
    old = [(1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0), (3, None, 3.0), (4, "d", None), (None, "n", 1.0), (6, "f", 1.0)]
    new = [(1, "a", 1.5), (2, "b", 2.0), (3, None, 3.0), (4, "x", 4.0), (None, "n", 1.0), (5, "e", 5.0), (5, "e", 5.0), (6, "f", 1.0), (6, "g", 1.0)]
    for name, data in (("old", old), ("new", new)):
        history.keep_snapshot(spark.createDataFrame(data, "k int, t string, v double"), ["k"], f"{tmp_path}/{name}", 8)
    out = history.snapshot_changes(spark, f"{tmp_path}/old", f"{tmp_path}/new", ["k"])
    got = sorted((r.k, r.change, r.fields, r.n, r.old and tuple(r.old), r.new and tuple(r.new)) for r in out.collect())
    assert got == [(1, "changed", ["v"], 1, old[0], new[0]), (2, "gone", [], 1, old[1], None), (4, "changed", ["t", "v"], 1, old[4], new[3]), (5, "new", [], 2, None, new[5]), (6, "new", [], 1, None, new[8])]


def test_empty_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, t string")
    for name, data in (("none", df.limit(0)), ("one", df)):
        history.keep_snapshot(data, ["k"], f"{tmp_path}/{name}")
    changes = lambda a, b: [(r.k, r.change) for r in history.snapshot_changes(spark, f"{tmp_path}/{a}", f"{tmp_path}/{b}", ["k"]).collect()]
    assert changes("none", "none") == changes("one", "one") == []
    assert changes("none", "one") == [(1, "new")] and changes("one", "none") == [(1, "gone")]


def test_equal_ranges_are_not_read(spark, tmp_path):
    old = spark.range(5_000).selectExpr("id AS k", "id * 2 AS v")
    new = old.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    for name, df in (("old", old), ("same", old.orderBy(F.desc("k"))), ("new", new)):
        history.keep_snapshot(df, ["k"], f"{tmp_path}/{name}", 256)
    assert history.unequal_ranges(spark, f"{tmp_path}/old", f"{tmp_path}/same") == []
    (one,) = history.unequal_ranges(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert history.snapshot_changes(spark, f"{tmp_path}/old", f"{tmp_path}/same", ["k"]).count() == 0
    # the other ranges' files could be gone
    for name in ("old", "new"):
        for folder in (tmp_path / name / "rows").glob("_range=*"):
            if folder.name != f"_range={one}":
                for file in folder.iterdir():
                    file.write_bytes(b"")
    out = history.snapshot_changes(spark, f"{tmp_path}/old", f"{tmp_path}/new", ["k"]).collect()
    assert [(r.k, r.change, r.old.v, r.new.v) for r in out] == [(77, "changed", 154, -1)]


def test_sketches_roll_up_within_their_bounds(spark):
    start = dt.date(2024, 1, 1)
    rng = random.Random(6)
    data = [(rng.choice("abc"), rng.choice(["ph", None]), start + dt.timedelta(days=rng.randint(0, 5)), f"street {rng.randint(0, 6000)}", rng.choice([None, rng.uniform(0, 1000)])) for _ in range(20_000)]
    df = spark.createDataFrame(data, "district string, kind string, day date, address string, price double")
    by = ["district", "kind"]
    stored = summaries.sketched(df, [*by, "day"], "address", "price")
    out = summaries.estimates(summaries.rolled_up(stored, by, [by, ["district"], []]), [0.1, 0.5, 0.9]).collect()
    assert Counter(r.level for r in out) == {"district,kind": 6, "district": 3, "": 1}
    for r in out:
        own = [d for d in data if (r.level == "" or d[0] == r.district) and ("kind" not in r.level or d[1] == r.kind)]
        prices = sorted(d[4] for d in own if d[4] is not None)
        assert (r.rows, r["values"], r.least, r.largest) == (len(own), len(prices), prices[0], prices[-1])
        exact = len({d[3] for d in own})
        assert abs(r.distinct - exact) <= 0.06 * exact
        for share, got in ((0.1, r.q10), (0.5, r.q50), (0.9, r.q90)):
            assert abs(sum(p <= got for p in prices) / len(prices) - share) < 0.03
    none = summaries.estimates(summaries.rolled_up(summaries.sketched(df.withColumn("price", F.lit(None).cast("double")), [*by, "day"], "address", "price"), by, [[]]), [0.5]).first()
    assert none["values"] == 0 and none.q50 is None and none.rows == 20_000


def test_exact_counts_and_shares_by_sets(spark):
    rows = [(d, z, a, p) for d, z, a, p in [("x", "1", 1, 5.0), ("x", "1", 1, 7.0), ("x", "2", 2, None), (None, "2", 1, 9.0), (None, "2", None, 1.0), ("y", None, 3, 2.0)]]
    df = spark.createDataFrame(rows, "district string, zone string, address long, price double")
    by, sets = ["district", "zone"], [["district", "zone"], ["district"], []]
    groups = lambda s: {tuple(r[by.index(c)] if c in s else None for c in by) for r in rows}
    own = lambda s, g: [r for r in rows if all(r[by.index(c)] == g[by.index(c)] for c in s)]
    want = {(*g, ",".join(s)): len({r[2] for r in own(s, g)} - {None}) for s in sets for g in groups(s)}
    found = summaries.distinct_counts(df, by, sets, "address")
    assert {(r.district, r.zone, r.level): r.distinct for r in found.collect()} == want
    # an aggregate beside the distinct one would be made anew for each value
    assert "percentile" not in found._jdf.queryExecution().toString() and "sketch" not in found._jdf.queryExecution().toString()
    marks = spark.createDataFrame([(*g, float(5 + len(g[2]) % 3)) for g in want], "district string, zone string, level string, mark double")
    got = {(r.district, r.zone, r.level): (r.below, r.up_to) for r in summaries.shares(df, by, sets, marks, "price", "mark").collect()}
    prices = lambda s, g: [r[3] for r in own(s, g) if r[3] is not None]
    mark = lambda s: float(5 + len(",".join(s)) % 3)
    assert got == {(*g, ",".join(s)): (sum(p < mark(s) for p in prices(s, g)), sum(p <= mark(s) for p in prices(s, g))) for s in sets for g in groups(s)}


def test_the_query_of_sketches_has_no_quantiles_beside_distinct_counts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from hearthframe import queries

    monkeypatch.setattr(F, "percentile_approx", lambda *_: 1 / 0)
    assert queries.q48_rolled_up_sketches(spark, "/root/testdata/sf0.001").where("NOT median_near OR NOT distinct_near").count() == 0


def test_the_query_of_sketches_stores_them_by_day(spark, monkeypatch):
    from hearthframe import queries

    sf, stored, rolled_up = "/root/testdata/sf0.001", [], summaries.rolled_up
    monkeypatch.setattr(summaries, "rolled_up", lambda df, *a: rolled_up(stored.append(df) or df, *a))
    queries.q48_rolled_up_sketches(spark, sf)
    rows = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    want = rows.groupBy("c_mktsegment", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day")).count().collect()
    assert len({r.day for r in want}) > 100
    assert Counter((r.segment, r.priority, r.day, r.rows) for r in stored[0].collect()) == Counter(map(tuple, want))


def test_the_query_of_sketches_on_groups_without_prices(spark, tmp_path):
    import duckdb

    from hearthframe import queries

    spark.createDataFrame([(1, "A"), (2, None)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(11, 1, dt.datetime(2000, 1, 1), 5.0, "x"), (22, 1, dt.datetime(2000, 1, 2), 6.0, "x"), (3, 2, dt.datetime(2000, 1, 2), 7.0, None), (4, 2, None, None, "y"), (5, 9, None, 1.0, "x")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    name = "q48_rolled_up_sketches"
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(con.sql(queries.ORACLE_SQL[name]).fetchall())


def test_keys_of_few_rows_are_joined_without_a_lattice(spark, monkeypatch):
    rng = random.Random(12)
    rows = lambda n: [(rng.choice([1, 1, 1, 2, 3, None]), b, b + rng.choice([0, 1, 5, 60])) for b in (rng.randint(0, 80) for _ in range(n))]
    left, right = rows(40), rows(40)
    x, y = spark.createDataFrame(left, "k long, s long, e long"), spark.createDataFrame(right, "k long, u long, w long")
    want = sorted((k, s, e, u, w) for k, s, e in left for q, u, w in right if k is not None and k == q and s < e and u < w and s < w and u < e)
    for few in (25, 0):
        assert sorted(map(tuple, history.overlaps(x, y, ["k"], ("s", "e"), ("u", "w"), few=few).collect())) == want
    monkeypatch.setattr(history, "_laid", lambda *_: 1 / 0)
    assert sorted(map(tuple, history.overlaps(x, y, ["k"], ("s", "e"), ("u", "w")).collect())) == want
