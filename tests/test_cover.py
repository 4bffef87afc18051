import math
import random

import numpy as np

from hearthframe.operators import cover
from hearthframe.operators.joins import join_split


def star(rng, x, y, n, size):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + math.cos(t) * size * rng.uniform(0.3, 1), y + math.sin(t) * size * rng.uniform(0.3, 1)) for t in turns]


def sides_of(rings):
    return [(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True) if a != b]


def brute(points, polygons):
    out = []
    for p in points:
        for pid, rings in polygons:
            if p[1] is None or p[2] is None:
                continue
            hit = on = 0
            for x1, y1, x2, y2 in sides_of(rings):
                if (y1 > p[2]) != (y2 > p[2]):
                    hit += p[1] < (x2 - x1) * (p[2] - y1) / (y2 - y1) + x1
                turn = (x2 - x1) * (p[2] - y1) - (y2 - y1) * (p[1] - x1)
                on |= turn == 0 and min(x1, x2) <= p[1] <= max(x1, x2) and min(y1, y2) <= p[2] <= max(y1, y2)
            if hit % 2 and not on:
                out.append((*p, pid))
    return sorted(out, key=str)


def tables(spark, points, polygons):
    rows = [(i, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in polygons]
    return spark.createDataFrame(points, "id long, x double, y double, level string"), spark.createDataFrame(rows, "pid string, rings array<array<struct<x:double,y:double>>>")


def test_within_against_all_sides(spark):
    rng = random.Random(2)
    polygons = [(f"p{k}", [star(rng, rng.uniform(0, 90), rng.uniform(0, 90), rng.choice([3, 8, 60]), rng.uniform(1, 40))]) for k in range(25)]
    polygons += [("hole", [[(0, 0), (64, 0), (64, 64), (0, 64)], [(16, 16), (48, 16), (48, 48), (16, 48)]]), ("sliver", [[(0, 0), (90, 1e-7), (90, 2e-7)]]), ("line", [[(5, 5), (9, 9)]]), (None, [[(1, 1), (3, 1), (2, 3)]])]
    points = [(k, rng.uniform(-9, 99), rng.uniform(-9, 99), "a") for k in range(400)]
    points += [(900 + k, float(x), float(y), "b") for k, (x, y) in enumerate([(0, 0), (16, 20), (32, 32), (64, 64), (8, 8), (2, 2), (16, 16), (48, 60), (32, 0)])]
    points += [(7, 2.0, 2.0, "c"), (7, 2.0, 2.0, "c"), (8, None, 1.0, None), (None, 2.0, 2.5, "d")]
    p, q = tables(spark, points, polygons)
    out = cover.within(p, q, "pid")
    assert out.columns == ["id", "x", "y", "level", "pid"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(points, polygons)
    assert cover.within(p.limit(0), q, "pid").count() == cover.within(p, q.limit(0), "pid").count() == 0


def test_inner_points_meet_no_side(spark):
    rng = random.Random(3)
    ring = [(50 + 40 * math.cos(k * math.pi / 500), 50 + 40 * math.sin(k * math.pi / 500)) for k in range(1000)]
    points = [(k, rng.uniform(20, 80), rng.uniform(20, 80), None) for k in range(600)]
    p, q = tables(spark, points, [("circle", [ring])])
    square = (10.0, 10.0, 80.1)
    made = cover.covered(q, "pid", square)
    rows = cover.tried(p, made, square).collect()
    inner = [r for r in rows if r.inner]
    assert all(r.sides == [] for r in inner) and len(inner) > 0.8 * len(rows)
    assert all(len(r.sides) <= cover.SIDES for r in rows)
    assert {r.id for r in rows if r.inside} == {k for k, *_ in ((b[0],) for b in brute(points, [("circle", [ring])]))}


def test_cells_cover_the_polygon_once():
    rng = random.Random(4)
    sides = np.array(sides_of([star(rng, 5, 5, 40, 5)]))
    found = list(cover.cells(sides, 0.0, 0.0, 10.0))
    for _ in range(300):
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        held = [c for c in found if c[1] == x // (10 / 2 ** c[0]) and c[2] == y // (10 / 2 ** c[0])]
        assert len(held) <= 1
        inside = cover._hits(sides, x, y) % 2 == 1
        assert inside == bool(held and (held[0][3] or (held[0][4] + cover._hits(held[0][5], x, y)) % 2))


def test_small_polygons_have_small_cells():
    """A square of few sides in a large map is not met by points from all over it."""
    sides = np.array(sides_of([[(50, 50), (51, 50), (51, 51), (50, 51)]]), float)
    found = list(cover.cells(sides, 0.0, 0.0, 1000.0))
    area = sum((1000.0 / 2 ** c[0]) ** 2 for c in found)
    assert len(found) < 200 and area < 4


def test_split_join(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS k")
    side = spark.range(60).selectExpr("id AS k", "id * 2 AS v").union(spark.range(5).selectExpr("id + 5 AS k", "id AS v"))
    want = rows.join(side, "k").count()
    out = join_split(rows, side, ["k"], "id", many=100)
    assert out.columns == ["k", "id", "v"] and out.count() == want == out.distinct().count()


def test_polygons_are_cut_together_as_alone():
    rng = random.Random(11)
    shapes = []
    for _ in range(40):
        x, y, r, n = rng.uniform(5, 95), rng.uniform(5, 95), rng.uniform(0.01, 5), rng.randint(1, 40)
        ring = [(x + r * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        shapes.append(np.array([(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]))
    starts = np.cumsum([0, *map(len, shapes)])[:-1]
    together = {k: [] for k in range(len(shapes))}
    calls = 0
    for level, own, cx, cy, inner, odd, many, kept in cover.cut(np.concatenate(shapes), starts, 0.0, 0.0, 100.0):
        calls += 1
        ends = np.cumsum(many)
        for k in range(len(own)):
            together[own[k]].append((level, cx[k], cy[k], inner, odd[k], sorted(map(tuple, kept[ends[k] - many[k] : ends[k]]))))
    alone = {k: [(*c[:5], sorted(map(tuple, c[5]))) for c in cover.cells(s, 0.0, 0.0, 100.0)] for k, s in enumerate(shapes)}
    assert {k: sorted(v) for k, v in together.items()} == {k: sorted(v) for k, v in alone.items()}
    # levels and not polygons times cells
    assert calls <= 2 * (cover.DEPTH + 1)


def test_points_of_one_place_are_tested_once_and_counted_without_pairs(spark, monkeypatch):
    square = lambda x, y: [[{"x": x, "y": y}, {"x": x + 4.0, "y": y}, {"x": x + 4.0, "y": y + 4.0}, {"x": x, "y": y + 4.0}]]
    q = spark.createDataFrame([(k, square(float(k % 5), float(k // 5))) for k in range(25)], "pid long, rings array<array<struct<x:double,y:double>>>")
    p = spark.createDataFrame([(k // 2, k % 7 + 0.5 if k % 50 else None, k % 3 + 0.25) for k in range(600)], "id long, x double, y double")
    seen, tried = [], cover.tried
    monkeypatch.setattr(cover, "tried", lambda points, *a, **b: seen.append(points.count()) or tried(points, *a, **b))
    got = cover.within(p, q, "pid")
    want = sorted((r.id, k) for r in p.collect() if r.x is not None for k in range(25) if k % 5 < r.x < k % 5 + 4 and k // 5 < r.y < k // 5 + 4)
    assert got.columns == ["id", "x", "y", "pid"] and sorted((r.id, r.pid) for r in got.collect()) == want
    assert seen[0] <= 24
    assert cover.counts(p, q, "pid") == (600, len(want))
    assert cover.counts(p, q.limit(0), "pid") == (600, 0) and cover.counts(p.limit(0), q, "pid") == (0, 0)
