import heapq
import random

from hearthframe.operators import network


def dijkstra(origins, links, cutoff):
    out = []
    for o in sorted({o for o in origins if o is not None}):
        best, heap = {}, [(0.0, o)]
        while heap:
            d, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = d
            for a, b, w in links:
                if a == n and w is not None and d + w <= cutoff and b is not None:
                    heapq.heappush(heap, (d + w, b))
        out += [(o, n, d) for n, d in best.items()]
    return sorted(out)


def tables(spark, origins, links, nodes):
    return spark.createDataFrame([(o,) for o in origins], "node long"), spark.createDataFrame(links, "src long, dst long, w double"), spark.createDataFrame(nodes, "node_id long, x double, y double")


def test_random_graphs_against_a_heap(spark):
    rng = random.Random(8)
    for size in (1, 5):
        n = 40
        nodes = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(n - 2)] + [(n - 2, None, None)]
        links = [(rng.randrange(n), rng.randrange(n), float(rng.randint(0, 6))) for _ in range(110)] + [(3, 4, 2.0), (3, 4, 1.0), (None, 4, 1.0), (5, None, 1.0), (5, 6, None)]
        origins = [0, 1, 1, None, n - 1, 200] + list(range(10, 20))
        o, e, v = tables(spark, origins, links, nodes)
        got = sorted(tuple(r) for r in network.reach_by_cells(o, e, v, 9.0, size).collect())
        assert got == dijkstra(origins, links, 9.0)


def test_rounds_are_cells_not_links(spark):
    """A chain of 300 links is gone through in as many rounds as it has cells, and gives what reach() gives."""
    chain = [(k, k + 1, 1.0) for k in range(300)] + [(k + 1, k, 1.0) for k in range(300)]
    o, e, v = tables(spark, [0, 150], chain, [(k, float(k), 0.0) for k in range(301)])
    cells = network.curve_cells(v, 64)
    assert cells.groupBy("cell").count().where("count > 64").isEmpty() and cells.count() == 301
    found, rounds = network.settled(o, e, cells, 250.0)
    assert rounds <= 16
    assert sorted(map(tuple, found.collect())) == dijkstra([0, 150], chain, 250.0)


def test_many_ways_into_one_cell(spark, monkeypatch):
    monkeypatch.setattr(network, "WAYS", 7)
    star = [(k, 0, 1.0) for k in range(1, 60)] + [(0, k, 1.0) for k in range(1, 60)]
    origins = list(range(60))
    o, e, v = tables(spark, origins, star, [(k, 0.0, 0.0) for k in range(60)])
    assert sorted(tuple(r) for r in network.reach_by_cells(o, e, v, 2.0, 100).collect()) == dijkstra(origins, star, 2.0)


def test_empty(spark):
    o, e, v = tables(spark, [1], [(1, 2, 1.0)], [(1, 0.0, 0.0)])
    assert network.reach_by_cells(o.limit(0), e, v, 5.0).count() == 0
    assert [tuple(r) for r in network.reach_by_cells(o, e.limit(0), v.limit(0), 5.0).collect()] == [(1, 1, 0.0)]
