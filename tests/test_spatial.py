import heapq
import json
import math
import random

from pyspark.sql import functions as F

from hearthframe import queries
from hearthframe.operators import geocode, metrics, network, spatial
from hearthframe.plans import urls
from hearthframe.sources import files

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
HOLE = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]


def polygons(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, rings array<array<struct<x:double,y:double>>>")


def test_within(spark):
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, 10.0, 5.0), (5, 0.0, 0.0), (6, 5.0, 4.0), (7, None, None), (8, 1.0, 9.0)], "id int, x double, y double")
    for ring in (SQUARE, SQUARE[::-1], [*SQUARE, SQUARE[0]]):
        got = spatial.within(pts, polygons(spark, ("a", [ring, HOLE]), ("b", [ring])), "name", 3.0)
        assert sorted((r.id, r.name) for r in got.collect()) == [(1, "a"), (1, "b"), (2, "b"), (6, "b"), (8, "a"), (8, "b")]


def test_projection_against_haversine_and_back(spark):
    pts = spark.createDataFrame([(k, -58.5 + k * 0.01, -34.65 + k * 0.008) for k in range(12)], "id int, lon double, lat double")
    x, y = spatial.project(F.col("lon"), F.col("lat"))
    lon, lat = spatial.unproject(F.col("x"), F.col("y"))
    rows = pts.select("id", "lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).orderBy("id").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        flat = math.hypot(a.x - b.x, a.y - b.y)
        p, q = math.radians(a.lat), math.radians(b.lat)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        assert abs(flat / (2 * 6371008.8 * math.asin(math.sqrt(h))) - 1) < 0.005
        assert abs(a.lon - a.lon2) < 1e-9 and abs(a.lat - a.lat2) < 1e-9
    assert 5_600_000 < rows[0].x < 5_700_000 and 6_100_000 < rows[0].y < 6_200_000


def test_nearest(spark):
    rng = random.Random(1)
    pts = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(60)] + [(99, 5000.0, -700.0), (98, None, None)]
    nodes = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(40)] + [(50, 1.0, 1.0), (51, 1.0, 1.0)]
    got = {r.id: (r.node_id, r.d) for r in spatial.nearest(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(nodes, "node_id int, x double, y double"), 2.0).collect()}
    assert set(got) == {p[0] for p in pts if p[1] is not None}
    for k, x, y in pts:
        if x is not None:
            assert got[k][0] == min((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, a, b in nodes)[1]
    none = spatial.nearest(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame([], "node_id int, x double, y double"), 2.0)
    assert none.count() == 0


def test_centroid(spark):
    shapes = polygons(spark, ("square", [SQUARE]), ("hole", [SQUARE, [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]]), ("line", [[(0.0, 0.0), (2.0, 2.0)]]))
    x, y = spatial.centroid(F.col("rings"))
    got = {r.name: (r.x, r.y) for r in shapes.select("name", x.alias("x"), y.alias("y")).collect()}
    assert got["square"] == (5, 5) and got["line"] == (1, 1)
    assert abs(got["hole"][0] - (500 - 8) / 96) < 1e-9


def dijkstra(links, start, cutoff):
    out, heap = {}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in out:
            out[n] = d
            for m, w in links.get(n, []):
                if d + w <= cutoff:
                    heapq.heappush(heap, (d + w, m))
    return out


def test_reach_against_heap(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 40), rng.randint(0, 40), float(rng.randint(0, 9))) for _ in range(90)]
    both = edges + [(b, a, w) for a, b, w in edges]
    links = {}
    for a, b, w in both:
        links.setdefault(a, []).append((b, w))
    got = {}
    origins = spark.createDataFrame([(k,) for k in [*range(0, 41, 5), 5, 777]], "node int")
    for r in network.reach(origins, spark.createDataFrame(both, "src int, dst int, w double"), 12.0).collect():
        got.setdefault(r.origin, {})[r.node] = r.d
    assert got == {k: dijkstra(links, k, 12.0) for k in [*range(0, 41, 5), 777]}


def test_graph_and_metrics(spark):
    p = lambda x, y: (float(x), float(y))
    lines = spark.createDataFrame([([[p(0, 0), p(0, 3), p(4, 3)], [p(4, 3), p(4, 5)]],), ([[p(0, 0), p(4, 3)]],)], "parts array<array<struct<x:double,y:double>>>")
    nodes, links = network.graph(lines)
    at = {(r.x, r.y): r.node_id for r in nodes.collect()}
    assert set(at) == {(0, 0), (4, 3), (4, 5)}
    w = {(r.src, r.dst): r.w for r in links.collect()}
    assert len(w) == 4 and w[at[0, 0], at[4, 3]] == 5 and w[at[4, 5], at[4, 3]] == 2
    homes = spark.createDataFrame([("h", at[0, 0]), ("far", 1)], "id string, node long")
    targets = spark.createDataFrame([("gym", at[4, 3]), ("gym", at[4, 3]), ("gym", at[4, 5]), ("plaza", at[0, 0])], "layer string, node long")
    got = {r.id: r for r in metrics.by_layer(homes, network.reach(homes, links, 6.9), targets).collect()}
    assert (got["h"].distancia_m_gym, got["h"].cant_gym, got["h"].distancia_m_plaza, got["h"].cant_subte) == (5, 1, 0, 0)
    assert got["far"].distancia_m_gym is None and got["far"].cant_gym == 0


def test_layers_and_geojson(spark, tmp_path):
    layer = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": 1, "linea": "A "}, "geometry": {"type": "Point", "coordinates": [-58.4, -34.6]}},
        {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}},
        {"type": "Feature", "properties": {"id": 3}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}},
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(layer, indent=1))
    a, b, c = files.read_geojson(spark, f"{tmp_path}/l.geojson", ["id", "linea"]).orderBy("id").collect()
    assert (a.x, a.y, a.linea, a.parts) == (-58.4, -34.6, "A ", None) and b.parts == [[(0, 0), (1, 2)]] and len(c.parts) == 2
    points = spark.createDataFrame([("a", 1, -58.0, -34.0), (None, 2, None, -34.0)], "name string, n int, lon double, lat double")
    files.write_geojson_lines(points.coalesce(1), f"{tmp_path}/out")
    made = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert made[0] == {"type": "Feature", "properties": {"name": "a", "n": 1}, "geometry": {"type": "Point", "coordinates": [-58.0, -34.0]}}
    assert made[1]["geometry"] is None and made[1]["properties"]["name"] is None
    assert metrics.legend(spark).count() == 7
    tips = points.withColumnRenamed("name", "Portal").select(metrics.tooltip(points.withColumnRenamed("name", "Portal")).alias("t")).first().t
    assert [(t.label, t.value) for t in tips] == [("Portal:", "a")]


def test_geocoding(spark):
    dim = spark.createDataFrame([("Calle 1  , Ciudad Autónoma de Buenos Aires, Argentina", 1.0, 2.0), ("Calle 1  , Ciudad Autónoma de Buenos Aires, Argentina", 9.0, 9.0)], "full_address string, lat double, lon double")
    rows = spark.createDataFrame([(1, "Calle 1 CABA", None, None), (2, "Calle 1 CABA", 5.0, 6.0), (3, "Otra", 7.0, None), (4, None, None, None)], "id int, Direccion string, lat double, lon double")
    got = {r.id: (r.lat, r.lon) for r in geocode.filled(rows, "Direccion", dim).collect()}
    assert got == {1: (1.0, 2.0), 2: (5.0, 6.0), 3: (None, None), 4: (None, None)}
    assert geocode.located(geocode.filled(rows, "Direccion", dim)).count() == 2


def test_search_plan(spark):
    plan = urls.search_plan(spark)
    got = {(r.barrio, r.tipo, r.portal): r.url for r in plan.collect()}
    assert len(got) == 48
    assert got["palermo", "ph", "zonaprop"] == "https://www.zonaprop.com.ar/ph-alquiler-palermo-desde-1-hasta-2-habitaciones-desde-2-hasta-3-ambientes-mas-35-m2-cubiertos-350000-800000-pesos.html"
    assert got["villa-urquiza", "departamento", "argenprop"].endswith("?*-300000-expensas&con-ambiente-balcon&solo-ver-pesos")
    assert "villa_urquiza" in got["villa-urquiza", "ph", "cabaprop"]
    assert sorted(map(str, urls.flat_plan(urls.nested_plan(plan)).collect())) == sorted(map(str, plan.collect()))


def test_within_meets_near_polygons_only(spark):
    shapes = [(f"p{k}", [[(x + 20.0 * k, y) for x, y in SQUARE]]) for k in range(6)]
    rng = random.Random(8)
    rows = [(k, rng.uniform(-5, 125), rng.uniform(-2, 12)) for k in range(300)]
    want = sorted((k, f"p{int(x // 20)}") for k, x, y in rows if 0 <= x <= 120 and x % 20 < 10 and 0 < y < 10)
    got = spatial.within(spark.createDataFrame(rows, "id int, x double, y double"), polygons(spark, *shapes), "name", 3.0)
    assert sorted((r.id, r.name) for r in got.collect()) == want


def test_parts_there_and_back(spark):
    lines = polygons(spark, ("l", [[(-58.4, -34.6), (-58.39, -34.61)], [(-58.5, -34.7), (-58.5, -34.71)]]))
    metres = lines.select("name", spatial.project_parts(F.col("rings")).alias("rings"))
    nodes, links = network.graph(metres, "rings")
    assert nodes.count() == 4 and 1_000 < max(r.w for r in links.collect()) < 2_000
    back = metres.select(spatial.project_parts(F.col("rings"), spatial.unproject).alias("r")).first().r
    assert abs(back[0][1].x + 58.39) < 1e-9 and abs(back[1][0].y + 34.7) < 1e-9


def test_real_layers_end_to_end(spark, tmp_path):
    """Streets in degrees to metres, graph, snapped listings and centroids, distances by layer, on GeoJSON."""
    street = lambda *at: {"type": "Feature", "properties": {"id": "s"}, "geometry": {"type": "LineString", "coordinates": [list(p) for p in at]}}
    lon, lat, step = -58.40, -34.60, 0.003
    grid = [street((lon + step * i, lat), (lon + step * (i + 1), lat)) for i in range(3)]
    park = {"type": "Feature", "properties": {"id": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[lon + 2 * step - 0.0002, lat], [lon + 2 * step + 0.0002, lat], [lon + 2 * step, lat + 0.0004]]]}}
    for name, features in (("streets", grid), ("parks", [park])):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    streets, parks = (files.read_geojson(spark, f"{tmp_path}/{n}.geojson", ["id"]).withColumn("parts", spatial.project_parts(F.col("parts"))) for n in ("streets", "parks"))
    nodes, links = network.graph(streets)
    cx, cy = spatial.centroid(F.col("parts"))
    targets = spatial.nearest(parks.select("id", cx.alias("x"), cy.alias("y")), nodes, 50.0).select(F.lit("parque").alias("layer"), F.col("node_id").alias("node"))
    x, y = spatial.project(F.col("lon"), F.col("lat"))
    home = spark.createDataFrame([("h", lon + 0.0001, lat)], "id string, lon double, lat double").select("id", x.alias("x"), y.alias("y"))
    homes = spatial.nearest(home, nodes, 50.0).select("id", F.col("node_id").alias("node"))
    row = metrics.by_layer(homes, network.reach(homes, links, metrics.CUTOFF), targets).first()
    assert 540 < row.distancia_m_parque < 560 and row.cant_parque == 1 and row.distancia_m_gym is None


def test_map_layers_and_collection(spark, tmp_path):
    area = spark.createDataFrame([("n", "parque")], "nombre string, cat string")
    point = spark.createDataFrame([("SportClub", "Centro", "#003366", -58.4, -34.6, 350_000)], "cadena string, nombre string, color_map string, lon double, lat double, costo_total long")
    layers = metrics.map_layers(area, area, point, point, point, point)
    rows = {k: df.first() for k, df in layers.items()}
    assert list(rows) == ["Barrios", "Espacios Verdes", "Líneas Subte", "Estaciones de Subte", "Gimnasios", "Departamentos"]
    assert rows["Barrios"].style.color == "black" and rows["Espacios Verdes"].style.fillColor == "#2ca25f" and rows["Líneas Subte"].style.color == "#003366"
    assert rows["Estaciones de Subte"].style.radius == 4 and rows["Gimnasios"].popup == "SportClub: Centro" and rows["Departamentos"].style.fillColor == "#91cf60"
    metrics.write_layers(layers, f"{tmp_path}/map")
    assert spark.read.parquet(f"{tmp_path}/map/5").first().layer == "Departamentos"
    files.write_geojson(point, f"{tmp_path}/gyms.geojson")
    made = json.loads((tmp_path / "gyms.geojson").read_text())
    assert made["type"] == "FeatureCollection" and made["features"][0]["geometry"]["coordinates"] == [-58.4, -34.6]
    assert files.read_chain(spark, f"{tmp_path}/gyms.geojson").first().lat == -34.6
    files.write_geojson(point.limit(0), f"{tmp_path}/none.geojson")
    assert json.loads((tmp_path / "none.geojson").read_text())["features"] == []
    twice = point.select("nombre", "costo_total", "nombre", *(c.alias(n) for c, n in zip(spatial.project(F.col("lon"), F.col("lat")), "xy", strict=True)))
    shown = metrics.for_map(twice, ("x", "y"))
    assert shown.columns == ["nombre", "costo_total", "lon", "lat"] and abs(shown.first().lon + 58.4) < 1e-9


def test_geocoding_goes_on_where_it_stopped(spark, tmp_path):
    full = lambda k: f"Calle {k}, Ciudad Autónoma de Buenos Aires, Argentina"
    dim = spark.createDataFrame([(full(k), float(k), -float(k)) for k in range(6)], "full_address string, lat double, lon double")
    rows = spark.createDataFrame([(k, f"Calle {k}", None, None) for k in range(8)], "id int, Direccion string, lat double, lon double")
    first = geocode.filled_durably(rows.where("id < 3"), "Direccion", dim, f"{tmp_path}/known", 2)
    assert {r.id: r.lat for r in first.collect()} == {0: 0.0, 1: 1.0, 2: 2.0}
    again = geocode.filled_durably(rows, "Direccion", dim.where("lat > 2"), f"{tmp_path}/known", 2)
    assert {r.id: r.lat for r in again.collect()} == {**{k: float(k) for k in range(6)}, 6: None, 7: None}
    later = geocode.filled_durably(rows, "Direccion", spark.createDataFrame([(full(6), 6.0, 0.0), (full(0), 99.0, 0.0)], "full_address string, lat double, lon double"), f"{tmp_path}/known", 2)
    assert {r.id: r.lat for r in later.collect()} == {**{k: float(k) for k in range(7)}, 7: None}


def test_parts_are_projected_by_expressions_without_repeats(spark):
    rows = spark.createDataFrame([([[(-58.4, -34.6), (-58.38, -34.61)], [(-58.5, -34.7)]],), (None,), ([[(None, 1.0)], []],)], "p array<array<struct<x:double,y:double>>>")
    there = spatial.project_parts(F.col("p"))
    back = spatial.project_parts(F.col("m"), spatial.unproject)
    # a lambda computes an expression as often as it is written there
    assert str(there).lower().count("atanh") <= 3 and str(back).lower().count("atanh") <= 1
    made = rows.select("p", there.alias("m")).select("p", "m", back.alias("b")).collect()
    flat = spark.createDataFrame([(x, y) for r in made for part in r.p or [] for x, y in part], "lon double, lat double")
    x, y = spatial.project(F.col("lon"), F.col("lat"))
    assert [tuple(p) for r in made for part in r.m or [] for p in part] == [tuple(r) for r in flat.select(x, y).collect()]
    lon, lat = spatial.unproject(F.col("x"), F.col("y"))
    want = [tuple(r) for r in flat.select(x.alias("x"), y.alias("y")).select(lon, lat).collect()]
    assert [tuple(p) for r in made for part in r.b or [] for p in part] == want
    assert made[1].m is None and made[2].b == [[(None, None)], []]


def test_nearest_meets_crowded_cells_in_arrays(spark, monkeypatch):
    rng = random.Random(8)
    nodes = [(k, rng.choice([50.0, 50.0001 + k / 1e6, rng.uniform(0, 100)]), rng.choice([50.0, 50.0001])) for k in range(1_500)]
    points = [(k, rng.uniform(49.9, 50.1), rng.uniform(49.9, 50.1)) for k in range(300)] + [(300, 0.0, 0.0), (301, None, 1.0)]
    seen = []
    joined = spatial.join_cells
    monkeypatch.setattr(spatial, "PACK", 16)
    monkeypatch.setattr(spatial, "join_cells", lambda rows, side, *a: seen.append((rows.count(), side)) or joined(rows, side, *a))
    got = spatial.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(nodes, "node_id long, x double, y double"), 5.0)
    want = {i: min((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, a, b in nodes) for i, x, y in points if x is not None}
    found = {r.id: (r.d, r.node_id) for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[i][0] - want[i][0]) < 1e-12 and found[i][1] == want[i][1] for i in want)
    # a point meets arrays and not each of the nodes around it
    for _, side in seen:
        assert side.groupBy("cx", "cy").count().agg({"count": "max"}).first()[0] <= 3 * 1_500 / 16


def test_nearest_deals_out_points_of_one_task(spark, monkeypatch):
    joined, tasks = spatial.join_cells, []
    monkeypatch.setattr(spatial, "join_cells", lambda rows, side, *a: tasks.append(rows.rdd.getNumPartitions()) or joined(rows, side, *a))
    points = spark.range(400).selectExpr("id", "id % 20 + 0.25D AS x", "id % 7 + 0.25D AS y").coalesce(1)
    nodes = spark.range(140).selectExpr("id AS node_id", "id % 20 + 0D AS x", "id % 7 + 0D AS y")
    got = {r.id: r.node_id for r in spatial.nearest(points, nodes, 2.0).collect()}
    assert got == {k: k % 140 for k in range(400)}
    assert min(tasks) > 1


def test_listing_metrics_find_districts_once(spark, monkeypatch):
    asked, nearest = [], spatial.nearest
    monkeypatch.setattr(spatial, "nearest", lambda points, *a: asked.append(points) or nearest(points, *a))
    df = queries.q28_listing_metrics(spark, "/root/testdata/sf0.001")
    # the result reads the written homes, not the sides of districts again, and other points aren't snapped
    read = {f.rsplit("/", 2)[1].split("-")[0] for f in df.inputFiles()}
    assert "homes" in read and not read & {"sides", "cells"}
    assert asked[0].distinct().count() == df.select("id").distinct().count()
