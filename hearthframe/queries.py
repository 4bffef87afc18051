"""Queries of the listing engine over the driver's tables, each with its SQL counterpart.

The tables hold no listings or coordinates, so each query derives them from keys, the same way on both
sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.operators import clean, cover, geocode, history, joins, metrics, network, spatial, summaries, unify
from hearthframe.plans import urls
from hearthframe.schema import PORTAL_COLUMNS
from hearthframe.sources import files, html, layers, legacy, workbook
from hearthframe.staging import stage, stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text -----------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM (
  SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM documents)
""")
def q01_clean_text(spark, sf):
    t = X.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN contains(lower(s), 'estrenar') THEN '0' ELSE regexp_replace(s, '[^0-9]', '', 'g') END AS digits
FROM (SELECT o_orderkey, coalesce(o_orderpriority, '') || CASE WHEN o_custkey % 4 = 0 THEN ' A Estrenar' WHEN o_custkey % 4 = 1 THEN ', 45,5 m²' ELSE '' END AS s FROM orders)
""")
def q02_force_int(spark, sf):
    tail = F.when(F.col("o_custkey") % 4 == 0, F.lit(" A Estrenar")).when(F.col("o_custkey") % 4 == 1, F.lit(", 45,5 m²")).otherwise(F.lit(""))
    return table(spark, sf, "orders").select("o_orderkey", X.force_int(F.concat(F.coalesce("o_orderpriority", F.lit("")), tail)).alias("digits"))


@query("""
SELECT source, count(*) AS n, CAST(sum(CASE WHEN contains(u, 'USD') OR contains(u, 'U$S') OR contains(u, 'DOLARES') OR contains(u, 'US$') THEN 1 ELSE 0 END) AS BIGINT) AS in_dollars
FROM (SELECT source, upper(coalesce(text, '')) || CASE doc_id % 5 WHEN 0 THEN ' U$S 900' WHEN 1 THEN ' 900 DÓLARES' WHEN 2 THEN ' USD' ELSE '' END AS u FROM documents) GROUP BY source
""")
def q03_currency_filter(spark, sf):
    tail = F.when(F.col("doc_id") % 5 == 0, F.lit(" u$s 900")).when(F.col("doc_id") % 5 == 1, F.lit(" 900 dólares")).when(F.col("doc_id") % 5 == 2, F.lit(" usd")).otherwise(F.lit(""))
    usd = X.is_usd(F.concat(F.coalesce("text", F.lit("")), tail))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(usd).alias("in_dollars"))


@query(r"""
SELECT p_partkey, CASE WHEN regexp_extract(s, '(?i)(\d+)\s*amb', 1) <> '' THEN regexp_extract(s, '(?i)(\d+)\s*amb', 1)
  WHEN contains(lower(s), 'dos amb') THEN '2' WHEN contains(lower(s), 'tres amb') THEN '3' WHEN contains(lower(s), 'cuatro amb') THEN '4' ELSE '' END AS rooms
FROM (SELECT p_partkey, p_name || ' ' || CAST(p_size AS VARCHAR) || CASE p_size % 5 WHEN 0 THEN ' Ambientes' WHEN 1 THEN 'amb' WHEN 2 THEN ' m2 Tres amb.' WHEN 3 THEN ' dos ambientes' ELSE ' un ambiente' END AS s FROM part)
""")
def q04_number_before_word(spark, sf):
    k = F.col("p_size") % 5
    tail = F.when(k == 0, F.lit(" Ambientes")).when(k == 1, F.lit("amb")).when(k == 2, F.lit(" m2 Tres amb.")).when(k == 3, F.lit(" dos ambientes")).otherwise(F.lit(" un ambiente"))
    return table(spark, sf, "part").select("p_partkey", X.rooms_in(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), tail)).alias("rooms"))


@query("""
SELECT p_partkey, regexp_matches(p_name, '[0-9]') AS name_digit, regexp_matches(p_brand, '[0-9]') AS brand_digit, trim(split_part(p_brand, '#', 1)) AS lead FROM part
""")
def q05_digit_flag_split(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.has_digit(F.col("p_name")).alias("name_digit"), X.has_digit(F.col("p_brand")).alias("brand_digit"), X.first_part(F.col("p_brand"), "#").alias("lead"))


@query("""
SELECT page_id, CAST(nth - 1 AS BIGINT) AS place, CASE WHEN starts_with(href, '/') THEN 'https://www.zonaprop.com.ar' || href ELSE href END AS url FROM (
  SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS nth FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages))
""".replace("\\\\", "\\"))
def q06_url_absolutise(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("place", "href"))
    return found.select("page_id", F.col("place").cast("long"), X.absolute_url(F.col("href"), html.HOSTS["zonaprop"]).alias("url"))


@query("""
SELECT n_nationkey, array_to_string(list_transform(string_split(replace(slug, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
  CASE WHEN slug = 'barrio-norte' THEN 'recoleta' ELSE slug END AS recoded, trim(replace(line, 'LINEA ', '')) AS line,
  CASE trim(replace(line, 'LINEA ', '')) WHEN 'A' THEN '#00AEEF' WHEN 'B' THEN '#ED1C24' WHEN 'C' THEN '#0054A6' WHEN 'D' THEN '#00802F' WHEN 'E' THEN '#662D91' WHEN 'H' THEN '#FFD100' END AS color
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'barrio-norte' ELSE lower(replace(n_name, ' ', '-')) END AS slug, 'LINEA ' || chr(65 + n_nationkey % 9) || ' ' AS line FROM nation)
""")
def q07_recode_title(spark, sf):
    slug = F.when(F.col("n_nationkey") % 5 == 0, F.lit("barrio-norte")).otherwise(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))))
    line = X.without(F.concat(F.lit("LINEA "), F.char(65 + F.col("n_nationkey") % 9), F.lit(" ")), "LINEA ")
    return table(spark, sf, "nation").select("n_nationkey", X.title_case(slug).alias("title"), X.recode(slug, {"barrio-norte": "recoleta"}).alias("recoded"), line.alias("line"), X.lookup(line, geocode.LINE_COLORS).alias("color"))


@query("""
SELECT doc_id FROM (
  SELECT doc_id, rooms, t, replace(t, ' ', '') AS c FROM (
    SELECT doc_id, CAST(doc_id % 4 AS VARCHAR) AS rooms,
      lower(coalesce(source, 'nan') || ' ' || CASE WHEN doc_id % 5 = 0 THEN 'nan' ELSE coalesce(text, 'nan') END || ' ' || CAST(doc_id % 4 AS VARCHAR)) AS t FROM documents))
WHERE NOT (contains(t, 'on the') OR contains(c, 'onthe') OR contains(t, 'en de') OR contains(c, 'ende') OR contains(t, '1 amb') OR contains(c, '1amb') OR rooms = '1')
""")
def q08_exclusion_filter(spark, sf):
    info = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    out = clean.is_excluded(F.col("source"), info, (F.col("doc_id") % 4).cast("string"), ["on the", "en de", "1 amb"])
    return table(spark, sf, "documents").where(~out).select("doc_id")


@query("""
SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN '$ ' ELSE '' END || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders)
WHERE regexp_full_match(price, '[0-9]+') AND CASE WHEN regexp_full_match(price, '[0-9]+') THEN CAST(price AS BIGINT) END BETWEEN 10000 AND 999999
""")
def q09_range_filter(spark, sf):
    price = F.concat(F.when(F.col("o_custkey") % 6 == 0, F.lit("$ ")).otherwise(F.lit("")), F.floor("o_totalprice").cast("bigint").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", price.alias("price")).where(clean.is_valid_price(F.col("price")))


# --- deduplication, union, casts ------------------------------------------------------------------


@query("SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q10_keep_first(spark, sf):
    return clean.keep_first(table(spark, sf, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS k FROM events)
SELECT k, min(event_id) AS event_id FROM e WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT k, event_id FROM e WHERE k IS NULL
""")
def q11_keep_first_null_exempt(spark, sf):
    keyed = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("k"))
    return clean.keep_first(keyed, ["k"], ["event_id"], null_exempt=True).select("k", "event_id")


def _parties(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return unify.union_all([c, s])


_PARTIES = """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, CAST(NULL AS INTEGER) AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, NULL, s_nationkey FROM supplier"""


@query(_PARTIES)
def q12_union_by_name(spark, sf):
    return _parties(spark, sf)


@query(f"""
WITH p AS ({_PARTIES})
SELECT 'id' AS "column", 'bigint' AS type, CAST(count(*) - count(id) AS BIGINT) AS nulls FROM p UNION ALL SELECT 'name', 'string', count(*) - count(name) FROM p
UNION ALL SELECT 'segment', 'string', count(*) - count(segment) FROM p UNION ALL SELECT 'balance', 'double', count(*) - count(balance) FROM p UNION ALL SELECT 'nation', 'int', count(*) - count(nation) FROM p
""")
def q13_null_profile(spark, sf):
    return unify.null_profile(_parties(spark, sf))


@query("""
SELECT event_id, coalesce(CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN try_cast(s AS BIGINT) END, CASE WHEN try_cast(s AS DOUBLE) = floor(try_cast(s AS DOUBLE)) THEN CAST(try_cast(s AS DOUBLE) AS BIGINT) END) AS n
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN k || '.0' WHEN 2 THEN k || '.5' WHEN 3 THEN 'x' || k END AS s FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events))
""")
def q14_lenient_cast(spark, sf):
    k, m = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    s = F.when(m == 0, k).when(m == 1, F.concat(k, F.lit(".0"))).when(m == 2, F.concat(k, F.lit(".5"))).when(m == 3, F.concat(F.lit("x"), k))
    return table(spark, sf, "events").select("event_id", unify.lenient_long(s).alias("n"))


@query("""
SELECT o_orderkey, CAST(CAST(try_strptime(s, '%d/%m/%Y') AS DATE) AS VARCHAR) AS day FROM (
  SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '31/02/2024' WHEN 1 THEN 'ayer' ELSE strftime(o_orderdate, '%-d/%-m/%Y') END AS s FROM orders)
""")
def q15_dayfirst_date(spark, sf):
    m = F.col("o_orderkey") % 10
    s = F.when(m == 0, F.lit("31/02/2024")).when(m == 1, F.lit("ayer")).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", unify.day_first(s).cast("string").alias("day"))


@query(r"""
SELECT portal, max_by(path, (regexp_extract(path, '(\d{4}-\d{2}-\d{2})', 1), path)) AS path FROM (
  SELECT 'p' || CAST(o_custkey % 3 AS VARCHAR) AS portal, 'data/p' || CAST(o_custkey % 3 AS VARCHAR) || '/p_' || CASE WHEN o_orderkey % 9 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END || '.csv' AS path FROM orders) GROUP BY portal
""")
def q16_latest_snapshot(spark, sf):
    portal = F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string"))
    day = F.when(F.col("o_orderkey") % 9 == 0, F.lit("undated")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    paths = table(spark, sf, "orders").select(portal.alias("portal"), F.concat(F.lit("data/"), portal, F.lit("/p_"), day, F.lit(".csv")).alias("path"))
    return unify.latest(paths, by=["portal"])


# --- the search plan and output -------------------------------------------------------------------


def _plan(spark, sf) -> DataFrame:
    slugs = spark.createDataFrame([(p, t, x) for (p, t), x in urls.SLUGS.items()], "portal string, tipo string, slug string")
    barrios = table(spark, sf, "nation").select(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("barrio"), F.explode(F.array(*map(F.lit, urls.TIPOS))).alias("tipo"))
    return barrios.join(F.broadcast(slugs), "tipo").select("barrio", "tipo", "portal", urls.portal_url(F.col("portal"), F.col("slug"), F.col("barrio"), F.col("tipo")).alias("url"))


_PLAN = """
SELECT barrio, tipo, portal, CASE portal
  WHEN 'zonaprop' THEN 'https://www.zonaprop.com.ar/' || concat_ws('-', CASE tipo WHEN 'ph' THEN 'ph' ELSE 'departamentos' END, 'alquiler', barrio, CASE WHEN tipo <> 'ph' THEN 'con-balcon' END, 'desde-1-hasta-2-habitaciones', 'desde-2-hasta-3-ambientes', 'mas-35-m2-cubiertos', '350000-800000-pesos') || '.html'
  WHEN 'argenprop' THEN 'https://www.argenprop.com/' || CASE tipo WHEN 'ph' THEN 'ph' ELSE 'departamentos' END || '/alquiler/' || barrio || '/pesos-350000-800000?' || concat_ws('&', '*-300000-expensas', CASE WHEN tipo <> 'ph' THEN 'con-ambiente-balcon' END, 'solo-ver-pesos')
  ELSE 'https://cabaprop.com.ar/propiedades/' || concat_ws('-', 'alquilar', tipo, replace(barrio, '-', '_'), 'pesos_desde_350000_hasta_800000', 'superficieCubierta_desde_35', 'ambientes_2_3', 'dormitorios_1_2') || '?pagina=1' END AS url
FROM (SELECT lower(replace(n_name, ' ', '-')) AS barrio FROM nation), (VALUES ('departamento'), ('ph')) t(tipo), (VALUES ('zonaprop'), ('argenprop'), ('cabaprop')) p(portal)
"""


@query(_PLAN)
def q17_cross_url_plan(spark, sf):
    return _plan(spark, sf)


@query("""
SELECT o_orderkey, cost, CASE WHEN cost IS NULL THEN '#808080' WHEN cost >= 0 AND cost < 300000 THEN '#1a9850' WHEN cost >= 300000 AND cost < 400000 THEN '#91cf60' WHEN cost >= 400000 AND cost < 500000 THEN '#d9ef8b'
  WHEN cost >= 500000 AND cost < 600000 THEN '#fee08b' WHEN cost >= 600000 AND cost < 700000 THEN '#fc8d59' WHEN cost >= 700000 AND cost < 800000 THEN '#d73027' ELSE '#67000d' END AS color
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN -1 ELSE CAST(floor(o_totalprice * 3) AS BIGINT) END + coalesce(CASE WHEN o_custkey % 3 = 0 THEN 100000 END, 0) AS cost FROM orders)
""")
def q18_bins_style(spark, sf):
    price = F.when(F.col("o_custkey") % 10 == 1, F.lit(-1).cast("long")).when(F.col("o_custkey") % 10 != 0, F.floor(F.col("o_totalprice") * 3))
    cost = metrics.total_cost(price, F.when(F.col("o_custkey") % 3 == 0, F.lit(100_000).cast("long")))
    return table(spark, sf, "orders").select("o_orderkey", cost.alias("cost")).select("o_orderkey", "cost", metrics.band(F.col("cost")).alias("color"))


@query("""
SELECT c_custkey, 'Feature' AS kind, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Point' END AS shape, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(-58 AS DOUBLE) - c_custkey % 64 / 64.0 END AS lon FROM customer
""")
def q19_geojson_feature(spark, sf):
    lon = F.when(F.col("c_custkey") % 4 != 0, -58.0 - F.col("c_custkey") % 64 / 64.0)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", lon.alias("lon"), F.lit(-34.5).alias("lat"))
    at = lambda path: F.get_json_object("j", path)
    return rows.select("c_custkey", files.feature(["c_custkey", "c_name"]).alias("j")).select("c_custkey", at("$.type").alias("kind"), at("$.properties.c_name").alias("name"), at("$.geometry.type").alias("shape"), at("$.geometry.coordinates[0]").cast("double").alias("lon"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages""".replace("\\\\", "\\"))
def q20_html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(html.links(F.col("html"))).cast("long").alias("links"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang FROM pages""")
def q21_html_title_lang(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.lang(F.col("html")).alias("lang"))


# --- space ----------------------------------------------------------------------------------------

#: Two polygons: a concave one, and a square with a hole.
POLYGONS = [
    ("ele", [[(10, 10), (60, 12), (58, 30), (30, 28), (28, 80), (9, 78)]]),
    ("hueco", [[(40, 40), (95, 42), (93, 95), (38, 90)], [(55, 55), (75, 56), (74, 76), (54, 75)]]),
]


def _polygons(spark) -> DataFrame:
    rows = [(n, [[(float(x), float(y)) for x, y in r] for r in rings]) for n, rings in POLYGONS]
    return spark.createDataFrame(rows, "nombre string, rings array<array<struct<x:double,y:double>>>")


def _sides_sql() -> str:
    rows = [f"('{n}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, rings in POLYGONS for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]
    return f"(SELECT pid, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1, CAST(x2 AS DOUBLE) x2, CAST(y2 AS DOUBLE) y2 FROM (VALUES {', '.join(rows)}) v(pid, x1, y1, x2, y2))"


def _customer_points(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), ((k * 37 % 1000) / 10.0 + 0.037).alias("x"), ((k * 91 % 1000) / 10.0 + 0.061).alias("y"))


_CUSTOMER_POINTS = "(SELECT c_custkey AS id, (c_custkey * 37 % 1000) / CAST(10 AS DOUBLE) + CAST(0.037 AS DOUBLE) AS x, (c_custkey * 91 % 1000) / CAST(10 AS DOUBLE) + CAST(0.061 AS DOUBLE) AS y FROM customer)"
_INSIDE = f"""SELECT id, pid FROM {_CUSTOMER_POINTS} p JOIN {_sides_sql()} s ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, pid HAVING count(*) % 2 = 1"""


@query(f"SELECT id, pid AS nombre FROM ({_INSIDE})")
def q22_point_in_polygon(spark, sf):
    return spatial.within(_customer_points(spark, sf), _polygons(spark), "nombre", 5.0).select("id", "nombre")


def _lonlat(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (-58.6 + k % 100 / 500.0).alias("lon"), (-34.8 + k * 7 % 100 / 500.0).alias("lat"))


def _projection_sql() -> str:
    radius, alpha, _ = spatial._series()
    e = math.sqrt(spatial.FLATTENING * (2 - spatial.FLATTENING))
    num = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    east = " + ".join(["eta", *(f"{num(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    north = " + ".join(["xi", *(f"{num(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))])
    return f"""
WITH p AS (SELECT c_custkey AS id, CAST(-58.6 AS DOUBLE) + c_custkey % 100 / CAST(500 AS DOUBLE) AS lon, CAST(-34.8 AS DOUBLE) + c_custkey * 7 % 100 / CAST(500 AS DOUBLE) AS lat FROM customer),
a AS (SELECT id, radians(lon + 60) AS turn, sinh(atanh(sin(radians(lat))) - {num(e)} * atanh({num(e)} * sin(radians(lat)))) AS t FROM p),
b AS (SELECT id, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM a)
SELECT id, round(5500000 + {num(radius)} * ({east}), 3) AS x, round({num(radius)} * ({north}) + {num(radius * math.pi / 2)}, 3) AS y FROM b"""


@query(_projection_sql())
def q23_project_tm(spark, sf):
    x, y = spatial.project(F.col("lon"), F.col("lat"))
    return _lonlat(spark, sf).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _supplier_nodes(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("node_id"), (k * 53 % 997 / 10.0).alias("x"), (k * 29 % 991 / 10.0).alias("y"))


_SUPPLIER_NODES = "(SELECT s_suppkey AS node_id, s_suppkey * 53 % 997 / CAST(10 AS DOUBLE) AS x, s_suppkey * 29 % 991 / CAST(10 AS DOUBLE) AS y FROM supplier)"
_SNAP = f"SELECT id, min_by(node_id, (d, node_id)) AS node_id, min(d) AS d FROM (SELECT id, node_id, sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) AS d FROM {_CUSTOMER_POINTS} p, {_SUPPLIER_NODES} n) GROUP BY id"


@query(f"SELECT id, node_id, round(d, 6) AS d FROM ({_SNAP})")
def q24_nearest_node(spark, sf):
    return spatial.nearest(_customer_points(spark, sf), _supplier_nodes(spark, sf), 5.0).select("id", "node_id", F.round("d", 6).alias("d"))


@query("""
WITH l AS (SELECT CAST(c_custkey % 50 AS DOUBLE) ax, CAST(c_custkey * 7 % 50 AS DOUBLE) ay, CAST(c_custkey * 3 % 50 AS DOUBLE) bx, CAST(c_custkey * 11 % 50 AS DOUBLE) by_, CAST(c_custkey * 5 % 50 AS DOUBLE) mx, CAST(c_custkey * 13 % 50 AS DOUBLE) my FROM customer),
w AS (SELECT *, sqrt(pow(ax - mx, 2) + pow(ay - my, 2)) + sqrt(pow(mx - bx, 2) + pow(my - by_, 2)) AS w FROM l),
b AS (SELECT ax, ay, bx, by_ AS "by", w FROM w UNION ALL SELECT bx, by_, ax, ay, w FROM w)
SELECT ax, ay, bx, "by", round(min(w), 6) AS w FROM b GROUP BY ax, ay, bx, "by"
""")
def q25_graph_edges(spark, sf):
    k = F.col("c_custkey")
    at = lambda a, b: F.struct((k * a % 50).cast("double").alias("x"), (k * b % 50).cast("double").alias("y"))
    nodes, links = network.graph(table(spark, sf, "customer").select(F.array(F.array(at(1, 7), at(5, 13), at(3, 11))).alias("parts")))
    a, b = (nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")) for n, p in (("src", "a"), ("dst", "b")))
    return links.join(a, "src").join(b, "dst").select("ax", "ay", "bx", "by", F.round("w", 6).alias("w"))


def _part_links(spark, sf) -> DataFrame:
    w = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("w"))
    return w.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"), "w").union(w.select(-F.col("l_suppkey"), "l_partkey", "w"))


_REACH = """
RECURSIVE w AS (SELECT l_partkey AS p, -l_suppkey AS s, min(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
links AS (SELECT p AS src, s AS dst, w FROM w UNION ALL SELECT s, p, w FROM w),
walk AS (SELECT p_partkey AS origin, p_partkey AS node, CAST(0 AS DOUBLE) AS d FROM part UNION SELECT origin, dst, d + w FROM walk JOIN links ON node = src WHERE d + w <= 3),
reached AS (SELECT origin, node, min(d) AS d FROM walk GROUP BY origin, node)
"""


@query(f"WITH {_REACH} SELECT origin, node, d FROM reached")
def q26_bounded_reach(spark, sf):
    return network.reach(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), _part_links(spark, sf), 3.0)


_LAYER = "CASE p_size % 5 WHEN 0 THEN 'gym' WHEN 1 THEN 'subte' WHEN 2 THEN 'parque' WHEN 3 THEN 'plaza' END"


def _wide_sql(layers: list[str]) -> str:
    return ", ".join(f"CAST(floor(min(CASE WHEN layer = '{n}' THEN d END)) AS BIGINT) AS distancia_m_{n}, CAST(count(CASE WHEN layer = '{n}' THEN 1 END) AS BIGINT) AS cant_{n}" for n in layers)


@query(f"""
WITH {_REACH}, targets AS (SELECT p_partkey AS node, {_LAYER} AS layer FROM part)
SELECT p_partkey AS id, {_wide_sql(metrics.LAYERS)} FROM part LEFT JOIN (SELECT origin, layer, d FROM reached JOIN targets USING (node)) h ON p_partkey = h.origin GROUP BY p_partkey
""")
def q27_reach_min_count(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_size") % 5
    layer = F.when(k == 0, F.lit("gym")).when(k == 1, F.lit("subte")).when(k == 2, F.lit("parque")).when(k == 3, F.lit("plaza"))
    targets = part.select(layer.alias("layer"), F.col("p_partkey").alias("node"))
    reached = network.reach(part.select(F.col("p_partkey").alias("node")), _part_links(spark, sf), 3.0)
    return metrics.by_layer(part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("node")), reached, targets).drop("node")


def _streets(spark, sf) -> DataFrame:
    """Links between neighbouring suppliers, by the whole metres between them."""
    n = _supplier_nodes(spark, sf)
    pairs = n.select("*", F.explode(F.array(F.lit(1), F.lit(7))).alias("step")).withColumn("to", F.col("node_id") + F.col("step"))
    m = n.select(F.col("node_id").alias("to"), F.col("x").alias("bx"), F.col("y").alias("by"))
    w = pairs.join(m, "to").select(F.col("node_id").alias("src"), F.col("to").alias("dst"), F.floor(F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2))).cast("double").alias("w"))
    return w.union(w.select("dst", "src", "w"))


_FLAGSHIP_CUTOFF = 120.0


@query(f"""
WITH RECURSIVE nodes AS {_SUPPLIER_NODES}, one AS (SELECT a.node_id AS src, b.node_id AS dst, floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS w FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1 OR b.node_id = a.node_id + 7),
links AS (SELECT src, dst, w FROM one UNION ALL SELECT dst, src, w FROM one),
inside AS ({_INSIDE}), snapped AS ({_SNAP}), homes AS (SELECT i.id, i.pid, s.node_id FROM inside i JOIN snapped s ON i.id = s.id),
walk AS (SELECT DISTINCT node_id AS origin, node_id AS node, CAST(0 AS DOUBLE) AS d FROM homes UNION SELECT origin, dst, d + w FROM walk JOIN links ON node = src WHERE d + w <= {_FLAGSHIP_CUTOFF}),
reached AS (SELECT origin, node, min(d) AS d FROM walk GROUP BY origin, node),
hits AS (SELECT origin, d, CASE s_suppkey % 5 WHEN 0 THEN 'gym' WHEN 1 THEN 'subte' WHEN 2 THEN 'parque' WHEN 3 THEN 'plaza' END AS layer FROM reached JOIN supplier ON node = s_suppkey),
m AS (SELECT h.id, h.pid, {_wide_sql(metrics.LAYERS)} FROM homes h LEFT JOIN hits t ON h.node_id = t.origin GROUP BY h.id, h.pid),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(floor(abs(c_acctbal) * 90) AS BIGINT) END + coalesce(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 50 AS BIGINT) * 1000 END, 0) AS costo_total FROM customer)
SELECT m.*, costo_total, CASE WHEN costo_total IS NULL THEN '#808080' WHEN costo_total < 300000 THEN '#1a9850' WHEN costo_total < 400000 THEN '#91cf60' WHEN costo_total < 500000 THEN '#d9ef8b'
  WHEN costo_total < 600000 THEN '#fee08b' WHEN costo_total < 700000 THEN '#fc8d59' WHEN costo_total < 800000 THEN '#d73027' ELSE '#67000d' END AS color
FROM (SELECT id, pid AS "Barrio", * EXCLUDE (id, pid) FROM m) m JOIN c ON c_custkey = m.id
""")
def q28_listing_metrics(spark, sf):
    """Listings in districts, snapped to street nodes, with network distances and counts by layer, cost and price band."""
    # written: origins, distances and the result read them, and only points in a district are snapped
    inside = stage(spatial.within(_customer_points(spark, sf), _polygons(spark).withColumnRenamed("nombre", "Barrio"), "Barrio", 5.0), "inside")
    snapped = spatial.nearest(inside.select("id", "x", "y"), _supplier_nodes(spark, sf), 5.0).select("id", F.col("node_id").alias("node"))
    homes = stage(inside.select("id", "Barrio").join(snapped, "id"), "homes")
    k = F.col("s_suppkey") % 5
    layer = F.when(k == 0, F.lit("gym")).when(k == 1, F.lit("subte")).when(k == 2, F.lit("parque")).when(k == 3, F.lit("plaza"))
    targets = table(spark, sf, "supplier").select(layer.alias("layer"), F.col("s_suppkey").alias("node"))
    reached = network.reach(homes.select("node"), _streets(spark, sf), _FLAGSHIP_CUTOFF)
    found = metrics.by_layer(homes, reached, targets).drop("node")
    price = F.when(F.col("c_custkey") % 11 != 0, F.floor(F.abs("c_acctbal") * 90))
    cost = metrics.total_cost(price, F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 50 * 1000))
    costs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), cost.alias("costo_total"))
    return found.join(costs, "id").withColumn("color", metrics.band(F.col("costo_total")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def q29_semi_in(spark, sf):
    wanted = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey")).distinct()
    return table(spark, sf, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey")


@query("""
WITH a AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS DOUBLE) END AS lat, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN CAST(-c_custkey AS DOUBLE) END AS lon FROM customer)
SELECT c_custkey, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat WHEN n.n_nationkey IS NOT NULL THEN CAST(n_nationkey AS DOUBLE) END AS lat, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon WHEN n.n_nationkey IS NOT NULL THEN CAST(-n_nationkey AS DOUBLE) END AS lon
FROM a LEFT JOIN nation n ON c_nationkey = n_nationkey AND n_regionkey <> 2
""")
def q30_incremental_fill(spark, sf):
    address = F.concat(F.lit("Calle "), F.col("n_name"), F.lit(" 100 - CABA"))
    nations = table(spark, sf, "nation")
    full = F.concat(F.lit("Calle "), F.col("n_name"), F.lit(" 100  "), F.lit(X.ADDRESS_TAIL))
    dimension = nations.where("n_regionkey <> 2").select(full.alias("full_address"), F.col("n_nationkey").cast("double").alias("lat"), (-F.col("n_nationkey")).cast("double").alias("lon"))
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(nations.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", address.alias("Direccion"), F.when(k % 3 == 0, k.cast("double")).alias("lat"), F.when((k % 3 == 0) | (k % 7 == 0), (-k).cast("double")).alias("lon"))
    return geocode.filled(rows, "Direccion", dimension).select("c_custkey", "lat", "lon")


# --- listings from pages --------------------------------------------------------------------------


def _cards(spark, sf) -> DataFrame:
    """One captured page for each customer, with one card in the markup of one of the portals."""
    k = F.col("c_custkey")
    price = F.floor(F.abs("c_acctbal") * 90).cast("string")
    zona = F.concat(
        F.lit('<div class="x postingCardLayout-module__posting-card-layout__1"><div class="postingPrices-module__price__9">$ '), price, F.lit('<span class="discount-1"> 5%</span></div><span class="postingPrices-module__expenses">$ 1.500 Expensas</span>'),
        F.lit('<h3 class="postingCard-module__posting-description"><a href="/p/'), k.cast("string"), F.lit('">Calle '), k.cast("string"), F.lit(' - lindo</a></h3><div class="postingLocations-module__location-address">Av. Sin numero</div>'),
        F.lit('<span class="postingMainFeatures-module__posting-main-features-span">45 m² tot.</span><span class="postingMainFeatures-module__posting-main-features-span">3 amb.</span></div>'),
    )
    argen = F.concat(
        F.lit('<div class="listing__item"><a href="/d/'), k.cast("string"), F.lit('"><p class="card__price">$ '), price, F.lit(' + 900 exp</p><span class="card__expenses">+ $ 900</span><p class="card__address">Calle 1</p><h2 class="card__title">Depto 2 ambientes</h2><p class="card__info">Lindo</p>'),
        F.lit('<ul class="card__main-features"><li>40 m²</li><li>a estrenar</li></ul></a></div>'),
    )
    caba = F.concat(
        F.lit('<div class="cards"><span class="lc-price-normal">'), F.when(k % 2 == 0, F.lit("USD ")).otherwise(F.lit("$ ")), price, F.lit('</span><div class="tc_content"><h4>Tres ambientes</h4><p><strong>Palermo</strong> Gorriti 4000 <br>fondo</p><div class="badge_icon"><img alt="Casa SA"></div></div>'),
        F.lit('<ul class="prop_details"><li>2 Dorm</li><li>60 Total</li></ul><a href="https://cabaprop.com.ar/x/'), k.cast("string"), F.lit('">ver</a><span>Publicado el 05/03/2024</span></div>'),
    )
    portal = F.element_at(F.array(F.lit("zonaprop"), F.lit("argenprop"), F.lit("cabaprop")), (k % 3 + 1).cast("int"))
    page = F.when(k % 3 == 0, zona).when(k % 3 == 1, argen).otherwise(caba)
    return joins.spread(table(spark, sf, "customer")).select(portal.alias("portal"), F.lit("palermo").alias("barrio"), F.when(k % 5 == 0, F.lit("ph")).otherwise(F.lit("departamento")).alias("tipo"), F.lit(1).alias("page_no"), k.alias("seq"), page.alias("html"))


_LISTINGS = """
WITH c AS (SELECT c_custkey AS k, CAST(CAST(floor(abs(c_acctbal) * 90) AS BIGINT) AS VARCHAR) AS price FROM customer WHERE NOT (c_custkey % 3 = 2 AND c_custkey % 2 = 0))
SELECT k AS seq, CASE k % 3 WHEN 0 THEN 'zonaprop' WHEN 1 THEN 'argenprop' ELSE 'cabaprop' END AS portal, CASE WHEN k % 5 = 0 THEN 'PH' ELSE 'Departamento' END AS tipo, price,
  CASE k % 3 WHEN 0 THEN '1500' WHEN 1 THEN '900' END AS expensas, CASE k % 3 WHEN 0 THEN 'Calle ' || k WHEN 1 THEN 'Calle 1' ELSE 'Gorriti 4000' END AS direccion,
  CASE k % 3 WHEN 0 THEN '3' WHEN 1 THEN '2' ELSE '3' END AS ambientes, CASE k % 3 WHEN 0 THEN '45' WHEN 2 THEN '60' END AS totales, CASE k % 3 WHEN 1 THEN '0' END AS antiguedad, CASE k % 3 WHEN 0 THEN '5%' END AS rebaja,
  CASE k % 3 WHEN 2 THEN 'Casa SA' END AS inmobiliaria, CASE k % 3 WHEN 2 THEN '05/03/2024' END AS publicado,
  CASE k % 3 WHEN 0 THEN 'https://www.zonaprop.com.ar/p/' || k WHEN 1 THEN 'https://www.argenprop.com/d/' || k ELSE 'https://cabaprop.com.ar/x/' || k END AS url FROM c
"""


@query(_LISTINGS)
def q31_html_listings(spark, sf):
    names = {"Portal": "portal", "Tipo": "tipo", "Precio": "price", "Expensas": "expensas", "Direccion": "direccion", "Ambientes": "ambientes", "Metros_Totales": "totales", "Antiguedad": "antiguedad", "Porcentaje_Rebaja": "rebaja", "Inmobiliaria": "inmobiliaria", "Fecha_Publicacion": "publicado", "URL": "url"}
    return html.raw_listings(_cards(spark, sf)).select("seq", *(F.col(a).alias(b) for a, b in names.items()))


@query(f"""
SELECT portal, count(*) AS n, CAST(sum(CAST(price AS BIGINT)) AS BIGINT) AS total, min(CAST(CASE WHEN publicado IS NOT NULL THEN DATE '2024-03-05' END AS VARCHAR)) AS first_day FROM ({_LISTINGS}) WHERE CAST(price AS BIGINT) BETWEEN 10000 AND 999999 GROUP BY portal
""")
def q32_listing_table(spark, sf):
    kept = clean.cleaned(clean.first_labels(html.raw_listings(_cards(spark, sf))))
    out = unify.typed(clean.ordered(kept))
    return out.groupBy(F.col("Portal").alias("portal")).agg(F.count("*").alias("n"), F.sum("Precio").alias("total"), F.min(F.col("Fecha_Publicacion").cast("string")).alias("first_day"))


@query("""
SELECT c_custkey AS id, round((0 + c_custkey % 10 + 3 + 5) / CAST(3 AS DOUBLE), 6) AS x, round((0 + 2 + c_custkey % 13 + 20) / CAST(3 AS DOUBLE), 6) AS y FROM customer
""")
def q33_centroid(spark, sf):
    k = F.col("c_custkey")
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "cast") else y.cast("double").alias("y"))
    ring = F.array(p(0, 0), p(k % 10 + 3, 2), p(5, k % 13 + 20))
    x, y = spatial.centroid(F.array(ring))
    return table(spark, sf, "customer").select(k.alias("id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT c_custkey AS id, round(CAST(-58.6 AS DOUBLE) + c_custkey % 100 / CAST(500 AS DOUBLE), 7) AS lon, round(CAST(-34.8 AS DOUBLE) + c_custkey * 7 % 100 / CAST(500 AS DOUBLE), 7) AS lat FROM customer")
def q34_unproject_tm(spark, sf):
    lon, lat = spatial.unproject(F.col("x"), F.col("y"))
    return spatial.projected(_lonlat(spark, sf)).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN 'plaza' ELSE 'parque' END AS cat, CASE p_size % 4 WHEN 2 THEN '#99d8c9' ELSE '#2ca25f' END AS "fillColor" FROM part WHERE p_size % 4 < 3
""")
def q35_green_layers(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["PARQUE", "JARDÍN BOTANICO", "PLAZA", "OTRO"])), (F.col("p_size") % 4 + 1).cast("int"))
    green = metrics.green_spaces(table(spark, sf, "part").select("p_partkey", kind.alias("clasificac")))
    return green.select("p_partkey", "cat", metrics.green_style(F.col("cat")).alias("s")).select("p_partkey", "cat", "s.fillColor")


@query(_PLAN)
def q36_plan_flattened(spark, sf):
    return urls.flat_plan(urls.nested_plan(_plan(spark, sf)))


@query("""
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM (SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders)
""")
def q37_map_export(spark, sf):
    return metrics.for_map(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"))


@query("""
SELECT cadena, nombre, plan, color_map, lat FROM (
  SELECT 'SportClub' AS cadena, s_name AS nombre, 'total' AS plan, '#003366' AS color_map, CAST(s_suppkey AS DOUBLE) AS lat FROM supplier
  UNION ALL SELECT 'Megatlon', c_name, c_mktsegment, '#ff6600', CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey < 20
  UNION ALL SELECT 'Smartfit', n_name, 'black', '#cc0000', CAST(n_nationkey AS DOUBLE) FROM nation WHERE n_nationkey < 20)
""")
def q38_gym_layer(spark, sf):
    address = lambda c: F.concat(F.lit("Calle "), c.cast("string"))
    nation = table(spark, sf, "nation")
    dimension = nation.where("n_nationkey < 20").select(X.full_address(address(F.col("n_nationkey"))).alias("full_address"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(-58.0).alias("lon"))
    chains = {
        "SportClub": table(spark, sf, "supplier").select(F.col("s_name").alias("nombre"), F.lit("total").alias("tipo_plan"), F.lit("x").alias("direccion"), F.col("s_suppkey").cast("double").alias("lat"), F.lit(-58.0).alias("lon")),
        "Megatlon": table(spark, sf, "customer").select(F.col("c_name").alias("Nombre"), address(F.col("c_nationkey")).alias("Dirección"), F.col("c_mktsegment").alias("Plan")),
        "Smartfit": nation.select(F.col("n_name").alias("sede"), address(F.col("n_nationkey")).alias("Dirección"), F.lit("black").alias("smart-ui-text 8")),
    }
    return geocode.gyms(chains, dimension).select("cadena", "nombre", "plan", "color_map", "lat")


@query("""
SELECT s_suppkey AS id, 'Gimnasios' AS layer, CAST(6 AS INTEGER) AS radius, 'black' AS edge, CASE s_suppkey % 3 WHEN 0 THEN '#003366' WHEN 1 THEN '#ff6600' ELSE '#cc0000' END AS fill,
  CASE s_suppkey % 3 WHEN 0 THEN 'SportClub' WHEN 1 THEN 'Megatlon' ELSE 'Smartfit' END || ': ' || s_name AS popup FROM supplier
UNION ALL SELECT c_custkey, 'Estaciones de Subte', 4, 'white', CASE c_custkey % 3 WHEN 0 THEN '#00AEEF' WHEN 1 THEN '#ED1C24' END, NULL FROM customer
""")
def q39_map_layers(spark, sf):
    """Gyms and stations of the assembled map with their markers and popups; the other layers are in tests."""
    pick = lambda key, names: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col(key) % 3 + 1).cast("int"))
    chain = pick("s_suppkey", ["SportClub", "Megatlon", "Smartfit"])
    gyms = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), chain.alias("cadena"), F.col("s_name").alias("nombre"), X.lookup(chain, geocode.GYM_COLORS).alias("color_map"))
    stations = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.lookup(pick("c_custkey", ["A", "B", "Z"]), geocode.LINE_COLORS).alias("color_map"))
    none = spark.createDataFrame([], "nombre string, cat string, color_map string, costo_total long")
    layers = metrics.map_layers(none, none, none, stations, gyms, none)
    shown = [layers[n].withColumn("layer", F.lit(n)) for n in ("Gimnasios", "Estaciones de Subte")]
    both = unify.union_all(shown)
    return both.select("id", "layer", "style.radius", F.col("style.color").alias("edge"), F.col("style.fillColor").alias("fill"), "popup")


@query("""
WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_custkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS portal, CAST(floor(abs(c_acctbal) * 90) AS BIGINT) AS price FROM customer)
SELECT CAST(count(*) AS BIGINT) AS before, CAST(count(CASE WHEN price BETWEEN 10000 AND 999999 THEN 1 END) AS BIGINT) AS after, CAST(count(CASE WHEN price BETWEEN 10000 AND 999999 THEN NULL ELSE 1 END) AS BIGINT) AS removed FROM p
""")
def q40_removed_rows(spark, sf):
    """Rows that cleaning took out, counted on the way through."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        F.when(k % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("Portal"), k.cast("string").alias("URL"), F.floor(F.abs("c_acctbal") * 90).cast("string").alias("Precio"), F.lit("casa").alias("Titulo"),
        F.lit("3").alias("Ambientes"), F.lit("linda").alias("Descripcion_Breve"), k.alias("seq"), F.lit(1).alias("page_no"), F.lit(1).alias("card_no"),
    )
    kept, before, after = clean.cleaned_and_counted(rows)
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(before.get["rows"], after.get["rows"], clean.removed(before, after))], "before long, after long, removed long")


_METRES = """
WITH l AS (SELECT c_custkey AS k, CAST(-58.6 AS DOUBLE) + c_custkey % 100 / CAST(500 AS DOUBLE) AS lon, CAST(-34.8 AS DOUBLE) + c_custkey * 7 % 100 / CAST(500 AS DOUBLE) AS lat FROM customer)
SELECT k AS id, round(lon, 7) AS lon, round(lat, 7) AS lat, CAST(2 AS BIGINT) AS parts FROM l
"""


@query(_METRES)
def q41_project_parts(spark, sf):
    """Lines to metres and back to degrees; the first point of each comes out where it was."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    line = F.array(F.array(at(F.col("lon"), F.col("lat")), at(F.col("lon") + 0.01, F.col("lat"))), F.array(at(F.col("lon"), F.col("lat")), at(F.col("lon"), F.col("lat") + 0.01)))
    metres = joins.spread(_lonlat(spark, sf)).select("id", spatial.project_parts(line).alias("parts"))
    back = stage(metres, "lines").select("id", spatial.project_parts(F.col("parts"), spatial.unproject).alias("parts"))
    first = F.col("parts")[0][0]
    return back.select("id", F.round(first["x"], 7).alias("lon"), F.round(first["y"], 7).alias("lat"), F.size("parts").cast("long").alias("parts"))


# --- many polygons, long ways ----------------------------------------------------------------------

_LONG_CUTOFF = 30.0
_LONG_WAYS = """
RECURSIVE one AS (SELECT a.c_custkey AS src, b.c_custkey AS dst, CAST(CASE WHEN b.c_custkey = a.c_custkey + 1 THEN 1 + a.c_custkey * 7 % 3 ELSE 20 + a.c_custkey % 5 END AS DOUBLE) AS w FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 OR b.c_custkey = a.c_custkey + 40),
links AS (SELECT src, dst, w FROM one UNION ALL SELECT dst, src, w FROM one),
walk AS (SELECT c_custkey AS origin, c_custkey AS node, CAST(0 AS DOUBLE) AS d FROM customer UNION SELECT origin, dst, d + w FROM walk JOIN links ON node = src WHERE d + w <= 30)
"""


@query(f"WITH {_LONG_WAYS} SELECT origin, node, min(d) AS d FROM walk GROUP BY origin, node")
def q42_cell_reach(spark, sf):
    """Shortest ways along a road through all customers, with some short cuts, by graph cells."""
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    nodes = customers.select(k.alias("node_id"), k.cast("double").alias("x"), (k % 2).cast("double").alias("y"))
    ways = customers.select(k.alias("src"), F.explode(F.array(F.struct((k + 1).alias("dst"), (1 + k * 7 % 3).alias("w")), F.struct((k + 40).alias("dst"), (20 + k % 5).alias("w")))).alias("to")).select("src", "to.dst", F.col("to.w").cast("double").alias("w"))
    ways = ways.join(customers.select(k.alias("dst")), "dst").select("src", "dst", "w")
    return network.reach_by_cells(nodes.select(F.col("node_id").alias("node")), ways.union(ways.select("dst", "src", "w")), nodes, _LONG_CUTOFF)


#: Corners of a district around a supplier, in parts of its radius.
_CORNERS = [(-1.0, -1.0), (1.0, -0.5), (0.25, 0.0), (1.0, 1.0), (0.0, 0.25), (-1.0, 1.0)]


def _districts(spark, sf) -> DataFrame:
    r = 3 + F.col("node_id") % 5
    corner = lambda dx, dy: F.struct((F.col("x") + r * dx).alias("x"), (F.col("y") + r * dy).alias("y"))
    return _supplier_nodes(spark, sf).select(F.col("node_id").alias("district"), F.array(F.array(*(corner(*c) for c in _CORNERS))).alias("rings"))


_DISTRICT_SIDES = f"""(SELECT node_id AS district, x + r * ax AS x1, y + r * ay AS y1, x + r * bx AS x2, y + r * by_ AS y2 FROM (SELECT *, 3 + node_id % 5 AS r FROM {_SUPPLIER_NODES}),
  (SELECT CAST(a AS DOUBLE) AS ax, CAST(b AS DOUBLE) AS ay, CAST(c AS DOUBLE) AS bx, CAST(d AS DOUBLE) AS by_ FROM (VALUES {", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True))}) v(a, b, c, d)))"""


@query(f"SELECT id, district FROM {_CUSTOMER_POINTS} p JOIN {_DISTRICT_SIDES} s ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, district HAVING count(*) % 2 = 1")
def q43_polygon_cover(spark, sf):
    """Customers in the overlapping districts of all suppliers, by quadtree covers."""
    return cover.within(_customer_points(spark, sf), _districts(spark, sf), "district").select("id", "district")


# --- files and layers -------------------------------------------------------------------------------


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN CAST(-58 AS DOUBLE) - c_custkey % 64 / 64.0 END AS x, CASE WHEN c_custkey % 4 <> 0 THEN CAST(-34 AS DOUBLE) - c_custkey % 32 / 32.0 END AS y FROM customer
WHERE c_custkey % 4 <> 0 AND CAST(-58 AS DOUBLE) - c_custkey % 64 / 64.0 >= -58.5
""")
def q44_layer_scan(spark, sf):
    """A layer of all customers, written as one FeatureCollection by many tasks and scanned by many, those in the east of it."""
    k = F.col("c_custkey")
    at = lambda base, n: F.when(k % 4 != 0, base - k % n / n)
    layer = table(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), at(F.lit(-58.0), 64).alias("lon"), at(F.lit(-34.0), 32).alias("lat"))
    path = f"{stage_path(spark, 'layer')}/customers.geojson"
    files.write_geojson(layer, path)
    return layers.read_layer(spark, path, ["id", "name"], bbox=(-58.5, -90.0, 180.0, 90.0), split=1 << 16).select("id", "name", "x", "y")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS "Baños", CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM orders
""")
def q45_workbook(spark, sf):
    """All orders written as one workbook by many tasks, and read back."""
    k = F.col("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 7 != 0, F.col("o_orderpriority")).alias("Baños"), F.when(k % 5 != 0, k).alias("o_custkey"), F.col("o_orderdate").cast("date").alias("o_orderdate"), (k % 2 == 0).alias("even"))
    path = f"{stage_path(spark, 'book')}/orders.xlsx"
    workbook.write_workbook(rows, path)
    return workbook.read_workbook(spark, path)


@query(f"SELECT CAST((SELECT count(*) FROM customer) AS BIGINT) AS before, CAST(count(*) AS BIGINT) AS after FROM (SELECT id, district FROM {_CUSTOMER_POINTS} p JOIN {_DISTRICT_SIDES} s ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, district HAVING count(*) % 2 = 1)")
def q50_join_counts(spark, sf):
    """Rows before and after the containment join, counted by places without making the pairs; the query counts when it is made."""
    counted = cover.counts(_customer_points(spark, sf), _districts(spark, sf), "district")
    return spark.createDataFrame([counted], "before long, after long")


def _degrees_sql() -> str:
    """The way back from metres written out: the series, and Newton's steps one by one."""
    radius, _, beta = spatial._series()
    e = math.sqrt(spatial.FLATTENING * (2 - spatial.FLATTENING))
    num = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    xi = " - ".join(["xi0", *(f"{num(b)} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, b in enumerate(beta, 1))])
    eta = " - ".join(["eta0", *(f"{num(b)} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, b in enumerate(beta, 1))])
    steps = ", ".join(
        f"g{k} AS (SELECT id, xi, eta, goal, t, sinh({num(e)} * atanh({num(e)} * t / sqrt(1 + t * t))) AS s FROM n{k}), "
        f"h{k} AS (SELECT *, t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS now FROM g{k}), "
        f"n{k + 1} AS (SELECT id, xi, eta, goal, t + (goal - now) * (1 + {num(1 - e * e)} * t * t) / ({num(1 - e * e)} * sqrt(1 + now * now) * sqrt(1 + t * t)) AS t FROM h{k})"
        for k in range(3)
    )
    return f"""
WITH p AS (SELECT c_custkey AS id, (c_custkey % 211 * 700 + 5560000 - 5500000) / {num(radius)} AS eta0, (c_custkey % 307 * 900 + 6050000) / {num(radius)} - {num(math.pi / 2)} AS xi0 FROM customer),
q AS (SELECT id, {xi} AS xi, {eta} AS eta FROM p), n0 AS (SELECT id, xi, eta, sin(xi) / sqrt(sinh(eta) * sinh(eta) + cos(xi) * cos(xi)) AS goal, goal AS t FROM q), {steps}
SELECT id, round(degrees(atan2(sinh(eta), cos(xi))) - 60, 7) AS lon, round(degrees(atan(t)), 7) AS lat FROM n3"""


@query(_degrees_sql())
def q51_metres_to_degrees(spark, sf):
    """Points given in metres, in degrees."""
    k = F.col("c_custkey")
    lon, lat = spatial.unproject((k % 211 * 700 + 5_560_000).cast("double"), (k % 307 * 900 + 6_050_000).cast("double"))
    return table(spark, sf, "customer").select(k.alias("id"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _line_metres_sql() -> str:
    """The ends of each customer's two lines, each projected by itself."""
    ends = "(VALUES (0, 0, 0.0, 0.0), (0, 1, 0.01, 0.0), (1, 0, 0.0, 0.0), (1, 1, 0.0, 0.01)) v(part, place, dx, dy)"
    plain = _projection_sql().replace("SELECT c_custkey AS id,", "SELECT c_custkey AS id, part, place,").replace("FROM customer),", f"FROM customer, {ends}),")
    plain = plain.replace("/ CAST(500 AS DOUBLE) AS lon", "/ CAST(500 AS DOUBLE) + CAST(dx AS DOUBLE) AS lon").replace("/ CAST(500 AS DOUBLE) AS lat", "/ CAST(500 AS DOUBLE) + CAST(dy AS DOUBLE) AS lat")
    return plain.replace("SELECT id, radians(", "SELECT id, part, place, radians(").replace("SELECT id, atan2(", "SELECT id, part, place, atan2(").replace("SELECT id, round(", "SELECT id, part, place, round(")


@query(_line_metres_sql())
def q52_lines_to_metres(spark, sf):
    """Every vertex of lines of two parts, in metres."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    lon, lat = F.col("lon"), F.col("lat")
    lines = F.array(F.array(at(lon, lat), at(lon + 0.01, lat)), F.array(at(lon, lat), at(lon, lat + 0.01)))
    parts = _lonlat(spark, sf).select("id", F.posexplode(spatial.project_parts(lines)).alias("part", "line"))
    return parts.select("id", "part", F.posexplode("line").alias("place", "p")).select("id", "part", "place", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


# --- beyond the reference: listings along time ---------------------------------------------------------


@query("""
WITH known AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS since, max(o_totalprice) AS rent FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_orderkey, CAST(k.since AS VARCHAR) AS since, k.rent FROM orders o ASOF LEFT JOIN known k ON o.o_custkey = k.o_custkey AND CAST(o.o_orderdate AS DATE) >= k.since
""")
def q46_as_of(spark, sf):
    """The rent that a customer's last snapshot up to an order's day had."""
    orders = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    known = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("day").alias("since"), F.col("o_totalprice").alias("rent"))
    return history.as_of(orders.select("o_orderkey", "o_custkey", "day"), known, ["o_custkey"], "day", "since").select("o_orderkey", F.col("since").cast("string").alias("since"), "rent")


_PERIODS = """
WITH l AS (SELECT o_orderkey AS listing, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS begins, CASE WHEN o_orderkey % 97 = 0 THEN 2000 ELSE o_orderkey % 40 END AS days FROM orders),
p AS (SELECT o_orderkey AS price, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 50 AS since, o_orderkey % 300 AS lasts FROM orders)
"""


@query(f"{_PERIODS} SELECT listing, price FROM l JOIN p ON l.o_custkey = p.o_custkey AND days > 0 AND lasts > 0 AND begins < since + lasts AND since < begins + days")
def q47_period_overlap(spark, sf):
    """Listing periods, a few of them years long, with the price periods that they overlap."""
    k, day = F.col("o_orderkey"), F.unix_date(F.col("o_orderdate").cast("date"))
    orders = table(spark, sf, "orders")
    a = orders.select(k.alias("listing"), "o_custkey", day.alias("begins"), (day + F.when(k % 97 == 0, 2000).otherwise(k % 40)).alias("ends"))
    b = orders.select(k.alias("price"), "o_custkey", (day + k % 50).alias("since"), (day + k % 50 + k % 300).alias("until"))
    return history.overlaps(a, b, ["o_custkey"], ("begins", "ends"), ("since", "until")).select("listing", "price")


@query("""
SELECT segment, priority, CAST(count(*) AS BIGINT) AS rows, CAST(count(price) AS BIGINT) AS "values", min(price) AS least, max(price) AS largest, true AS distinct_near, true AS median_near FROM (
  SELECT c_mktsegment AS segment, o_orderpriority AS priority, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM orders JOIN customer ON o_custkey = c_custkey)
GROUP BY GROUPING SETS ((segment, priority), (segment), (priority), ())
""")
def q48_rolled_up_sketches(spark, sf):
    """Orders by segment and priority, rolled up from sketches stored by day; whether the estimates are near what the rows say."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    by = ["segment", "priority"]
    rows = rows.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day"), "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"))
    stored = stage(summaries.sketched(rows, [*by, "day"], "o_custkey", "price"), "sketches")
    sets = [by, ["segment"], ["priority"], []]
    found = summaries.estimates(summaries.rolled_up(stored, by, sets), [0.5])
    seen = summaries.distinct_counts(rows, by, sets, "o_custkey").withColumnRenamed("distinct", "exact")
    same = F.expr("a.level = b.level AND a.segment <=> b.segment AND a.priority <=> b.priority")
    both = stage(found.alias("a").join(F.broadcast(seen.alias("b")), same).select("a.*", "exact"), "estimates")
    around = summaries.shares(rows, by, sets, both, "price", "q50")
    near = (F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.1 * F.col("exact"))).alias("distinct_near")
    same = F.expr("c.level = d.level AND c.segment <=> d.segment AND c.priority <=> d.priority")
    median = F.when(F.col("values") > 0, (F.col("below") <= 0.55 * F.col("values")) & (F.col("up_to") >= 0.45 * F.col("values"))).otherwise(F.col("q50").isNull()).alias("median_near")
    return both.alias("c").join(F.broadcast(around.alias("d")), same).select("c.segment", "c.priority", "c.rows", "c.values", "c.least", "c.largest", near, median)


_SNAPSHOTS = """
WITH old AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderpriority AS kind FROM orders WHERE o_orderkey % 50 <> 1 UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 60 = 2),
new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 70 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 90 = 3 THEN NULL ELSE o_orderpriority END AS kind FROM orders WHERE o_orderkey % 80 <> 4),
gone AS (SELECT * FROM old EXCEPT ALL SELECT * FROM new), come AS (SELECT * FROM new EXCEPT ALL SELECT * FROM old),
pairs AS (SELECT g.k FROM (SELECT k FROM gone GROUP BY k HAVING count(*) = 1) g JOIN (SELECT k FROM come GROUP BY k HAVING count(*) = 1) c ON g.k = c.k)
"""


@query(f"""{_SNAPSHOTS}
SELECT g.k, 'changed' AS change, concat_ws(',', CASE WHEN g.price IS DISTINCT FROM c.price THEN 'price' END, CASE WHEN g.kind IS DISTINCT FROM c.kind THEN 'kind' END) AS fields, CAST(1 AS BIGINT) AS n FROM gone g JOIN come c ON g.k = c.k WHERE g.k IN (SELECT k FROM pairs)
UNION ALL SELECT k, 'gone', '', CAST(count(*) AS BIGINT) FROM gone WHERE k NOT IN (SELECT k FROM pairs) GROUP BY k, price, kind
UNION ALL SELECT k, 'new', '', CAST(count(*) AS BIGINT) FROM come WHERE k NOT IN (SELECT k FROM pairs) GROUP BY k, price, kind
""")
def q49_snapshot_changes(spark, sf):
    """What changed between two kept snapshots of the orders: new, gone and changed rows, repeated ones counted."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    plain = lambda df: df.select(k.alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("kind"))
    old = plain(orders.where(k % 50 != 1)).union(plain(orders.where(k % 60 == 2)))
    new = orders.where(k % 80 != 4).select(k.alias("k"), F.when(k % 70 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"), F.when(k % 90 != 3, F.col("o_orderpriority")).alias("kind"))
    paths = [stage_path(spark, n) for n in ("old", "new")]
    for df, path in zip((old, new), paths, strict=True):
        history.keep_snapshot(df, ["k"], path, ranges=64)
    return history.snapshot_changes(spark, *paths, ["k"]).select("k", "change", F.array_join("fields", ",").alias("fields"), "n")


# --- earlier rules, pages, files and the whole map ------------------------------------------------------


def _old_cards(spark, sf) -> DataFrame:
    """One captured page for each customer, on one of five result pages, a quarter of them captured twice, with a card in the older markup."""
    k, price = F.col("c_custkey"), F.floor(F.abs("c_acctbal") * 90).cast("string")
    n, even = k.cast("string"), lambda text: F.when(k % 2 == 0, F.lit(text)).otherwise(F.lit(""))
    span = '<span class="postingMainFeatures-module__posting-main-features-span">'
    zona = F.concat(
        F.lit('<div class="q postingCardLayout-module__posting-card-layout"><div class="postingPrices-module__price"> USD '), price, F.lit(" </div>"), even('<div class="postingPrices-module__expenses">$ 100 Expensas</div>'),
        F.lit('<h2> Lindo  depto </h2><div class="postingLocations-module__location-address">Calle '), n, F.lit(f"</div>{span}50 m² tot.</span>{span}45 m² cub.</span>{span}2 dorm.</span>"),
        F.lit('<a href="'), F.when(k % 4 == 0, F.lit("http://otro/")).otherwise(F.lit("/p/")), n, F.lit('">ver</a></div>'),
    )
    argen = F.concat(
        F.lit('<div class="listing__item"><a href="/d/'), n, F.lit('"><p class="card__price"> $ '), price, F.lit(" + 900 </p>"), even('<span class="card__expenses">+ $ 9</span>'), F.lit('<p class="card__address">Calle '), n,
        F.lit("</p><ul><li>40 m²</li><li>1 baño</li>"), F.when(k % 7 == 0, F.lit("<li>3 dorm</li>")).otherwise(F.lit("")), F.lit("</ul></a></div>"),
    )
    caba = F.concat(
        F.lit('<div class="cards">'), F.when(k % 2 == 0, F.concat(F.lit('<span class="lc-price-normal">$ '), price, F.lit("</span>"))).otherwise(F.lit("")), F.lit('<span class="lc-price-small">Expensas: $ 9</span><div class="tc_content"><h4>T '), n,
        F.lit("</h4><p>Depto<br> Calle "), n, F.lit(' </p></div><div class="details"><a href="/y/'), n, F.lit('">v</a></div><ul class="prop_details"><li><b>2</b> Ambientes</li><li>50 m² total</li></ul></div>'),
    )
    portal = F.element_at(F.array(F.lit("zonaprop"), F.lit("argenprop"), F.lit("cabaprop")), (k % 3 + 1).cast("int"))
    times = F.when(k % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    page = F.when(k % 3 == 0, zona).when(k % 3 == 1, argen).otherwise(caba)
    return table(spark, sf, "customer").select(portal.alias("portal"), F.lit("palermo").alias("barrio"), F.lit("ph").alias("tipo"), (k % 5 + 1).cast("int").alias("page_no"), k.alias("seq"), page.alias("html"), F.explode(times).alias("time"))


@query("""
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS n, CAST(CAST(floor(abs(c_acctbal) * 90) AS BIGINT) AS VARCHAR) AS p FROM customer WHERE c_custkey % 5 < 3),
rows AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE k % 4 = 0)
SELECT 'zonaprop' AS portal, 'USD ' || p AS "Precio", CASE WHEN k % 2 = 0 THEN '$ 100 Expensas' ELSE '' END AS "Expensas", 'Calle ' || n AS "Direccion", '45 m² cub.' AS "Metros", '' AS "Ambientes", '2 dorm.' AS "Dormitorios", NULL AS "Baños", NULL AS "Cocheras", 'Lindo  depto' AS "Titulo",
  CASE WHEN k % 4 = 0 THEN 'http://otro/' ELSE 'https://www.zonaprop.com.ar/p/' END || n AS "URL" FROM rows WHERE k % 3 = 0
UNION ALL SELECT 'argenprop', '$ ' || p || ' + 900', CASE WHEN k % 2 = 0 THEN '+ $ 9' ELSE '' END, 'Calle ' || n, '40 m²', '', CASE WHEN k % 7 = 0 THEN '3 dorm' END, '1 baño', '', '', 'https://www.argenprop.com/d/' || n FROM rows WHERE k % 3 = 1
UNION ALL SELECT 'cabaprop', CASE WHEN k % 2 = 0 THEN '$ ' || p ELSE 'Consultar' END, '$ 9', 'Calle ' || n, '', '2  Ambientes', NULL, NULL, '', 'T ' || n, 'https://cabaprop.com.ar/y/' || n FROM rows WHERE k % 3 = 2
""")
def q53_legacy_listings(spark, sf):
    """Listings of three portals by the earlier rules, in the columns of the old files; pages beyond the third go, repeated ones stay."""
    pages = _old_cards(spark, sf)
    return unify.union_all([legacy.legacy_listings(pages, p).withColumn("portal", F.lit(p)) for p in legacy.READERS])


@query(f"""
SELECT seq, CAST(seq % 5 + 1 AS INTEGER) AS page_no, CAST(card AS INTEGER) AS card_no, url FROM ({_LISTINGS}), (VALUES (0), (1), (2)) v(card) WHERE seq % 5 < 3 AND card <= seq % 7 % 3
""")
def q54_result_pages(spark, sf):
    """Listings of the first three result pages, each page with one to three cards in their order."""
    k = F.col("seq")
    pages = _cards(spark, sf).withColumns({"page_no": (k % 5 + 1).cast("int"), "html": F.expr("repeat(html, CAST(seq % 7 % 3 + 1 AS INT))")})
    return html.raw_listings(pages).select("seq", "page_no", "card_no", F.col("URL").alias("url"))


@query(f"""
SELECT portal, url, CAST(price AS BIGINT) AS price, CAST(expensas AS BIGINT) AS expensas, CAST(ambientes AS BIGINT) AS ambientes, CAST(totales AS BIGINT) AS totales, CASE WHEN publicado IS NOT NULL THEN '2024-03-05' END AS publicado
FROM ({_LISTINGS}) WHERE CAST(price AS BIGINT) BETWEEN 10000 AND 999999 AND (portal = 'cabaprop' OR seq % 2 = 0)
""")
def q55_dated_files(spark, sf):
    """Cleaned listings written as each portal's file of two days, the second without a file where it has no rows, and the newest ones read and united."""
    rows = stage(clean.cleaned(clean.first_labels(html.raw_listings(_cards(spark, sf)))), "listings")
    base = stage_path(spark, "snapshots")
    for portal, columns in PORTAL_COLUMNS.items():
        own = rows.where(F.col("Portal") == portal)
        later = own.where(F.col("seq") % 2 == 0) if portal != "cabaprop" else own.limit(0)
        for day, part in (("2024-03-01", own), ("2024-03-08", later)):
            files.write_dated(part.select(*columns), base, portal, day)
    names = {"Portal": "portal", "URL": "url", "Precio": "price", "Expensas": "expensas", "Ambientes": "ambientes", "Metros_Totales": "totales"}
    return files.consolidated(spark, base).select(*(F.col(a).alias(b) for a, b in names.items()), F.col("Fecha_Publicacion").cast("string").alias("publicado"))


@query("""
WITH l AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 3) AS BIGINT) AS price, CASE WHEN o_custkey % 3 = 0 THEN 100000 END AS expenses, CASE WHEN o_custkey % 10 <> 0 THEN CAST(floor(o_totalprice * 3) AS BIGINT) + coalesce(CASE WHEN o_custkey % 3 = 0 THEN 100000 END, 0) END AS cost FROM orders),
b(lo, hi, color) AS (VALUES (0, 300000, '#1a9850'), (300000, 400000, '#91cf60'), (400000, 500000, '#d9ef8b'), (500000, 600000, '#fee08b'), (600000, 700000, '#fc8d59'), (700000, 800000, '#d73027'), (800000, 10000000, '#67000d'))
SELECT 'Departamentos' AS layer, id, '{"radius":5,"color":"white","weight":0.5,"fillOpacity":0.8,"fillColor":"' || coalesce(color, '#808080') || '"}' AS style,
  concat_ws('; ', 'Portal: zonaprop', 'Precio: ' || price, 'Expensas: ' || coalesce(CAST(expenses AS VARCHAR), '-'), 'Costo total: ' || coalesce(CAST(cost AS VARCHAR), '-')) AS tip, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM l LEFT JOIN b ON cost >= lo AND cost < hi
UNION ALL SELECT 'Barrios', n_nationkey, '{"fillColor":"transparent","color":"black","weight":2.5,"opacity":1.0}', NULL, NULL, NULL FROM nation
UNION ALL SELECT 'Líneas Subte', n_nationkey, '{' || CASE n_nationkey % 9 WHEN 0 THEN '"color":"#00AEEF",' WHEN 1 THEN '"color":"#ED1C24",' WHEN 2 THEN '"color":"#0054A6",' WHEN 3 THEN '"color":"#00802F",' WHEN 4 THEN '"color":"#662D91",' WHEN 7 THEN '"color":"#FFD100",' ELSE '' END || '"weight":3.5,"opacity":0.8}', NULL, NULL, NULL FROM nation
UNION ALL SELECT 'Espacios Verdes', p_partkey, '{"fillColor":"' || CASE p_size % 4 WHEN 2 THEN '#99d8c9' ELSE '#2ca25f' END || '","color":"#00441b","weight":1.0,"fillOpacity":0.6}', 'Nombre: ' || p_name || '; Tipo: ' || CASE p_size % 4 WHEN 2 THEN 'plaza' ELSE 'parque' END, NULL, NULL FROM part WHERE p_size % 4 < 3
""")
def q56_whole_map(spark, sf):
    """Areas, lines and listings of the assembled map with styles and tooltips, and each listing's row of the legend."""
    none = spark.createDataFrame([], "cadena string, nombre string, color_map string")
    kind = F.element_at(F.array(*map(F.lit, ["PARQUE", "JARDÍN BOTANICO", "PLAZA", "OTRO"])), (F.col("p_size") % 4 + 1).cast("int"))
    greens = metrics.green_spaces(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("nombre"), kind.alias("clasificac")))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), X.lookup(F.char(65 + F.col("n_nationkey") % 9), geocode.LINE_COLORS).alias("color_map"))
    price, key = F.floor(F.col("o_totalprice") * 3).cast("long"), F.col("o_custkey")
    listings = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("zonaprop").alias("Portal"), price.alias("Precio"), F.when(key % 3 == 0, 100_000).alias("Expensas"), key)
    listings = listings.withColumn("costo_total", F.when(key % 10 != 0, metrics.total_cost(F.col("Precio"), F.col("Expensas")))).drop("o_custkey")
    made = metrics.map_layers(nation.select("id"), greens, nation, none, none, listings)
    legend = F.broadcast(metrics.legend(spark))
    shown = []
    for name in ("Departamentos", "Barrios", "Líneas Subte", "Espacios Verdes"):
        df = made[name]
        tip = F.array_join(F.transform("tooltip", lambda t: F.concat(t["label"], F.lit(" "), F.coalesce(t["value"], F.lit("-")))), "; ") if "tooltip" in df.columns else F.lit(None).cast("string")
        fill = F.col("style.fillColor") if name == "Departamentos" else F.lit(None).cast("string")
        shown.append(df.select(F.lit(name).alias("layer"), "id", F.to_json("style").alias("style"), tip.alias("tip"), fill.alias("color")).join(legend, "color", "left").drop("color"))
    return unify.union_all(shown)


@query(r"""
SELECT k, CASE WHEN k % 6 > 3 THEN regexp_replace(address, 'C\.A\.B\.A|CABA| - ', ' ', 'gi') || ', Ciudad Autónoma de Buenos Aires, Argentina' END AS full_address, upper(left(name, 1)) || lower(substr(name, 2)) || ':' AS label FROM (
  SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 4 THEN 'c.a.b.a Calle ' || c_custkey || ' - piso' WHEN 5 THEN 'Calle ' || c_custkey || ' CABA' END AS address, replace(lower(c_mktsegment) || '_' || c_name, '_', ' ') AS name FROM customer)
""")
def q57_address_guard(spark, sf):
    """Addresses to look up, none for null and blank ones, and captions of column names."""
    k = F.col("c_custkey")
    n = k.cast("string")
    address = F.when(k % 6 == 1, F.lit("")).when(k % 6 == 2, F.lit("   ")).when(k % 6 == 3, F.lit("\t  ")).when(k % 6 == 4, F.concat(F.lit("c.a.b.a Calle "), n, F.lit(" - piso"))).when(k % 6 == 5, F.concat(F.lit("Calle "), n, F.lit(" CABA")))
    return table(spark, sf, "customer").select(k.alias("k"), X.full_address(address).alias("full_address"), X.label(F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_name"))).alias("label"))


_SEARCHES = _PLAN.replace("(SELECT lower(replace(n_name, ' ', '-')) AS barrio FROM nation)", "(VALUES ('palermo'), ('villa-urquiza'), ('parque-chas'), ('belgrano'), ('recoleta'), ('almagro'), ('colegiales'), ('barrio-norte')) b(barrio)")


@query(f"""
SELECT k, portal, url FROM (SELECT c_custkey AS k, ['palermo', 'villa-urquiza', 'parque-chas', 'belgrano', 'recoleta', 'almagro', 'colegiales', 'barrio-norte'][CAST(c_custkey % 8 + 1 AS INTEGER)] AS barrio, CASE WHEN c_custkey % 3 = 0 THEN 'ph' ELSE 'departamento' END AS tipo FROM customer)
JOIN ({_SEARCHES}) USING (barrio, tipo)
""")
def q58_searches_of_customers(spark, sf):
    """The searches of the default plan for the neighbourhood and type that a customer looks for."""
    k = F.col("c_custkey")
    wanted = table(spark, sf, "customer").select(k.alias("k"), F.element_at(F.array(*map(F.lit, urls.BARRIOS)), (k % 8 + 1).cast("int")).alias("barrio"), F.when(k % 3 == 0, F.lit("ph")).otherwise(F.lit("departamento")).alias("tipo"))
    return wanted.join(F.broadcast(urls.search_plan(spark)), ["barrio", "tipo"]).select("k", "portal", "url")


@query(r"""
WITH d AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Monoambiente luminoso' WHEN 1 THEN 'MONO AMBIENTE' WHEN 2 THEN 'depto 1 amb' WHEN 3 THEN 'depto 11 ambientes' WHEN 4 THEN 'lindo monoamb' WHEN 5 THEN 'casa' END AS title, text, CAST(doc_id % 3 AS VARCHAR) AS rooms FROM documents),
j AS (SELECT *, lower(coalesce(title, 'nan') || ' ' || coalesce(text, 'nan') || ' ' || rooms) AS t FROM d), c AS (SELECT *, replace(t, ' ', '') AS s FROM j)
SELECT doc_id, rooms = '1' OR contains(s, 'monoambiente') OR contains(s, 'monoamb') OR contains(s, '1ambiente') OR contains(s, '1amb') AS compat,
  rooms = '1' OR coalesce(regexp_matches(lower(title), '(^|[^\p{L}\p{N}])(mono *ambiente|monoamb|1 *amb)'), false) OR coalesce(regexp_matches(lower(text), '(^|[^\p{L}\p{N}])(mono *ambiente|monoamb|1 *amb)'), false) AS strict FROM c
""")
def q59_one_room(spark, sf):
    """Which texts speak of one room, by the default terms, in both ways of looking for them."""
    k = F.col("doc_id") % 8
    title = F.element_at(F.array(*map(F.lit, ["Monoambiente luminoso", "MONO AMBIENTE", "depto 1 amb", "depto 11 ambientes", "lindo monoamb", "casa"])), F.when(k < 6, (k + 1).cast("int")))
    by = {mode: clean.is_excluded(title, F.col("text"), (F.col("doc_id") % 3).cast("string"), mode=mode).alias(mode) for mode in ("compat", "strict")}
    return table(spark, sf, "documents").select("doc_id", *by.values())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q28_listing_metrics(spark, sf_dir)
