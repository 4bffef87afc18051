import random

from pyspark.sql import functions as F

from hearthframe.operators import clean, unify
from hearthframe.schema import PAGES, PORTAL_COLUMNS
from hearthframe.sources import files, html, legacy
from hearthframe.streaming import captured

ZONA = """<div class="a postingCardLayout-module__posting-card-layout__x"><div class="postingPrices-module__price">{price}</div>
<h3 class="postingCard-module__posting-description"><a href="{href}">Depto 1234 - lindo</a></h3><p class="postingLocations-module__location-address">{place}</p>
<span class="postingMainFeatures-module__posting-main-features-span">50 m² tot.</span><span class="postingMainFeatures-module__posting-main-features-span">45 m² cub.</span>
<span class="postingMainFeatures-module__posting-main-features-span">2 dorm.</span><span class="postingCard-module__highlight"> Super  destacado</span></div>"""
ARGEN = """<div class="listing__item"><a href="{href}"><p class="card__price">{price}</p><h2 class="card__title">{title}</h2><p class="card__info">luminoso</p>
<ul class="card__main-features"><li>40 m²</li><li>1 baño</li><li>20 años</li></ul><span class="card__visited">Visto</span><p class="card__points">12 visitas</p></a></div>"""
CABA = """<div class="cards"><span class="lc-price-normal">$ 500.000</span><div class="tc_content"><h4>Tres ambientes</h4><p>{place}</p></div>
<ul class="prop_details"><li>3 Amb</li><li>60 Total</li><li>50 Cubiertos</li></ul><a href="/x">ver</a><span>Publicado el 05/03/2024</span></div>"""


def listings(spark, portal, *cards, **labels):
    rows = [(portal, labels.get("barrio", "palermo"), "ph", 1, k, c) for k, c in enumerate(cards)]
    return html.raw_listings(spark.createDataFrame(rows, PAGES))


def test_zonaprop(spark):
    cards = [
        ZONA.format(price='$ 650.000<span class="discount">10%</span>', href="/p/1", place="Sin numero"), ZONA.format(price="USD 900", href="/p/2", place="x"),
        ZONA.format(price="$ 1", href="http://other/p", place="Calle 9"), '<div class="postingCardLayout-module__posting-card-layout"><p>unclosed', "", "<p>no card",
    ]
    got = listings(spark, "zonaprop", *cards).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 2, 3]
    a, b, c = got
    assert (a.Precio, a.Bajo_Precio, a.Porcentaje_Rebaja, a.Direccion, a.Tipo, a.URL) == ("650000", True, "10%", "Depto 1234", "PH", "https://www.zonaprop.com.ar/p/1")
    assert (a.Metros_Totales, a.Metros_Cubiertos, a.Dormitorios, a.Ambientes, a.Etiqueta_Destacado) == ("50", "45", "2", None, "Super destacado")
    assert (b.Direccion, b.URL, b.Bajo_Precio) == ("Calle 9", "http://other/p", False)
    assert (c.Precio, c.Titulo, c.Expensas, c.URL, c.Direccion) == ("", "", "", None, "")


def test_argenprop(spark):
    a, b = listings(spark, "argenprop", ARGEN.format(href="/d/1", price="$ 500.000 + $ 90.000 expensas", title="Depto 3 ambientes"), ARGEN.format(href="http://x/y", price="$ 2", title="Casa")).orderBy("seq").collect()
    assert (a.Precio, a.Expensas, a.Ambientes, a.Antiguedad, a.Visto_Estado, a.Visitas_Count, a.URL) == ("500000", None, "3", "20", "Visto", "12", "https://www.argenprop.com/d/1")
    assert (b.Ambientes, b.URL, b.Direccion) == (None, "https://www.argenprop.comhttp://x/y", None)


def test_cabaprop(spark):
    a, b = listings(spark, "cabaprop", CABA.format(place="<strong>Palermo</strong> Gorriti 4000 <br>piso"), CABA.format(place="<strong>Palermo</strong> Gorriti")).orderBy("seq").collect()
    assert (a.Direccion, a.Fecha_Publicacion, a.Metros_Totales, a.Metros_Cubiertos, a.Ambientes) == ("Gorriti 4000", "05/03/2024", "60", "50", "3")
    assert b.Direccion == "Gorriti" and a.URL == "https://cabaprop.com.ar/x"


def test_bad_card_is_contained(monkeypatch):
    test, read = html.CARDS["argenprop"]
    calls = []

    def broken(card):
        calls.append(card)
        if len(calls) == 1:
            raise ValueError("bad")
        return read(card)

    monkeypatch.setitem(html.CARDS, "argenprop", (test, broken))
    got = html.cards(ARGEN.format(href="/1", price="$ 1", title="a") * 2, "argenprop")
    assert "error" in got[0] and got[1]["href"] == "/1" and html.cards("<p>", "nobody") == [] and html.cards(None, "argenprop") == []


def test_dedup_clean_and_files(spark, tmp_path):
    pages = [("zonaprop", b, "ph", n, s, ZONA.format(price=p, href=h, place="Calle 1")) for b, n, s, p, h in [("palermo", 1, 1, "$ 50.000", "/a"), ("almagro", 1, 2, "$ 60.000", "/a"), ("almagro", 1, 3, "$ 5", "/b"), ("almagro", 4, 4, "$ 70.000", "/c")]]
    found = clean.first_labels(html.raw_listings(spark.createDataFrame(pages, PAGES)))
    assert sorted((r.Barrio, r.Precio) for r in found.collect()) == [("almagro", "5"), ("palermo", "50000")]
    out = clean.ordered(clean.cleaned(found))
    assert out.columns[:2] == ["Portal", "Barrio"] and out.count() == 1
    for portal, cols in PORTAL_COLUMNS.items():
        for day in ("2024-01-01", "2024-02-01"):
            assert files.write_snapshot(out.limit(1).select(*cols), f"{tmp_path}/{portal}/{portal}_{day}.csv")
    assert files.write_snapshot(out.limit(0), f"{tmp_path}/none") is False
    part = next(p for p in (tmp_path / "zonaprop" / "zonaprop_2024-01-01.csv").iterdir() if p.suffix == ".csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfPortal;")
    table = files.consolidated(spark, str(tmp_path))
    assert dict(table.dtypes)["Baños"] == "bigint" and dict(table.dtypes)["Fecha_Publicacion"] == "date"
    assert table.count() == 3 and {r.Portal for r in table.collect()} == {"zonaprop"}
    assert files.latest_path(spark, f"{tmp_path}/cabaprop").endswith("2024-02-01.csv")
    nulls = {r["column"]: r.nulls for r in unify.null_profile(table).collect()}
    assert nulls["Portal"] == 0 and nulls["Antiguedad"] == 3


def test_legacy_columns(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert clean.with_columns(df, ["y", "z"]).first().asDict() == {"y": "b", "z": ""}


def test_stream_of_pages(spark, tmp_path):
    row = spark.createDataFrame([("zonaprop", "palermo", "ph", 1, 1, ZONA.format(price="$ 50.000", href="/a", place="Calle 1"))], PAGES)
    for day in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        row.selectExpr("*", f"timestamp '{day}' AS captured").write.mode("append").json(f"{tmp_path}/in")
    out = captured.new_listings(captured.pages(spark, f"{tmp_path}/in"))
    run = out.writeStream.format("memory").queryName("listed").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("listed").count() == 1


def test_legacy_rules(spark):
    def read(portal, card):
        df = legacy.legacy_listings(spark.createDataFrame([(portal, "b", "ph", 1, 1, card), (portal, "b", "ph", 4, 2, card)], PAGES), portal)
        assert df.columns == legacy.COLUMNS
        (row,) = df.collect()
        return row

    r = read("zonaprop", ZONA.format(price=" USD 900 ", href="/p", place="Calle 1"))
    assert (r.Precio, r.Metros, r.Dormitorios, r.Ambientes, r.URL, r.Titulo, r.Baños) == ("USD 900", "45 m² cub.", "2 dorm.", "", "https://www.zonaprop.com.ar/p", "", None)
    r = read("argenprop", ARGEN.format(href="/d", price="$ 1 + 2", title="x"))
    assert (r.Precio, r.Metros, r.Baños, r.Titulo) == ("$ 1 + 2", "40 m²", "1 baño", "")
    r = read("cabaprop", '<div class="cards"><span class="lc-price-small">Expensas: $ 9</span><div class="tc_content"><h4>T</h4><p>Depto<br> Calle 2 </p></div><div class="details"><a href="/y">v</a></div><ul class="prop_details"><li><b>2</b> Ambientes</li><li>50 m² total</li></ul></div>')
    assert (r.Precio, r.Expensas, r.Direccion, r.URL, r.Ambientes, r.Metros, r.Titulo) == ("Consultar", "$ 9", "Calle 2", "https://cabaprop.com.ar/y", "2  Ambientes", "", "T")


def test_dated_file_is_replaced(spark, tmp_path):
    df = spark.createDataFrame([("zonaprop", "1"), ("zonaprop", "2")], "Portal string, Precio string")
    path = files.write_dated(df, str(tmp_path), "zonaprop", "2024-03-01")
    assert path == f"{tmp_path}/zonaprop/zonaprop_2024-03-01.csv"
    assert files.write_dated(df.limit(1), str(tmp_path), "zonaprop", "2024-03-01") == path
    assert open(path, encoding="utf-8-sig").read().splitlines() == ["Portal;Precio", "zonaprop;1"]
    assert files.latest_path(spark, f"{tmp_path}/zonaprop").endswith("2024-03-01.csv")
    assert files.write_dated(df.limit(0), str(tmp_path), "zonaprop", "2024-03-02") is None
    files.write_table(df, f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all/parquet").count() == 2


def test_removed_rows_are_counted(spark):
    pages = [("zonaprop", "b", "ph", 1, s, ZONA.format(price=p, href=h, place="Calle 1")) for s, p, h in [(1, "$ 50.000", "/a"), (2, "$ 60.000", "/a"), (3, "$ 5", "/b")]]
    kept, before, after = clean.cleaned_and_counted(html.raw_listings(spark.createDataFrame(pages, PAGES)))
    assert kept.count() == 1 and clean.removed(before, after) == 2


def test_keeping_firsts_reads_its_rows_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(v):
        calls.add(1)
        return v

    rows = [("a", "u1", 3), ("a", "u1", 1), ("b", "u1", 2), ("a", None, 1), ("a", None, 1), ("a", "", 5), ("a", "u2", 4)]
    df = spark.createDataFrame(rows, "p string, url string, seq int")
    made = df.withColumn("url", F.udf(seen, "string")("url"))
    got = clean.keep_first(made, ["p", "url"], ["seq"], null_exempt=True)
    assert got.columns == ["p", "url", "seq"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", "u1", 1), ("b", "u1", 2), ("a", None, 1), ("a", None, 1), ("a", "", 5), ("a", "u2", 4)]))
    assert calls.value == len(rows)


def test_plain_pages_are_read_alike_and_without_the_builder(monkeypatch):
    def shown(node):
        return [c if isinstance(c, str) else (c.tag, c.attrs, shown(c)) for c in node.children]

    rng = random.Random(4)
    plain = ["<div>", "</div>", '<p class="a  b" ID="X">', "</P>", "<br>", "<br/>", '<img alt="" src="a>b<c"/>', "<li >", "</li>", "m² &amp; x", "a &lt b", "&", "\n", "1 > 2", '<a\nhref="/x"/>', "</b>", "\x00"]
    odd = ["<", "< p>", "<!-- <p> -->", "<!doctype html>", "<script>a<b</script>", "<p a=1>", "<p a='1'>", "<p a>", '<p a="1"b="2">', '<a href="?a=1&amp;b=2&copy=3">', "</p >", "</>", "<p", '<p a="', "<?x?>", "<title>&amp;</title>", "<p/ >", "<p\x0c>", "<h-1>", "</h-1>"]
    for n in range(4_000):
        page = "".join(rng.choice(plain + odd * (n % 2)) for _ in range(rng.randrange(12)))
        got = html._plain_tree(page)
        assert n % 2 or got is not None, page
        assert got is None or shown(got) == shown(html._built_tree(page)), page
        assert shown(html.parse(page)) == shown(html._built_tree(page))
    # the cards of the portals need no builder
    monkeypatch.setattr(html, "_Builder", None)
    pages = {"zonaprop": ZONA.format(price="$ 1", href="/a", place="Calle 1"), "argenprop": ARGEN.format(href="/a", price="$ 1", title="t"), "cabaprop": CABA.format(place="Calle 1")}
    assert [len(html.cards(page, portal)) for portal, page in pages.items()] == [1, 1, 1]
