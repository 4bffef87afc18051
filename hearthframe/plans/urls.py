"""The search plan: one URL for each neighbourhood, type and portal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neighbourhoods, types, and each portal's word for a type.
BARRIOS = ["palermo", "villa-urquiza", "parque-chas", "belgrano", "recoleta", "almagro", "colegiales", "barrio-norte"]
TIPOS = ["departamento", "ph"]
SLUGS = {
    ("zonaprop", "departamento"): "departamentos",
    ("zonaprop", "ph"): "ph",
    ("argenprop", "departamento"): "departamentos",
    ("argenprop", "ph"): "ph",
    ("cabaprop", "departamento"): "departamento",
    ("cabaprop", "ph"): "ph",
}


@dataclass(frozen=True)
class Search:
    """What is searched for. Fixed values as defaults."""

    price: tuple[int, int] = (350_000, 800_000)
    currency: str = "pesos"
    rooms: tuple[int, int] = (2, 3)
    bedrooms: tuple[int, int] = (1, 2)
    covered_from: int | None = 35
    balcony: bool = True
    expenses_to: int | None = 300_000


def _if(value, text: str) -> Column:
    """A part that concat_ws leaves out if the value is unset."""
    return F.lit(text) if value else F.lit(None).cast("string")


def portal_url(portal: Column, slug: Column, barrio: Column, tipo: Column, s: Search = Search()) -> Column:
    balcony = lambda text: F.when(F.lit(s.balcony) & (tipo != "ph"), F.lit(text))
    low, high = s.price
    zona = F.concat_ws(
        "-", slug, F.lit("alquiler"), barrio, balcony("con-balcon"),
        F.lit(f"desde-{s.bedrooms[0]}-hasta-{s.bedrooms[1]}-habitaciones"), F.lit(f"desde-{s.rooms[0]}-hasta-{s.rooms[1]}-ambientes"),
        _if(s.covered_from, f"mas-{s.covered_from}-m2-cubiertos"), F.lit(f"{low}-{high}-{s.currency}"),
    )
    argen_query = F.concat_ws("&", _if(s.expenses_to, f"*-{s.expenses_to}-expensas"), balcony("con-ambiente-balcon"), F.lit("solo-ver-pesos"))
    argen = F.concat(F.concat_ws("/", F.lit(""), slug, F.lit("alquiler"), barrio, F.lit(f"{s.currency}-{low}-{high}")), F.lit("?"), argen_query)
    caba = F.concat_ws(
        "-", F.lit("alquilar"), slug, F.replace(barrio, F.lit("-"), F.lit("_")), F.lit(f"pesos_desde_{low}_hasta_{high}"),
        _if(s.covered_from, f"superficieCubierta_desde_{s.covered_from}"), F.lit(f"ambientes_{s.rooms[0]}_{s.rooms[1]}"), F.lit(f"dormitorios_{s.bedrooms[0]}_{s.bedrooms[1]}"),
    )
    return (
        F.when(portal == "zonaprop", F.concat(F.lit("https://www.zonaprop.com.ar/"), zona, F.lit(".html")))
        .when(portal == "argenprop", F.concat(F.lit("https://www.argenprop.com"), argen))
        .when(portal == "cabaprop", F.concat(F.lit("https://cabaprop.com.ar/propiedades/"), caba, F.lit("?pagina=1")))
    )


def search_plan(spark: SparkSession, s: Search = Search()) -> DataFrame:
    """(barrio, tipo, portal, url): 48 rows for the default lists. The lists are parameters, so their product is small."""
    barrios = spark.createDataFrame([(b,) for b in BARRIOS], "barrio string")
    slugs = spark.createDataFrame([(t, p, x) for (p, t), x in SLUGS.items()], "tipo string, portal string, slug string")
    every = barrios.select("barrio", F.explode(F.array(*map(F.lit, TIPOS))).alias("tipo")).join(F.broadcast(slugs), "tipo")
    return every.select("barrio", "tipo", "portal", portal_url(F.col("portal"), F.col("slug"), F.col("barrio"), F.col("tipo"), s).alias("url"))


def nested_plan(plan: DataFrame) -> DataFrame:
    """(barrio, types): the plan as a map of types to maps of portals to URLs."""
    by_type = plan.groupBy("barrio", "tipo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("portal", "url")))).alias("urls"))
    return by_type.groupBy("barrio").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tipo", F.to_json("urls").alias("urls"))))).alias("types"))


def flat_plan(nested: DataFrame) -> DataFrame:
    """nested_plan() taken apart again."""
    types = nested.select("barrio", F.explode("types").alias("tipo", "urls"))
    return types.select("barrio", "tipo", F.explode(F.from_json("urls", "map<string,string>")).alias("portal", "url"))
