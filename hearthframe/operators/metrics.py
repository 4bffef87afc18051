"""Distances and counts by layer, cost, price bands, and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.operators.spatial import unproject

#: Layers, green-space classes, price bands and their colours, and the tooltip's fields.
LAYERS = ["gym", "subte", "parque", "plaza"]
GREEN = {"JARDÍN BOTANICO": "parque", "PARQUE": "parque", "PLAZA": "plaza"}
BINS = [0, 300_000, 400_000, 500_000, 600_000, 700_000, 800_000, 10_000_000]
COLORS = ["#1a9850", "#91cf60", "#d9ef8b", "#fee08b", "#fc8d59", "#d73027", "#67000d"]
UNKNOWN = "#808080"
CUTOFF = 1_000.0
TOOLTIP = ["Portal", "Barrio", "Tipo", "Precio", "Expensas", "costo_total", "Direccion", "Ambientes", "Dormitorios", "Baños", "Metros_Totales", "Metros_Cubiertos", "Inmobiliaria", *(f"{kind}_{layer}" for layer in LAYERS for kind in ("distancia_m", "cant"))]


def by_layer(listings: DataFrame, reached: DataFrame, targets: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """listings (id, node, ...) with distancia_m_<layer> and cant_<layer> from reached (origin, node, d) and targets (layer, node).

    The distance is the least one, cut to whole metres, null if nothing is in reach; the count is of
    distinct target nodes in reach, 0 if none.
    """
    layers = layers or LAYERS
    hits = reached.join(targets.select("layer", "node").distinct(), "node").groupBy("origin").pivot("layer", layers).agg(F.min("d").alias("d"), F.count("d").alias("n"))
    cols = []
    for layer in layers:
        cols += [F.floor(F.col(f"{layer}_d")).cast("long").alias(f"distancia_m_{layer}"), F.coalesce(F.col(f"{layer}_n"), F.lit(0)).cast("long").alias(f"cant_{layer}")]
    found = listings.join(hits, listings.node == hits.origin, "left")
    return found.select(*(listings[c] for c in listings.columns), *cols)


def total_cost(price: Column, expenses: Column) -> Column:
    return price + F.coalesce(expenses, F.lit(0))


def band(value: Column) -> Column:
    """The colour of the half-open band that holds a value; grey for null, the last colour outside of all bands."""
    out = F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(UNKNOWN))
    for lo, hi, color in zip(BINS, BINS[1:], COLORS, strict=False):
        out = out.when((value >= lo) & (value < hi), F.lit(color))
    return out.otherwise(F.lit(COLORS[-1]))


def legend(spark) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b), c) for a, b, c in zip(BINS, BINS[1:], COLORS, strict=False)], "lo double, hi double, color string")


def green_spaces(df: DataFrame) -> DataFrame:
    """Parks and squares with their layer in cat."""
    return df.where(F.col("clasificac").isin(*GREEN)).withColumn("cat", X.recode(F.col("clasificac"), GREEN))


def green_style(cat: Column) -> Column:
    return F.struct(F.when(cat == "parque", F.lit("#2ca25f")).otherwise(F.lit("#99d8c9")).alias("fillColor"), F.lit("#00441b").alias("color"), F.lit(1.0).alias("weight"), F.lit(0.6).alias("fillOpacity"))


def line_style(color: Column) -> Column:
    return F.struct(color.alias("color"), F.lit(3.5).alias("weight"), F.lit(0.8).alias("opacity"))


def district_style() -> Column:
    return F.struct(F.lit("transparent").alias("fillColor"), F.lit("black").alias("color"), F.lit(2.5).alias("weight"), F.lit(1.0).alias("opacity"))


def marker_style(kind: str, fill: Column) -> Column:
    """Circle markers of stations, gyms and listings."""
    radius, edge, weight, opacity = {"station": (4, "white", 0.5, 1.0), "gym": (6, "black", 1.0, 0.9), "listing": (5, "white", 0.5, 0.8)}[kind]
    return F.struct(F.lit(radius).alias("radius"), F.lit(edge).alias("color"), F.lit(weight).alias("weight"), F.lit(opacity).alias("fillOpacity"), fill.alias("fillColor"))


def gym_popup(chain: Column, name: Column) -> Column:
    return F.concat(X.as_text(chain), F.lit(": "), X.as_text(name))


def tooltip(df: DataFrame) -> Column:
    """An array of (label, value) for the fields that a listing has."""
    return F.array(*(F.struct(X.label(F.lit(c)).alias("label"), F.col(c).cast("string").alias("value")) for c in TOOLTIP if c in df.columns))


def for_map(df: DataFrame, metres: tuple[str, str] | None = None) -> DataFrame:
    """Dates as yyyy-MM-dd texts and numbers as doubles; other columns as they are.

    Of columns of one name the first stays. With metres, the names of projected coordinates, these
    become lon and lat in degrees.
    """
    seen, first = set(), []
    for k, name in enumerate(df.columns):
        if name not in seen:
            seen.add(name)
            first.append(k)
    if len(first) < len(df.columns):
        df = df.toDF(*(str(k) for k in range(len(df.columns)))).select(*(F.col(str(k)).alias(df.columns[k]) for k in first))
    if metres:
        lon, lat = unproject(*map(F.col, metres))
        df = df.withColumns({"lon": lon, "lat": lat}).drop(*metres)
    cols = []
    for name, kind in df.dtypes:
        if kind.startswith(("timestamp", "date")):
            cols.append(F.date_format(name, "yyyy-MM-dd").alias(name))
        elif kind in ("bigint", "int", "smallint", "tinyint", "float", "double") or kind.startswith("decimal"):
            cols.append(F.col(name).cast("double").alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def map_layers(districts: DataFrame, greens: DataFrame, lines: DataFrame, stations: DataFrame, gyms: DataFrame, listings: DataFrame) -> dict[str, DataFrame]:
    """The six layers of the map in their order, each with its style, and popups or tooltips where it has them.

    districts and greens (cat, nombre) are areas, lines (color_map) lines, the others points with lon and
    lat: stations (color_map), gyms (color_map, cadena, nombre) and listings (costo_total).
    """
    field = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value"))
    return {
        "Barrios": districts.withColumn("style", district_style()),
        "Espacios Verdes": greens.withColumns({"style": green_style(F.col("cat")), "tooltip": F.array(field("Nombre:", "nombre"), field("Tipo:", "cat"))}),
        "Líneas Subte": lines.withColumn("style", line_style(F.col("color_map"))),
        "Estaciones de Subte": stations.withColumn("style", marker_style("station", F.col("color_map"))),
        "Gimnasios": gyms.withColumns({"style": marker_style("gym", F.col("color_map")), "popup": gym_popup(F.col("cadena"), F.col("nombre"))}),
        "Departamentos": listings.withColumns({"style": marker_style("listing", band(F.col("costo_total"))), "tooltip": tooltip(listings)}),
    }


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Each layer as a Parquet table below path, numbered in the map's order."""
    for k, (name, df) in enumerate(layers.items()):
        df.withColumn("layer", F.lit(name)).write.mode("overwrite").parquet(f"{path}/{k}")
