"""Coordinates from an address dimension, and the gym layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.operators.joins import small_side
from hearthframe.operators.unify import union_all
from hearthframe.staging import drop_stage, stage

#: Layer colours.
LINE_COLORS = {"A": "#00AEEF", "B": "#ED1C24", "C": "#0054A6", "D": "#00802F", "E": "#662D91", "H": "#FFD100"}
GYM_COLORS = {"SportClub": "#003366", "Megatlon": "#ff6600", "Smartfit": "#cc0000"}
GYM_COLUMNS = ["nombre", "direccion_std", "plan", "precio", "cadena", "lat", "lon"]
#: What each chain calls the harmonised columns.
GYM_NAMES = {
    "SportClub": {"tipo_plan": "plan", "direccion": "direccion_std"},
    "Megatlon": {"Nombre": "nombre", "Dirección": "direccion_std", "Plan": "plan"},
    "Smartfit": {"sede": "nombre", "Dirección": "direccion_std", "smart-ui-text 8": "plan"},
}


def geocoded(df: DataFrame, address: str, dimension: DataFrame) -> DataFrame:
    """df with lat and lon from dimension (full_address, lat, lon); null where it has none.

    An address that the dimension holds twice takes the first by lat and lon, so rows are never multiplied.
    """
    known = dimension.groupBy("full_address").agg(F.min(F.struct("lat", "lon")).alias("_at"))
    found = df.withColumn("_full", X.full_address(F.col(address))).join(small_side(known), F.col("_full") == F.col("full_address"), "left")
    return found.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_full", "full_address", "_at")


def filled(df: DataFrame, address: str, dimension: DataFrame) -> DataFrame:
    """Only the rows without both coordinates are looked up; the others stay as they are."""
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return df.where(known).unionByName(geocoded(df.where(~known).drop("lat", "lon"), address, dimension))


def filled_durably(df: DataFrame, address: str, dimension: DataFrame, path: str, batches: int = 8) -> DataFrame:
    """filled(), looking addresses up in batches that are appended to a table at path as they are done.

    What is found stays there, so a rerun after a failure goes on where the last one stopped, and asks again only for
    addresses that the dimension didn't have; it may have them by then.
    """
    spark, kinds = df.sparkSession, "full_address string, lat double, lon double"
    spark.createDataFrame([], kinds).write.mode("append").parquet(path)
    wanted = df.where("lat IS NULL OR lon IS NULL").select(X.full_address(F.col(address)).alias("full_address")).where("full_address IS NOT NULL").distinct()
    part = F.pmod(F.xxhash64("full_address"), F.lit(batches)).alias("part")
    wanted = stage(wanted.join(spark.read.schema(kinds).parquet(path), "full_address", "left_anti").withColumn("part", part), "wanted")
    known = dimension.where("lat IS NOT NULL AND lon IS NOT NULL").join(wanted, "full_address", "left_semi").groupBy("full_address").agg(F.min(F.struct("lat", "lon")).alias("_at"))
    known = stage(known.withColumn("part", part), "known")
    for k in range(batches):
        known.where(F.col("part") == k).select("full_address", "_at.lat", "_at.lon").write.mode("append").parquet(path)
    drop_stage(wanted)
    drop_stage(known)
    return filled(df, address, spark.read.schema(kinds).parquet(path))


def located(df: DataFrame) -> DataFrame:
    return df.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")


def gyms(chains: dict[str, DataFrame], dimension: DataFrame) -> DataFrame:
    """One layer of all chains; those without coordinates are looked up by their address, and dropped if not found."""
    made = []
    for chain, df in chains.items():
        if "lat" not in df.columns:
            df = located(geocoded(df, "Dirección", dimension))
        made.append(df.withColumnsRenamed(GYM_NAMES[chain]).withColumn("cadena", F.lit(chain)))
    out = union_all(made)
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in GYM_COLUMNS)).withColumn("color_map", X.lookup(F.col("cadena"), GYM_COLORS))
