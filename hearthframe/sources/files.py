"""Readers and writers of snapshot files and GeoJSON layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthframe.operators.unify import latest, typed, union_all
from hearthframe.schema import PORTAL_COLUMNS
from hearthframe.sources.storage import write_joined, written_bytes
from hearthframe.sources.workbook import read_workbook, write_workbook

BOM = "\ufeff"
_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
_POINT, _LINE, _LINES, _AREAS = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


def write_snapshot(df: DataFrame, path: str) -> bool:
    """Semicolon-separated UTF-8 files with a header and a byte order mark; nothing is written, and False returned, for no rows."""
    if df.isEmpty():
        return False
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
    return True


def write_dated(df: DataFrame, base: str, portal: str, day: str) -> str | None:
    """A portal's snapshot as the one file <base>/<portal>/<portal>_<day>.csv, in place of the same day's; its path, or None for no rows.

    A portal's crawl of one day is one file by contract. Its rows are written by all tasks of df and come in the order of
    its partitions; write_snapshot keeps as many files as df has partitions.
    """
    spark, path = df.sparkSession, f"{base.rstrip('/')}/{portal}/{portal}_{day}.csv"

    def write(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("sep", ";").csv(folder)

    names = spark.createDataFrame([tuple(df.columns)], ", ".join(f"c{k} string" for k in range(len(df.columns))))
    head = BOM.encode() + written_bytes(names, f"{path}._names", write)
    return path if write_joined(lambda folder: write(df, folder), spark, path, head) else None


def write_table(df: DataFrame, path: str) -> None:
    """The consolidated table as Parquet below path/parquet, semicolon-separated below path/csv, and as the workbook path/table.xlsx."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(f"{path}/csv")
    write_workbook(df, f"{path}/table.xlsx")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """A gym chain's file: a workbook, a GeoJSON layer of points with lat and lon, a Parquet table, or a CSV file with a header."""
    if path.endswith(".xlsx"):
        return read_workbook(spark, path)
    if path.endswith(".geojson"):
        rows = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
        names = sorted({k for r in rows.select(F.explode(F.map_keys("f.properties")).alias("k")).distinct().collect() for k in r})
        point = F.from_json("f.geometry.coordinates", _POINT)
        return rows.select(*(F.col("f.properties")[n].alias(n) for n in names), point[1].alias("lat"), point[0].alias("lon"))
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)


def read_snapshot(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A snapshot as texts, under these column names."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", ";").option("header", True).option("enforceSchema", True).csv(path)


def latest_path(spark: SparkSession, folder: str) -> str:
    """The entry of a folder with the latest date in its name; an empty folder is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found = [str(s.getPath()) for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    if not found:
        raise FileNotFoundError(f"no snapshots in {folder}")
    return latest(spark.createDataFrame([(p,) for p in found], "path string")).first().path


def consolidated(spark: SparkSession, base: str) -> DataFrame:
    """The newest snapshot of each portal below base, united and typed."""
    order = ["cabaprop", "zonaprop", "argenprop"]
    frames = [read_snapshot(spark, latest_path(spark, f"{base}/{p}"), PORTAL_COLUMNS[p]) for p in order]
    return typed(union_all(frames))


def _xy(p: Column) -> Column:
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def read_geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """A layer: its properties as texts, kind, x and y of points, and parts of lines or rings of polygons as arrays of (x, y)."""
    rows = spark.read.schema(_FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.from_json(raw, _POINT)
    parts = F.when(kind == "LineString", F.array(F.from_json(raw, _LINE))).when(kind.isin("MultiLineString", "Polygon"), F.from_json(raw, _LINES)).when(kind == "MultiPolygon", F.flatten(F.from_json(raw, _AREAS)))
    return rows.select(
        *(F.col("f.properties")[p].alias(p) for p in properties), kind.alias("kind"),
        F.when(kind == "Point", point[0]).alias("x"), F.when(kind == "Point", point[1]).alias("y"), F.transform(parts, lambda part: F.transform(part, _xy)).alias("parts"),
    )


def feature(properties: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """A point feature as JSON; absent coordinates give a null geometry, null properties are kept."""
    geometry = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


def write_geojson_lines(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """One feature a line (newline-delimited GeoJSON), in as many files as df has partitions."""
    df.select(feature([c for c in df.columns if c not in (lon, lat)], lon, lat).alias("value")).write.mode("overwrite").text(path)


def write_geojson(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """One FeatureCollection in one file, as map programs read it, written by all tasks of df; rows come in the order of its partitions."""
    spark, head, tail = df.sparkSession, b'{"type":"FeatureCollection","features":[', b"]}\n"
    lines = df.select(F.concat(F.lit(","), feature([c for c in df.columns if c not in (lon, lat)], lon, lat)).alias("value"))

    def write(folder: str) -> None:
        lines.write.mode("overwrite").text(folder)

    if not write_joined(write, spark, path, head + b"\n", tail, skip=1):
        nothing = spark.createDataFrame([((head + tail).decode().strip(),)], "value string").coalesce(1)
        write_joined(lambda folder: nothing.write.mode("overwrite").text(folder), spark, path)
