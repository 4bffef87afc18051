"""Captured pages as a stream: an extension of the batch path for pages that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe.schema import PAGES
from hearthframe.sources.html import raw_listings


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (with captured, a timestamp) as JSON files arrive in a folder."""
    return spark.readStream.schema(f"{PAGES}, captured timestamp").json(folder)


def new_listings(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Listings of pages, each URL of a portal once while the watermark holds it; those without a URL all pass."""
    listed = raw_listings(stream.withWatermark("captured", late), carry=("captured",))
    own = F.concat_ws("-", "Barrio", "Tipo", "seq", "page_no", "card_no")
    return listed.withColumn("key", F.coalesce(F.nullif("URL", F.lit("")), own)).dropDuplicatesWithinWatermark(["Portal", "key"]).drop("key")
