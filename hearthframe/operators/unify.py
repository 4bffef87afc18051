"""Union of the portals' files into one typed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.schema import NUMERIC


def latest(paths: DataFrame, path: str = "path", by: list[str] | None = None) -> DataFrame:
    """The path whose name has the latest date, of all or for each group of by; names without one come before all others."""
    return paths.groupBy(*(by or [])).agg(F.max_by(path, F.struct(X.file_date(F.col(path)), F.col(path))).alias(path))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, nulls where a frame lacks one; the columns of all frames come first."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    common = [c for c in out.columns if all(c in f.columns for f in frames)]
    return out.select(*common, *(c for c in out.columns if c not in common))


def lenient_long(value: Column) -> Column:
    """A whole number, also written with decimals that are zero; null for anything else."""
    number = value.try_cast("double")
    return F.coalesce(value.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))


def day_first(value: Column) -> Column:
    """d/M/yyyy as a date; null for anything else."""
    return F.try_to_timestamp(value, F.lit("d/M/yyyy")).cast("date")


def typed(listings: DataFrame) -> DataFrame:
    """Whole numbers and dates in the columns that hold them."""
    out = listings.withColumns({c: lenient_long(F.col(c).cast("string")) for c in ["Precio", *NUMERIC] if c in listings.columns})
    return out.withColumn("Fecha_Publicacion", day_first(F.col("Fecha_Publicacion"))) if "Fecha_Publicacion" in out.columns else out


def null_profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls), one row for each column, from one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    kinds = dict(df.dtypes)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).alias("nulls")) for c in df.columns))
    return counts.select(F.inline(rows))
