"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.staging import bytes_on_disk, stage

#: Rows and bytes (as JSON) up to which a side is broadcast.
ROWS, BYTES = 500_000, 16 << 20
#: Keys with more than this share of all rows are joined by broadcasting, so there are no more of these than its inverse.
HOT = 1 / 500
#: Rows of one key, at least, that are split over several tasks.
MANY = 50_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over twice as many tasks as run at once, for work that is heavy beside the bytes of its rows: a small file is one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def small_side(df: DataFrame, rows: int = ROWS, size: int = BYTES, written: bool = False) -> DataFrame:
    """df, marked for broadcasting if its rows and their bytes are within these bounds; else Spark shuffles both sides.

    df is written once and measured where it is written; written says that it is already. A table whose files are larger
    isn't gone through at all, another one once.
    """
    df = df if written else stage(df, "side")
    if bytes_on_disk(df) > size:
        return df
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found.rows <= rows and found.size <= size else df


def join_hot(rows: DataFrame, side: DataFrame, key: str | list[str], times: str, least: float | None = None) -> DataFrame:
    """rows joined with side, a table of distinct non-null keys that tells how many rows have each.

    The few keys with more than least rows (HOT of all, if it is not known) are broadcast with their
    cells of side, so that none of them is one task; the others are shuffled. Of an unknown least, side
    should be a written table.
    """
    least = (side.agg(F.sum(times)).first()[0] or 0) * HOT if least is None else least
    hot = F.broadcast(side.where(F.col(times) > least))
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(side.where(F.col(times) > least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).drop(times).union(rest.join(side.where(F.col(times) <= least), keys).drop(times))


def join_split(rows: DataFrame, side: DataFrame, keys: list[str], by: str, many: int = MANY) -> DataFrame:
    """rows joined with side on keys, of which either may hold one several times.

    A key of more than many rows, and more than HOT of all, is dealt out over as many tasks as it has that number of
    rows, by a hash of by, and side's rows of it go to each; there are too few of such keys to be large.
    """
    counts = stage(rows.groupBy(*keys).agg(F.count("*").alias("times")), "counts")
    most = max(many, int((counts.agg(F.sum("times")).first()[0] or 0) * HOT))
    hot = counts.where(F.col("times") > most).select(*keys, F.ceil(F.col("times") / most).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts)).drop("_salts")
    right = side.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")))).drop("_salts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def join_cells(rows: DataFrame, side: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows joined on keys with side, a written table: broadcast if it is small, else with crowded keys split."""
    small = small_side(side, written=True)
    return join_split(rows, side, keys, by) if small is side else rows.join(small, keys)
