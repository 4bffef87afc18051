"""What the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch where the session has Spark's own number: texts are large rows, and a batch is held on both sides.
BATCH_ROWS = 1_024
#: Bytes of an Arrow batch, about, where the session sets none: a few very long texts don't make a batch large.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends BATCH_ROWS rows or BATCH_BYTES to Python at once from now on, unless it was given numbers of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    if conf.get(_BYTES, None) is None:
        conf.set(_BYTES, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """A column name like this one that is not taken; Spark's names differ in more than case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
