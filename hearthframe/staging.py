"""Written tables that cut lineage.

Iterative jobs write each round as Parquet below the cluster's shared checkpoint folder and read it
back: the plan stays short, every executor sees the files, and a lost executor costs nothing that was
already written. Operators marked tidy delete what they wrote and their result doesn't read.
"""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only on one machine, where the session names no checkpoint folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_NAME = re.compile(r"/staged/([^/]+-[0-9a-f]{32})(?:/|$)")
_open: list[set[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it; an error on a cluster without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].add(path)
    return path


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and returns the written table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> list:
    """The folders of the files that df reads, whose names come encoded."""
    jvm = df.sparkSession.sparkContext._jvm
    return [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(f)) for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}]


def bytes_on_disk(df: DataFrame) -> int:
    """Bytes of the files that df reads; asks the file system, and runs no job."""
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    return sum(path.getFileSystem(conf).getContentSummary(path).getLength() for path in _folders(df))


def drop_stage(df: DataFrame) -> None:
    """Deletes the files behind a staged table that nothing reads any more."""
    for path in _folders(df):
        _delete(df.sparkSession, path.toString())


def tidy(build):
    """Lets a function that returns a DataFrame delete the tables it staged, but for those that the result reads."""

    @functools.wraps(build)
    def run(*args, **named):
        _open.append(set())
        try:
            out = build(*args, **named)
        finally:
            own = _open.pop()
        if not own:
            return out
        read = {m[1] for m in map(_NAME.search, out.inputFiles()) if m}
        kept = {p for p in own if _NAME.search(p)[1] in read}
        for path in own - kept:
            _delete(out.sparkSession, path)
        if _open:
            _open[-1].update(kept)
        return out

    return run
