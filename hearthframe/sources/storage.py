"""Bytes of files where Spark's own sources don't reach: ranges read by tasks, and files joined from parts."""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes that are copied at once when parts are joined.
BUFFER = 1 << 20


def located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; needs no Spark, so tasks can call it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def file_sizes(path: str, suffix: str) -> list[tuple[str, int]]:
    """The file at path, or the files with this suffix in the folder at path, in order of their names, and their bytes."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == arrow_fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(arrow_fs.FileSelector(at))
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.type == arrow_fs.FileType.File and f.base_name.lower().endswith(suffix))


def opened(path: str) -> BinaryIO:
    system, at = located(path)
    return system.open_input_file(at)


def write_joined(write: Callable[[str], None], spark: SparkSession, path: str, head: bytes = b"", tail: bytes = b"", skip: int = 0) -> bool:
    """One file at path, in place of what is there: head, the part files that write(folder) makes, in order, without the first
    skip bytes of the first one, and tail. Without a byte in the parts nothing is made, and False returned.

    The parts are written by as many tasks as their table has partitions, and then copied one after the other through a
    buffer of fixed size; the file gets its name only once it is whole, so a failure leaves what was there.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._jsc
    file = jvm.org.apache.hadoop.fs.Path
    folder, whole, to = file(f"{path}._parts"), file(f"{path}._whole"), file(path)
    fs = to.getFileSystem(gateway.hadoopConfiguration())
    try:
        write(folder.toString())
        parts = sorted((s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen() > skip), key=lambda p: p.rsplit("/", 1)[1])
        if not parts:
            return False
        out = fs.create(whole, True)
        try:
            out.write(bytearray(head))
            for part in parts:
                data = fs.open(file(part))
                data.seek(skip)
                skip = 0
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, BUFFER, False)
                data.close()
            out.write(bytearray(tail))
        finally:
            out.close()
        fs.delete(to, True)
        fs.rename(whole, to)
        return True
    finally:
        fs.delete(folder, True)
        fs.delete(whole, True)


def written_bytes(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> bytes:
    """The bytes of the single file that write makes of a small table."""
    spark = df.sparkSession
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(df.coalesce(1), path)
        return b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{path}/part-*").select("content").collect())
    finally:
        fs.delete(file, True)
