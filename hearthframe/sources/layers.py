"""GeoJSON layers as a data source that reads one FeatureCollection by several tasks.

A file is cut into ranges of bytes. A task reads the features that begin in its range: the first is found by how a
feature's text begins, the others follow one after the other. Where a range ends, the task looks at what the next one
will take for its first feature; if that isn't where its own last one ends, the read fails instead of losing or
inventing rows. Files whose features begin otherwise are one range.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from hearthframe.sources.storage import file_sizes, opened

#: Bytes of a range, and bytes that are read on at once beyond it; rows of one Arrow batch.
SPLIT, MORE, ROWS = 8 << 20, 1 << 16, 1_024
_START = re.compile(rb'\{\s*"type"\s*:\s*"Feature"\s*[,}]')
_LIST = re.compile(rb'"features"\s*:\s*\[\s*')
SCHEMA = "properties map<string,string>, kind string, x double, y double, parts array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"
_KINDS = pa.schema([("properties", pa.map_(pa.string(), pa.string())), ("kind", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("parts", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))), *((n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax"))])
_BOUNDS = ("xmin", "ymin", "xmax", "ymax")


class _Number(str):
    """A number as it is written."""


def _text(value) -> str | None:
    """A property as text: numbers as written, objects and lists as JSON without spaces."""
    if value is None or type(value) is str:
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, _Number) else _json(value)


def _json(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(_json, value)) + "]" if isinstance(value, list) else json.dumps(value, ensure_ascii=False)


def _points(line: list) -> list[dict]:
    return [{"x": float(p[0]), "y": float(p[1])} for p in line]


def row_of(feature: dict) -> dict:
    """A feature as a row of SCHEMA; lines and rings of all parts in one list, bounds of all points."""
    geometry = feature.get("geometry") or {}
    kind, at = geometry.get("type"), geometry.get("coordinates")
    nests = {"LineString": lambda a: [a], "MultiLineString": lambda a: a, "Polygon": lambda a: a, "MultiPolygon": lambda a: [ring for area in a for ring in area]}
    parts = [_points(part) for part in nests[kind](at)] if kind in nests and at is not None else None
    point = _points([at])[0] if kind == "Point" and at else None
    points = [point] if point else [p for part in parts or [] for p in part]
    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
    props = feature.get("properties")
    bounds = (min(xs), min(ys), max(xs), max(ys)) if points else (None,) * 4
    return {"properties": None if props is None else [(k, _text(v)) for k, v in props.items()], "kind": kind, "x": point and point["x"], "y": point and point["y"], "parts": parts, **dict(zip(_BOUNDS, bounds, strict=True))}


class _Tape:
    """The text of a file from some byte on, as far as it was asked for."""

    def __init__(self, file, at: int) -> None:
        self.file, self.text, self.done = file, "", False
        self.decoder = codecs.getincrementaldecoder("utf-8")()
        file.seek(at)

    def more(self, n: int) -> bool:
        """Reads n bytes on; False at the end of the file."""
        raw = self.file.read(n)
        self.done = not raw
        self.text += self.decoder.decode(raw, final=self.done)
        return not self.done


def features(file, begin: int, stop: int) -> Iterator[tuple[int, dict]]:
    """(byte, feature) of those that follow each other from this byte on, and begin before stop; then (byte, None) of the
    next one, if the list goes on."""
    tape, at, byte, step = _Tape(file, begin), 0, begin, MORE
    read = json.JSONDecoder(parse_int=_Number, parse_float=_Number).raw_decode
    tape.more(max(MORE, min(stop - begin, SPLIT)))
    while True:
        while True:  # to what is no white space
            while at < len(tape.text) and tape.text[at] in " \t\r\n":
                at, byte = at + 1, byte + 1
            if at < len(tape.text) or not tape.more(MORE):
                break
        if at >= len(tape.text) or tape.text[at] == "]":
            return
        if tape.text[at] == ",":
            at, byte = at + 1, byte + 1
            continue
        if byte >= stop:
            yield byte, None
            return
        while True:
            try:
                found, end = read(tape.text, at)
                break
            except json.JSONDecodeError:
                if not tape.more(step):
                    raise
                step *= 2  # so a long feature is tried a few times only
        yield byte, found
        byte += len(tape.text[at:end].encode("utf-8", "surrogatepass"))
        at, step = end, MORE
        if at > SPLIT:
            tape.text, at = tape.text[at:], 0


def _first(file, at: int, stop: int, pattern: re.Pattern) -> tuple[int, int] | None:
    """Where the pattern first begins at or after a byte and before stop, and where it ends."""
    file.seek(at)
    held, base = b"", at
    while base < stop:
        raw = file.read(SPLIT)
        held += raw
        m = pattern.search(held)
        if m and (m.end() < len(held) or not raw):
            return (base + m.start(), base + m.end()) if base + m.start() < stop else None
        if not raw:
            return None
        cut = max(0, len(held) - MORE)  # a beginning may go on in what comes next
        held, base = held[cut:], base + cut
    return None


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    stop: int
    size: int


class LayerReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        box = [float(x) for x in options["bbox"].split(",")] if options.get("bbox") else None
        self.tests = [("xmax", ">=", box[0]), ("ymax", ">=", box[1]), ("xmin", "<=", box[2]), ("ymin", "<=", box[3])] if box else []

    def partitions(self) -> list[Range]:
        out = []
        for path, size in file_sizes(self.path, "json"):
            with opened(path) as file:
                head = _first(file, 0, size, _LIST)
                start = _first(file, head[1], head[1] + 1, _START) if head else None
            step = self.split if start and start[0] == head[1] else max(size, 1)
            out += [Range(path, lo, min(lo + step, size), size) for lo in range(0, size, step)]
        return out

    def _kept(self, row: dict) -> bool:
        for name, sign, value in self.tests:
            at = row[name]
            if at is None or not {">": at > value, ">=": at >= value, "<": at < value, "<=": at <= value}[sign]:
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = []
        with opened(partition.path) as file:
            if partition.begin == 0:
                head = _first(file, 0, partition.size, _LIST)
                first = head and head[1]
            else:
                found = _first(file, partition.begin, partition.stop, _START)
                first = found and found[0]
            if first is None:
                return
            last = None
            for last, feature in features(file, first, partition.stop):
                if feature is None:
                    after = _first(file, partition.stop, partition.size, _START)
                    if after is None or after[0] != last:
                        raise ValueError(f"{partition.path}: the feature at byte {last} doesn't begin like the first one; read it with split={partition.size}")
                    break
                row = row_of(feature)
                if self._kept(row):
                    rows.append(row)
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)


class PushedReader(LayerReader):
    """The reader where the session hands filters down; where it doesn't, a reader must not take any."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a feature's bounds with numbers are made before a row is."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in _BOUNDS and isinstance(f.value, (int, float)):
                self.tests.append((f.attribute[0], signs[type(f)], float(f.value)))
            else:
                yield f


class LayerSource(DataSource):
    """GeoJSON files (path: a file, or a folder of *json files) as rows of SCHEMA.

    Options: split (bytes of a range), bbox (x1,y1,x2,y2: only features whose bounds meet it; those without points don't),
    pushdown (whether the session has spark.sql.python.filterPushdown.enabled; then comparisons of bounds are made here).
    """

    @classmethod
    def name(cls) -> str:
        return "geojson_layer"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayerReader:
        return (PushedReader if self.options.get("pushdown") == "true" else LayerReader)(self.options)


def scan_layer(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, split: int = SPLIT) -> DataFrame:
    """The features of a layer, or of all layers in a folder: properties, kind, x and y of points, parts of lines and areas, bounds."""
    spark.dataSource.register(LayerSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.read.format(LayerSource.name()).option("split", str(split)).option("pushdown", pushed)
    return (read.option("bbox", ",".join(map(repr, map(float, bbox)))) if bbox else read).load(path)


def read_layer(spark: SparkSession, path: str, properties: list[str], bbox: tuple[float, float, float, float] | None = None, split: int = SPLIT) -> DataFrame:
    """A layer: its properties as texts, kind, x and y of points, and parts of lines or rings of polygons as arrays of (x, y)."""
    return scan_layer(spark, path, bbox, split).select(*(F.col("properties")[p].alias(p) for p in properties), "kind", "x", "y", "parts")
