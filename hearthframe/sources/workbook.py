"""XLSX workbooks as a data source: zipped SpreadsheetML, read as a stream and written by many tasks.

A sheet is one compressed stream inside the zip file. Each task writes its rows as closed runs of that stream, which
need nothing of what stands before them; the commit puts runs of all tasks behind each other, so no row passes through
it, and begins another sheet where one is full. Reading goes through a sheet once; shared strings beyond a few MB are
kept in a temporary file of the task.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import struct
import tempfile
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from hearthframe.sources.storage import BUFFER, file_sizes, located, opened

#: Rows of a sheet with its header, as the format has it; rows of a run of the stream; rows of one Arrow batch.
SHEET, RUN, BATCH = 1_048_576, 50_000, 4_096
#: Bytes of shared strings that are kept in memory.
HELD = 16 << 20
#: Number formats that are dates or times; the day that serial numbers count from (or that of 1904).
DATES, DAY_ZERO, DAY_1904 = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}, dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_ODD = re.compile("_x(?=[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


# --- reading ----------------------------------------------------------------------------------------


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _said(element) -> str:
    """The text of a string item: its runs, without reading aids."""
    parts = [t.text or "" for child in element if _tag(child) != "rPh" for t in ([child] if _tag(child) == "t" else child) if _tag(t) == "t"]
    return _CODED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


class _Strings:
    """The shared strings of a workbook, by number; beyond HELD bytes on disk."""

    def __init__(self, book: zipfile.ZipFile) -> None:
        self.data, self.ends = tempfile.SpooledTemporaryFile(max_size=HELD), array("q", [0])
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, e in ElementTree.iterparse(part):
                    if _tag(e) == "si":
                        self.ends.append(self.ends[-1] + self.data.write(_said(e).encode("utf-8", "surrogatepass")))
                        e.clear()

    def __getitem__(self, k: int) -> str:
        self.data.seek(self.ends[k])
        return self.data.read(self.ends[k + 1] - self.ends[k]).decode("utf-8", "surrogatepass")


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in their order."""
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
    paths = [(e.get("name"), targets[e.get(f"{{{_REL}}}id")]) for e in found]
    return [(name, p.lstrip("/") if p.startswith("/") else f"xl/{p}") for name, p in paths]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of cell styles that show dates or times."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in root.iter() if _tag(e) == "numFmt"}
    dates = DATES | {k for k, code in own.items() if re.search("[ymdhs]", code, re.I)}
    cells = next((e for e in root if _tag(e) == "cellXfs"), ())
    return {k for k, e in enumerate(cells) if int(e.get("numFmtId", 0)) in dates}


def _moment(serial: str, zero: dt.datetime) -> str:
    """A serial number as a date, or with its time if it has one."""
    at = zero + dt.timedelta(seconds=round(float(serial) * 86_400, 3))
    return at.strftime("%Y-%m-%d") if at.time() == dt.time() else at.isoformat(" ", "milliseconds" if at.microsecond else "seconds")


def _column(ref: str) -> int:
    k = 0
    for c in ref:
        if not c.isalpha():
            break
        k = 26 * k + ord(c.upper()) - 64
    return k - 1


def rows_of(book: zipfile.ZipFile, part: str, strings: _Strings) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts: numbers as written, dates as yyyy-MM-dd, booleans as true and false, errors and empty cells as null."""
    dates = _date_styles(book)
    setup = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{{{_MAIN}}}workbookPr")
    zero = DAY_1904 if setup is not None and setup.get("date1904") in ("1", "true") else DAY_ZERO
    with book.open(part) as stream:
        events = ElementTree.iterparse(stream, events=("start", "end"))
        above = []
        for event, e in events:
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if _tag(e) != "row":
                continue
            row: list[str | None] = []
            for c in e:
                if _tag(c) != "c":
                    continue
                at = _column(c.get("r")) if c.get("r") else len(row)
                row += [None] * (at + 1 - len(row))
                kind, value = c.get("t", "n"), next((v for v in c if _tag(v) in ("v", "is")), None)
                if value is None or kind == "e":
                    continue
                text = _said(value) if _tag(value) == "is" else value.text or ""
                if kind == "s":
                    text = strings[int(text)]
                elif kind == "b":
                    text = "true" if text == "1" else "false"
                elif kind == "str":
                    text = _CODED.sub(lambda m: chr(int(m[1], 16)), text)
                elif kind == "n" and text and int(c.get("s", 0)) in dates:
                    text = _moment(text, zero)
                row[at] = text if text or kind not in ("n", "d") else None
            if len(e):
                yield row
            if above:
                above[-1].remove(e)  # what was read is let go


def _names(row: list[str | None]) -> list[str]:
    out: list[str] = []
    for k, name in enumerate(row):
        name = name or f"_c{k}"
        out.append(name if name not in out else f"{name}_{k}")
    return out


@dataclass
class Sheet(InputPartition):
    path: str
    part: str


class BookReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.sheet, self.names = options["path"], options.get("sheet"), names

    def partitions(self) -> list[Sheet]:
        out = []
        for path, _ in file_sizes(self.path, ".xlsx"):
            with opened(path) as file, zipfile.ZipFile(file) as book:
                sheets = _sheets(book)
            out += [Sheet(path, part) for name, part in sheets if self.sheet in (None, name)]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, pa.string()) for n in self.names])
        with opened(partition.path) as file, zipfile.ZipFile(file) as book:
            rows = rows_of(book, partition.part, _Strings(book))
            at = {n: k for k, n in enumerate(_names(next(rows, [])))}
            held: list[list[str | None]] = []

            def made() -> pa.RecordBatch:
                cells = [[r[at[n]] if n in at and at[n] < len(r) else None for r in held] for n in self.names]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], schema=kinds)

            for row in rows:
                held.append(row)
                if len(held) == BATCH:
                    yield made()
                    held = []
            if held:
                yield made()


# --- writing ----------------------------------------------------------------------------------------


def _coded(text: str) -> str:
    return escape(_ODD.sub(lambda m: "_x005F_x" if m[0] == "_x" else f"_x{ord(m[0]):04X}_", text))


def _said_cell(text: str) -> str:
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_coded(text)}</t></is></c>'


def _cells(column: pa.Array) -> list[str]:
    """A column as cells."""
    kind, values = column.type, column.to_pylist()
    if pa.types.is_boolean(kind):
        return ["<c/>" if v is None else f'<c t="b"><v>{int(v)}</v></c>' for v in values]
    if pa.types.is_integer(kind) or pa.types.is_decimal(kind):
        return ["<c/>" if v is None else f"<c><v>{v}</v></c>" for v in values]
    if pa.types.is_floating(kind):
        return ["<c/>" if v is None else f"<c><v>{v!r}</v></c>" if v - v == 0 else _said_cell(str(v)) for v in values]
    if pa.types.is_date(kind):
        return ["<c/>" if v is None else f'<c s="1"><v>{(v - DAY_ZERO.date()).days}</v></c>' for v in values]
    if pa.types.is_timestamp(kind):
        return ["<c/>" if v is None else f'<c s="2"><v>{(v.replace(tzinfo=None) - DAY_ZERO) / dt.timedelta(days=1)!r}</v></c>' for v in values]
    return ["<c/>" if v is None else _said_cell(str(v)) for v in values]


def _joined_crc(a: int, b: int, n: int) -> int:
    """The checksum of two runs of bytes behind each other, of their checksums and the second one's length."""
    zeros, c, d = bytes(min(n, BUFFER)), a, 0
    while n:
        k = min(n, BUFFER)
        c, d, n = zlib.crc32(zeros[:k], c), zlib.crc32(zeros[:k], d), n - k
    return c ^ d ^ b


@dataclass
class Run:
    """A closed run of the stream: its file (or its bytes), rows, plain and packed bytes, checksum."""

    file: str
    rows: int
    size: int
    packed: int
    crc: int
    raw: bytes = b""


def _run(text: str, end: int = zlib.Z_FULL_FLUSH) -> Run:
    raw, press = text.encode("utf-8"), zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = press.compress(raw) + press.flush(end)
    return Run("", 0, len(raw), len(packed), zlib.crc32(raw), packed)


@dataclass
class Written(WriterCommitMessage):
    task: int
    runs: list[Run]


class _Zip:
    """A zip file of entries whose packed bytes are there already."""

    def __init__(self, out) -> None:
        self.out, self.at, self.entries = out, 0, []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, name: str, runs: list[Run], read) -> None:
        crc, size, packed = 0, sum(r.size for r in runs), sum(r.packed for r in runs)
        if max(size, packed, self.at) >= 2**32 - 1:
            raise ValueError("a sheet, or the file, is larger than 4 GB")
        for r in runs:
            crc = _joined_crc(crc, r.crc, r.size)
        about = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 33, crc, packed, size, len(name), 0)
        self.entries.append((about, self.at, name.encode()))
        self._put(b"PK\x03\x04" + about + name.encode())
        for r in runs:
            for raw in [r.raw] if r.raw else read(r.file):
                self._put(raw)

    def close(self) -> None:
        begin = self.at
        for about, at, name in self.entries:
            self._put(b"PK\x01\x02" + struct.pack("<H", 20) + about + struct.pack("<HHHII", 0, 0, 0, 0, at) + name)
        self._put(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(self.entries), len(self.entries), self.at - begin, begin, 0))


class BookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = located(f"{self.path}._parts")
        task, runs = TaskContext.get(), []
        system.create_dir(at, recursive=True)
        rows = iter(self._runs(batches))
        while (first := next(rows, None)) is not None:
            name = f"{at}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(runs):06d}"
            press, run = zlib.compressobj(6, zlib.DEFLATED, -15), Run(name, 0, 0, 0, 0)
            with system.open_output_stream(name) as out:
                chunk = first
                while chunk is not None:
                    n, text = chunk
                    raw = text.encode("utf-8")
                    packed = press.compress(raw)
                    out.write(packed)
                    run = Run(name, run.rows + n, run.size + len(raw), run.packed + len(packed), zlib.crc32(raw, run.crc))
                    chunk = next(rows, None) if run.rows + BATCH <= RUN else None
                packed = press.flush(zlib.Z_FULL_FLUSH)
                out.write(packed)
                run.packed += len(packed)
            runs.append(run)
        return Written(task.partitionId(), runs)

    def _runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                cells = [_cells(c) for c in part.columns]
                yield part.num_rows, "".join(f"<row>{''.join(r)}</row>" for r in zip(*cells, strict=True))

    def commit(self, messages: list[Written | None]) -> None:
        runs = [r for m in sorted((m for m in messages if m), key=lambda m: m.task) for r in m.runs]
        sheets: list[list[Run]] = [[]]
        for r in runs:
            if sheets[-1] and sum(x.rows for x in sheets[-1]) + r.rows >= SHEET:
                sheets.append([])
            sheets[-1].append(r)
        system, at = located(self.path)

        def read(file: str) -> Iterator[bytes]:
            with system.open_input_stream(file) as part:
                while raw := part.read(BUFFER):
                    yield raw

        numbers = range(1, len(sheets) + 1)
        small = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in numbers) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="s{k}"/>' for k in numbers) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="styles" Type="{_REL}/styles" Target="styles.xml"/>' + "".join(f'<Relationship Id="s{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>",
            "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        }
        head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{_MAIN}"><sheetData><row>{"".join(map(_said_cell, self.names))}</row>'
        with system.open_output_stream(f"{at}._whole") as out:
            book = _Zip(out)
            for name, text in small.items():
                book.add(name, [_run(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{text}', zlib.Z_FINISH)], read)
            for k, own in zip(numbers, sheets, strict=True):
                book.add(f"xl/worksheets/sheet{k}.xml", [_run(head), *own, _run("</sheetData></worksheet>", zlib.Z_FINISH)], read)
            book.close()
        system.move(f"{at}._whole", at)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        system, at = located(f"{self.path}._parts")
        if system.get_file_info(at).type != arrow_fs.FileType.NotFound:
            system.delete_dir(at)


class BookSource(DataSource):
    """XLSX files (path: a file, or a folder of *.xlsx). Option sheet: only the sheet of this name; else all of them are read."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_workbook"

    def schema(self) -> str:
        names: list[str] = []
        for path, _ in file_sizes(self.options["path"], ".xlsx"):
            with opened(path) as file, zipfile.ZipFile(io.BufferedReader(file) if isinstance(file, io.RawIOBase) else file) as book:
                strings = _Strings(book)
                for name, part in _sheets(book):
                    if self.options.get("sheet") in (None, name):
                        names += [n for n in _names(next(rows_of(book, part, strings), [])) if n not in names]
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)

    def reader(self, schema) -> BookReader:
        return BookReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], schema.names)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a workbook, or of all in a folder, as texts under the names of the first row.

    Sheets are united by name; a blank name is _c and its place, a repeated one gets its place. Rows without a
    cell are left out.
    """
    spark.dataSource.register(BookSource)
    read = spark.read.format(BookSource.name())
    return (read.option("sheet", sheet) if sheet else read).load(path)


def write_workbook(df: DataFrame, path: str) -> None:
    """df as one workbook at path, in place of what is there, in the order of its partitions; rows beyond a sheet's go to the next.

    Whole and decimal numbers, finite doubles, booleans, dates and timestamps become such cells, other values texts; a
    null is an empty cell and an empty text a text. A failed task leaves what was there.
    """
    df.sparkSession.dataSource.register(BookSource)
    df.write.format(BookSource.name()).mode("append").save(path)
