import datetime as dt
import pathlib
import zipfile

import pytest
from pyspark.sql import functions as F

from hearthframe.sources import files, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def texts(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_round_trip(spark, tmp_path):
    day, at = dt.date(2024, 3, 5), dt.datetime(2024, 3, 5, 13, 30, 15)
    rows = [(1, "ñandú <&> \"'", 3, 1.5, True, day, at), (2, "", None, -0.1, False, None, None), (3, None, 2**40, float("nan"), None, dt.date(1900, 3, 1), dt.datetime(1999, 12, 31)), (4, " _x0041_ a\x01b\r\nc\t ", 0, 1e300, True, day, at), (5, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, `Baños` string, n long, x double, ok boolean, day date, at timestamp").repartition(3, "id")
    path = f"{tmp_path}/book.xlsx"
    for _ in range(2):  # the second one replaces the first
        workbook.write_workbook(df, path)
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]
    got = workbook.read_workbook(spark, path)
    assert got.columns == df.columns
    want = [(str(r[0]), r[1], r[2] and str(r[2]) or (None if r[2] is None else "0"), None if r[3] is None else str(r[3]), None if r[4] is None else str(r[4]).lower(), r[5] and str(r[5]), r[6] and (str(r[6]) if r[6].time() != dt.time() else str(r[6].date()))) for r in rows]
    assert texts(got, "id") == want
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None


def test_many_runs_and_sheets(spark, tmp_path, monkeypatch):
    df = spark.range(0, 30_000, 1, 5).selectExpr("id", "concat('row ', id) AS name")
    path = f"{tmp_path}/book.xlsx"
    workbook.write_workbook(df, path)
    assert texts(workbook.read_workbook(spark, path).select(F.col("id").cast("int"), "name"), "id") == [(k, f"row {k}") for k in range(30_000)]
    with zipfile.ZipFile(path) as book:
        order = [r[0] for r in workbook.rows_of(book, "xl/worksheets/sheet1.xml", workbook._Strings(book))]
        assert order == ["id", *map(str, range(30_000))]
    writer = workbook.BookWriter(path, ["id"])
    monkeypatch.setattr(workbook, "SHEET", 30)
    (tmp_path / "book.xlsx._parts").mkdir()
    runs = []
    for k in range(4):
        run = workbook._run("".join(f"<row><c><v>{k * 10 + j}</v></c></row>" for j in range(10)))
        (tmp_path / f"book.xlsx._parts/{k}").write_bytes(run.raw)
        runs.append(workbook.Run(f"{tmp_path}/book.xlsx._parts/{k}", 10, run.size, run.packed, run.crc))
    writer.commit([workbook.Written(1, runs[2:]), None, workbook.Written(0, runs[:2])])
    got = workbook.read_workbook(spark, path)
    assert got.rdd.getNumPartitions() == 2 and sorted(int(r.id) for r in got.collect()) == list(range(40))
    assert workbook.read_workbook(spark, path, "Sheet2").count() == 20


def test_shared_strings_styles_and_gaps(spark, tmp_path):
    """What other programs write: shared strings in runs, cells by reference, formats of dates, errors, blank names."""
    path = f"{tmp_path}/other.xlsx"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{rel}"><workbookPr date1904="1"/><sheets><sheet name="Datos" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}><si><t>nombre</t></si><si><r><t>Belgrano</t></r><r><rPr><b/></rPr><t xml:space="preserve"> R</t></r><rPh><t>x</t></rPh></si><si><t/></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="[Red]0.00&quot;day&quot;"/><numFmt numFmtId="171" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="str"><v>nombre</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="2"><v>1</v></c><c r="C3" s="1"><v>45000</v></c></row><row r="4"/><row r="5"><c r="C5" t="e"><v>#N/A</v></c><c r="A5" t="s"><v>2</v></c></row></sheetData></worksheet>')
    got = workbook.read_workbook(spark, path)
    assert got.columns == ["nombre", "_c1", "nombre_2"]
    assert sorted(map(tuple, got.collect())) == [("", None, None), ("Belgrano R", "1904-01-02", "45000")]
    assert files.read_chain(spark, path).count() == 2


def test_strings_on_disk(tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "HELD", 100)
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>é{k}</t></si>" for k in range(999)) + "</sst>")
    with zipfile.ZipFile(tmp_path / "s.xlsx") as z:
        strings = workbook._Strings(z)
        assert [strings[k] for k in (998, 0, 500)] == ["é998", "é0", "é500"] and strings.data._rolled


def test_failures_and_empty_tables(spark, tmp_path):
    path = pathlib.Path(f"{tmp_path}/book.xlsx")
    df = spark.range(4).selectExpr("id", "CAST(id AS STRING) AS t")
    workbook.write_workbook(df.limit(0), str(path))
    empty = workbook.read_workbook(spark, str(path))
    assert empty.columns == ["id", "t"] and empty.count() == 0
    before = path.read_bytes()
    with pytest.raises(Exception, match="no"):
        workbook.write_workbook(df.withColumn("t", F.when(F.col("id") == 3, F.raise_error("no")).otherwise(F.col("t"))), str(path))
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]
