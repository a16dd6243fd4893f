"""Workbooks: cells of every kind, round trips, required columns, vintages, writes that fail."""

import datetime as dt
import zipfile

import pytest

from anchorline.sources import workbook as W

CELLS = W.SCHEMA


def cells(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def sheet_xml(body):
    return f'<worksheet xmlns="{W.MAIN}"><sheetData>{body}</sheetData></worksheet>'


def test_cells_of_a_foreign_workbook(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{W.MAIN}" xmlns:r="{W.RELATIONS}"><sheets><sheet name="One &amp; two" sheetId="1" r:id="rId7"/><sheet name="Empty" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{W.PACKAGE}/relationships"><Relationship Id="rId7" Type="t" Target="worksheets/a.xml"/><Relationship Id="rId8" Type="t" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{W.MAIN}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{W.MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", sheet_xml('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c></row><row r="4"><c r="A4" s="1"><v>36526</v></c><c r="B4" s="2"><v>36557.5</v></c><c r="C4" s="3"><v>2.5</v></c><c r="D4" t="e"><v>#N/A</v></c><c r="E4" t="b"><v>1</v></c><c r="F4"/><c t="str"><v>sum</v></c></row>'))
        z.writestr("xl/worksheets/b.xml", sheet_xml(""))
    got = [tuple(r) for r in W.read_cells(spark, path.as_uri()).orderBy("row", "column").collect()]
    name = "One & two"
    assert got == [
        (name, 2, 1, "plain", None, None, "text"),
        (name, 2, 28, "rich", None, None, "text"),
        (name, 4, 1, None, 36526.0, dt.date(2000, 1, 1), "date"),
        (name, 4, 2, None, 36557.5, dt.date(2000, 2, 1), "date"),
        (name, 4, 3, None, 2.5, None, "number"),
        (name, 4, 4, "#N/A", None, None, "error"),
        (name, 4, 5, "1", 1.0, None, "boolean"),
        (name, 4, 7, "sum", None, None, "text"),
    ]
    assert W.read_cells(spark, path.as_uri()).rdd.getNumPartitions() == 2 and W.read_cells(spark, path.as_uri(), sheet="Empty").count() == 0
    with pytest.raises(Exception, match="no sheet"):
        W.read_cells(spark, path.as_uri(), sheet="Other").count()


def test_a_table_comes_back(spark, tmp_path):
    rows = [(s, dt.date(2020, m, 1), None if m == 3 else m + 0.1, f"<{s}> & \"q\" {m}", "#N/A" if m == 2 else "ok") for s in ("x", "y & z") for m in range(1, 6)]
    df = spark.createDataFrame(rows, "series string, day date, value double, note string, flag string")
    uri = (tmp_path / "out.xlsx").as_uri()
    W.write_cells(W.table_cells(df, "series", ["day"], ["day", "value", "note", "flag"]), uri)
    back = W.read_cells(spark, uri)
    assert {r["sheet"] for r in back.select("sheet").distinct().collect()} == {"x", "y & z"} and back.filter("kind = 'error'").count() == 2
    long = W.dated_sheet(back, {"value": "v", "flag": "f"}, "day")
    assert sorted((r["sheet"], r["date"], r["value"]) for r in long.filter("series = 'v'").collect()) == [(s, d, v) for s, d, v, _, _ in rows if v is not None]
    assert long.filter("series = 'f' and value is not null").count() == 0
    notes = {r["text"] for r in back.filter("column = 3 and row > 1").collect()}
    assert notes == {r[3] for r in rows}
    with pytest.raises(ValueError, match="missing"):
        W.dated_sheet(back, {"value": "v", "missing": "m"}, "day")
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]
    # Written again it is replaced whole.
    W.write_cells(W.table_cells(df.filter("series = 'x'"), "series", ["day"], ["day", "value"]), uri)
    assert {r["sheet"] for r in W.read_cells(spark, uri).select("sheet").distinct().collect()} == {"x"}


def test_a_write_that_fails_leaves_the_old_file(spark, tmp_path):
    uri = (tmp_path / "book.xlsx").as_uri()
    W.write_cells(cells(spark, [("s", 1, 1, "old", None, None, "text")]), uri)
    for bad in ([("s", 1, 1, "a", None, None, "text"), ("s", 1, 1, "b", None, None, "text")], [("s", 1, 1, None, None, None, "text")], [("s", W.MOST_ROWS + 1, 1, "x", None, None, "text")]):
        with pytest.raises(Exception, match="no value|twice"):
            W.write_cells(cells(spark, bad), uri)
    assert W.read_cells(spark, uri).first()["text"] == "old" and [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]


def test_newest_vintage(spark, tmp_path):
    for v in ("20240131", "20240229", "latest", "2025"):
        (tmp_path / v).mkdir()
        W.write_cells(cells(spark, [("s", 1, 1, v, None, None, "text")]), (tmp_path / v / "data.xlsx").as_uri())
    assert W.read_cells(spark, W.newest_workbook(spark, tmp_path.as_uri(), "data.xlsx")).first()["text"] == "20240229"
    with pytest.raises(ValueError, match="no vintage"):
        W.newest_workbook(spark, tmp_path.as_uri(), "other.xlsx")


def test_names_of_columns():
    assert [W.column_name(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(W.column_number(f"{W.column_name(n)}7") == n for n in range(1, 2000))
