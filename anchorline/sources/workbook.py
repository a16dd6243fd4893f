"""Spreadsheets (zipped sheet XML) as a Spark data source, both ways.

``spark.read.format("workbook").load(uri)`` gives sheet, row, column (from 1), text, number, date, kind of every cell that has a value: one
partition a sheet, parsed as a stream. Kinds are text, number, date, boolean and error (markers such as ``#N/A`` are texts of that kind). The
option ``sheet`` names one sheet. Written are rows of the same columns, each sheet by one task; the commit puts the parts together under
another name and then moves the file, so readers see the old one or the new one.
"""

from __future__ import annotations

import re
import shutil
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, datetime, timedelta
from typing import NamedTuple
from uuid import uuid4
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from anchorline.sources.cubes import opened

SCHEMA = "sheet string, row int, column int, text string, number double, date date, kind string"
# The format's name spaces, its rows of a sheet, the day that serial numbers count from, and its built-in date formats.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS, EPOCH, EPOCH_1904 = 1_048_576, date(1899, 12, 30), date(1904, 1, 1)
DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def text_of(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(tag("t")))


class Book(NamedTuple):
    sheets: dict[str, str]  # name to member
    texts: list[str]
    dates: set[int]  # styles that show dates
    epoch: date


def book_of(archive: zipfile.ZipFile) -> Book:
    root = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    sheets = {s.get("name"): place(targets[s.get(f"{{{RELATIONS}}}id")]) for s in root.iter(tag("sheet"))}
    held = set(archive.namelist())
    texts = []
    if "xl/sharedStrings.xml" in held:
        with archive.open("xl/sharedStrings.xml") as file:
            for _, e in ElementTree.iterparse(file):
                if e.tag == tag("si"):
                    texts.append(text_of(e))
                    e.clear()
    dates: set[int] = set()
    if "xl/styles.xml" in held:
        styles = ElementTree.fromstring(archive.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in styles.iter(tag("numFmt")) if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
        cells = styles.find(tag("cellXfs"))
        dates = {k for k, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in own | DATE_FORMATS}
    return Book(sheets, texts, dates, EPOCH_1904 if (p := root.find(tag("workbookPr"))) is not None and p.get("date1904") in ("1", "true") else EPOCH)


def cells_of(file, book: Book) -> Iterator[tuple]:  # noqa: ANN001
    """row, column, text, number, date, kind of the cells of one sheet, a row in memory at a time."""
    row = 0
    for event, e in ElementTree.iterparse(file, ("start", "end")):
        if event == "start" and e.tag == tag("row"):
            row, column = int(e.get("r", row + 1)), 0
        elif event == "end" and e.tag == tag("c"):
            column = column_number(e.get("r")) if e.get("r") else column + 1
            kind, v = e.get("t", "n"), e.find(tag("v"))
            raw = text_of(e) if kind == "inlineStr" else None if v is None else v.text
            if raw is None or raw == "" and kind != "inlineStr":
                continue
            if kind == "s":
                yield row, column, book.texts[int(raw)], None, None, "text"
            elif kind in ("str", "inlineStr"):
                yield row, column, raw, None, None, "text"
            elif kind == "e":
                yield row, column, raw, None, None, "error"
            elif kind == "b":
                yield row, column, raw, float(raw), None, "boolean"
            elif kind == "d":
                yield row, column, None, None, datetime.fromisoformat(raw.rstrip("Z")).date(), "date"
            elif int(e.get("s", 0)) in book.dates:
                yield row, column, None, float(raw), book.epoch + timedelta(days=int(float(raw))), "date"
            else:
                yield row, column, None, float(raw), None, "number"
        elif event == "end" and e.tag == tag("row"):
            e.clear()


class Sheet(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class SheetReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.sheet = options["path"], options.get("sheet")

    def partitions(self) -> list[Sheet]:
        with zipfile.ZipFile(opened(self.uri)) as archive:
            names = [n for n in book_of(archive).sheets if self.sheet in (None, n)]
        if not names:
            raise ValueError(f"no sheet {self.sheet} in {self.uri}")
        return [Sheet(n) for n in names]

    def read(self, part: Sheet) -> Iterator[tuple]:
        with zipfile.ZipFile(opened(self.uri)) as archive:
            book = book_of(archive)
            with archive.open(book.sheets[part.name]) as file:
                for cell in cells_of(file, book):
                    yield part.name, *cell


class Parts(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str]]) -> None:
        self.parts = parts


class SheetWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.uri, self.folder = options["path"], f"{options['path']}.parts-{uuid4().hex}"

    def write(self, rows: Iterator) -> Parts:
        """The sheets of one task, a row at a time; ValueError if rows are not in order, a cell has no value, or a sheet has too many rows."""
        store, folder = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(folder)
        parts, out, sheet, at = [], None, None, (0, 0)
        for r in rows:
            if r.sheet != sheet:
                if out is not None:
                    self.finish(out, at[0])
                if r.sheet in {n for n, _ in parts}:
                    raise ValueError(f"rows of sheet {r.sheet} do not stand together")
                sheet, at, path = r.sheet, (0, 0), f"{folder}/{uuid4().hex}.xml"
                out = store.open_output_stream(path)
                out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                parts.append((sheet, path))
            if (r.row, r.column) <= at or r.row > MOST_ROWS:
                raise ValueError(f"cell {r.row}, {r.column} of sheet {sheet} is out of order, twice there, or beyond the last row")
            if r.row != at[0]:
                out.write(f'{"</row>" if at[0] else ""}<row r="{r.row}">'.encode())
            at = (r.row, r.column)
            name = f"{column_name(r.column)}{r.row}"
            if r.date is not None:
                out.write(f'<c r="{name}" s="1"><v>{(r.date - EPOCH).days}</v></c>'.encode())
            elif r.number is not None:
                out.write(f'<c r="{name}"><v>{float(r.number)!r}</v></c>'.encode())
            elif r.text is None:
                raise ValueError(f"cell {name} of sheet {sheet} has no value")
            elif r.kind == "error":
                out.write(f'<c r="{name}" t="e"><v>{escape(r.text)}</v></c>'.encode())
            else:
                out.write(f'<c r="{name}" t="inlineStr"><is><t xml:space="preserve">{escape(r.text)}</t></is></c>'.encode())
        if out is not None:
            self.finish(out, at[0])
        return Parts(parts)

    @staticmethod
    def finish(out, rows: int) -> None:  # noqa: ANN001
        out.write(f"{'</row>' if rows else ''}</sheetData></worksheet>".encode())
        out.close()

    def commit(self, messages: list[Parts | None]) -> None:
        """Put the parts together as a stream and move the file to its place."""
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        names = [n for n, _ in parts]
        if len(set(names)) < len(names):
            raise ValueError("a sheet was written by two tasks")
        store, folder = pafs.FileSystem.from_uri(self.folder)
        _, target = pafs.FileSystem.from_uri(self.uri)
        store.create_dir(folder)
        numbers = range(1, len(parts) + 1)
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, names, strict=True))
        related = "".join(f'<Relationship Id="rId{k}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in numbers)
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        fixed = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{listed}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{related}<Relationship Id="rId{len(parts) + 1}" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
        }
        made = f"{folder}/book"
        with store.open_output_stream(made) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in fixed.items():
                archive.writestr(name, head + text)
            for k, (_, path) in zip(numbers, parts, strict=True):
                with store.open_input_stream(path) as source, archive.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as sheet:
                    shutil.copyfileobj(source, sheet, 1 << 20)
        store.move(made, target)
        store.delete_dir(folder)

    def abort(self, messages: list[Parts | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.folder)
        if store.get_file_info(folder).type != pafs.FileType.NotFound:
            store.delete_dir(folder)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:  # noqa: ANN001
        return SheetReader(self.options)

    def writer(self, schema, overwrite: bool) -> SheetWriter:  # noqa: ANN001
        return SheetWriter(self.options)


def read_cells(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").options(**options).load(uri)


def write_cells(cells: DataFrame, uri: str) -> None:
    """``cells`` (sheet, row, column, text, number, date, kind) as a workbook; each sheet by one task, as the format has it."""
    cells.sparkSession.dataSource.register(Workbook)
    named = cells.select(*[f"{x.split()[0]}" for x in SCHEMA.split(", ")])
    named.repartition("sheet").sortWithinPartitions("sheet", "row", "column").write.format("workbook").mode("append").save(uri)


def table_cells(df: DataFrame, sheet: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cells of a table with a header, one sheet for each value of the column ``sheet``, its rows in the order of ``order``."""
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] in ("double", "float", "int", "bigint", "long")
    at = F.row_number().over(Window.partitionBy(sheet).orderBy(*order)) + 1
    cell = lambda k, c: F.struct(
        F.lit(k).alias("column"),
        (F.lit(None).cast("string") if numeric(c) or kinds[c] == "date" else F.col(f"`{c}`").cast("string")).alias("text"),
        (F.col(f"`{c}`").cast("double") if numeric(c) else F.lit(None).cast("double")).alias("number"),
        (F.col(f"`{c}`") if kinds[c] == "date" else F.lit(None).cast("date")).alias("date"),
    )
    body = df.withColumn("row", at).select(F.col(f"`{sheet}`").alias("sheet"), "row", F.explode(F.array(*[cell(k, c) for k, c in enumerate(columns, 1)])).alias("c")).select("sheet", "row", "c.*")
    body = body.filter("text is not null or number is not null or date is not null")
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.lit(c).alias("text")) for k, c in enumerate(columns, 1)])).alias("c")
    head = df.select(F.col(f"`{sheet}`").alias("sheet")).distinct().select("sheet", F.lit(1).alias("row"), names).select("sheet", "row", "c.column", "c.text", F.lit(None).cast("double").alias("number"), F.lit(None).cast("date").alias("date"))
    kind = F.when(F.col("date").isNotNull(), "date").when(F.col("number").isNotNull(), "number").when(F.rlike("text", F.lit(r"^#(N/A|REF!|DIV/0!|VALUE!|NUM!|NAME\?|NULL!)$")), "error").otherwise("text")
    return head.unionByName(body).withColumn("kind", kind)


def dated_sheet(cells: DataFrame, columns: dict[str, str], dates: str, header: int = 1) -> DataFrame:
    """sheet, date, series, value of sheets with a header: ``columns`` names series by their headers, ``dates`` is the header of the dates.

    Markers and texts are null values; rows without a date are left out. ValueError names sheets and headers that are required and
    not there.
    """
    heads = cells.filter(F.col("row") == header).select("sheet", "column", F.trim("text").alias("head"))
    wanted = [dates, *columns]
    held = heads.filter(F.col("head").isin(wanted)).groupBy("sheet").agg(F.collect_set("head").alias("held"))
    short = cells.select("sheet").distinct().join(held, "sheet", "left").withColumn("lacks", F.array_except(F.array(*[F.lit(c) for c in wanted]), F.coalesce("held", F.array().cast("array<string>")))).filter("size(lacks) > 0")
    lacking = sorted((r["sheet"], r["lacks"]) for r in short.select("sheet", "lacks").limit(5).collect())
    if lacking:
        raise ValueError(f"sheets lack columns: {lacking}")
    body = cells.filter(F.col("row") > header).join(heads.filter(F.col("head").isin(wanted)), ["sheet", "column"])
    days = body.filter((F.col("head") == dates) & F.col("date").isNotNull()).select("sheet", "row", "date")
    names = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    values = body.filter(F.col("head") != dates).select("sheet", "row", names[F.col("head")].alias("series"), F.when(F.col("kind") == "number", F.col("number")).alias("value"))
    return days.join(values, ["sheet", "row"]).select("sheet", "date", "series", "value")


def newest_workbook(spark: SparkSession, root: str, name: str) -> str:
    """The file ``root``/vintage/``name`` of the newest vintage, by the folders' names of eight digits. ValueError if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{name}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    dated = [(f.getPath().getParent().getName(), f.getPath().toString()) for f in found]
    dated = [d for d in dated if re.fullmatch(r"\d{8}", d[0])]
    if not dated:
        raise ValueError(f"no vintage below {root} has {name}")
    return max(dated)[1]
