"""Workbooks as tables of cells, and tables as workbooks.

A cell is a row (path, sheet, row, col, kind, value), so any number of workbooks are read in parallel
and a sheet is streamed, never held whole. Every row element also gives one cell with a null column, so
blank rows stay. A file that is no workbook gives no cells.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KINDS = {"s": "text", "str": "text", "inlineStr": "text", "b": "bool", "e": "error", "d": "date"}
CELL = "path string, sheet string, row long, col int, kind string, value string"
#: Cells in one Arrow batch.
BATCH = 20_000


def _closed(z: zipfile.ZipFile, part: str, *tags: str):
    """Elements of these names as their end tags pass; each is emptied once its user is done with it."""
    if part in z.namelist():
        with z.open(part) as f:
            for _, element in ElementTree.iterparse(f):
                if element.tag.rpartition("}")[2] in tags:
                    yield element
                    element.clear()


def _texts(element) -> str:
    """Text of plain and rich strings; phonetic hints are no text."""
    hints = {id(t) for hint in element.iter(f"{{{MAIN}}}rPh") for t in hint.iter()}
    return "".join(t.text or "" for t in element.iter(f"{{{MAIN}}}t") if id(t) not in hints)


def _sheet_cells(z: zipfile.ZipFile, part: str, strings: list[str]):
    """(row, col, kind, value) of a sheet; numbers of rows and columns that are left out follow on from the last ones."""
    number = 0
    for row in _closed(z, part, "row"):
        number = int(row.get("r", number + 1))
        yield number, None, None, None
        col = 0
        for c in row:
            letters = c.get("r", "").rstrip("0123456789")
            col = reduce(lambda n, x: 26 * n + int(x, 36) - 9, letters, 0) or col + 1
            kind, held = c.get("t", "n"), c.find(f"{{{MAIN}}}is" if c.get("t") == "inlineStr" else f"{{{MAIN}}}v")
            if held is not None:
                value = _texts(held) if kind == "inlineStr" else held.text or ""
                yield number, col, KINDS.get(kind, "number"), strings[int(value)] if kind == "s" else value


def _workbook_cells(path: str, data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {x.get("Id"): posixpath.normpath(posixpath.join("/xl", x.get("Target"))).lstrip("/") for x in _closed(z, "xl/_rels/workbook.xml.rels", "Relationship")}
        sheets = [(x.get("name"), targets.get(x.get(f"{{{OFFICE}}}id"))) for x in _closed(z, "xl/workbook.xml", "sheet")]
        strings = [_texts(x) for x in _closed(z, "xl/sharedStrings.xml", "si")]
        for name, part in sheets:
            for cell in _sheet_cells(z, part, strings):
                yield path, name, *cell


def _read(batches):
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
    emit = lambda cells: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*cells, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not zipfile.is_zipfile(io.BytesIO(data)):
                continue
            held = []
            for cell in _workbook_cells(path, data):
                held.append(cell)
                if len(held) == BATCH:
                    yield emit(held)
                    held = []
            if held:
                yield emit(held)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of all sheets of the workbooks at ``path`` (a file, folder or glob)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, CELL)


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a sheet (by name; else the one that the first cell is in) below its first row, which gives the names.

    Missing cells are empty strings; columns without a name are called column1 and so on by their place. Several workbooks must share their header.
    """
    found = cells(spark, path)
    if sheet is None:
        first = found.select("sheet").first()
        sheet = first["sheet"] if first else ""
    found = found.where(F.col("sheet") == sheet)
    head = found.where("col is not null").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("x"), F.max("col").alias("width")).orderBy("row").first()  # at most 16,384 columns by the format
    if head is None:
        return spark.createDataFrame([], "column1 string")
    names = [head["x"].get(k) or f"column{k}" for k in range(1, head["width"] + 1)]
    rows = found.where(F.col("row") > head["row"]).groupBy("path", "row").agg(F.map_from_entries(F.collect_list(F.when(F.col("col") <= len(names), F.struct("col", "value")))).alias("x"))
    values = [F.coalesce(F.try_element_at("x", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names, 1)]
    return rows.orderBy("path", "row").select(*values)


def workbook(header: list[str], rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet. Numbers and truth values keep their type, None is an empty cell; a cell's place is its order."""

    def cell(x) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, bool):
            return f'<c t="b"><v>{int(x)}</v></c>'
        if isinstance(x, (int, float)):
            return f"<c><v>{x}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    def links(*pairs) -> str:
        return f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r1" Type="{OFFICE}/{kind}" Target="{target}"/>' for kind, target in pairs) + "</Relationships>"

    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/sheet.xml" ContentType="{kind}.worksheet+xml"/>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types">{types}</Types>',
        "_rels/.rels": links(("officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": links(("worksheet", "sheet.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/sheet.xml": f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [header, *rows]) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
    return out.getvalue()
