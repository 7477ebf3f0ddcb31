"""Workbooks: a sheet's rows by the names of its header row, and rows written as a sheet. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docx import DAMAGED, part

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MAIN, OFFICE = NS[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def column_of(reference: str) -> int:
    """Number of the column of a cell reference, from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def sheet_rows(data: bytes, first: str, sheet: int = 1) -> Iterator[dict[str, str]]:
    """Rows below the row whose first cell says `first`, up to the first row that is empty there, as header -> text."""
    shared = part(data, "xl/sharedStrings.xml")
    texts = ["".join(t.text or "" for t in s.iter(f"{NS}t")) for s in (shared.findall(f"{NS}si") if shared is not None else ())]
    root = part(data, f"xl/worksheets/sheet{sheet}.xml")
    if root is None:
        raise KeyError(f"no sheet {sheet}")
    header: dict[int, str] | None = None
    for row in root.iter(f"{NS}row"):
        cells = {}
        for c in row.findall(f"{NS}c"):
            value = c.find(f"{NS}v")
            text = "".join(t.text or "" for t in c.iter(f"{NS}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
            cells[column_of(c.get("r"))] = texts[int(text)] if c.get("t") == "s" and text else text
        if header is None:
            header = {k: v for k, v in cells.items() if v} if cells.get(0) == first else None
        elif not cells.get(0):
            return
        else:
            yield {name: cells.get(k, "") for k, name in header.items()}


def table_rows(files: DataFrame, *, first: str, key: str = "key", content: str = "content") -> DataFrame:
    """(key, problem, nth, row) of the sheets of workbooks: row maps each header name to a text."""
    kind = files.schema[key].dataType.simpleString()
    made = pa.list_(pa.map_(pa.string(), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, problems = [], []
            for data in batch.column(1).to_pylist():
                try:
                    found.append([list(r.items()) for r in sheet_rows(data or b"", first)])
                    problems.append(None)
                except DAMAGED as e:
                    found.append([])
                    problems.append((str(e) or type(e).__name__)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(problems, pa.string()), pa.array(found, made)], names=[key, "problem", "rows"])

    out = files.select(key, content).mapInArrow(run, f"{key} {kind}, problem string, rows array<map<string,string>>")
    return out.select(key, "problem", F.posexplode_outer("rows").alias("nth", "row"))


def written(header: list[str], rows: list[list[str]]) -> bytes:
    """A workbook of one sheet with these texts."""
    def line(n: int, cells: list[str]) -> str:
        return f'<row r="{n}">' + "".join(f'<c r="{letters(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(x or "")}</t></is></c>' for k, x in enumerate(cells)) + "</row>"

    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(line(n, r) for n, r in enumerate([header, *rows], 1))}</sheetData></worksheet>',
    }
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text, zipfile.ZIP_DEFLATED)
    return made.getvalue()


def workbooks(rows: DataFrame, *, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, content): a workbook for each key, its rows in order; one workbook must fit in memory. Each is a value of its own, so it is there whole or not at all."""
    kind = rows.schema[key].dataType.simpleString()
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.array(*(F.col(c).cast("string") for c in columns)).alias("r")))).alias("l")).select(key, F.col("l.r").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(columns, r) for r in batch.column(1).to_pylist()], pa.binary())], names=[key, "content"])

    return held.mapInArrow(run, f"{key} {kind}, content binary")
