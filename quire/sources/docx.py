"""Word packages: checks, elements, a second reader of the words, and a writer. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: What is no text of its paragraph; what a package may hold.
GONE = ("del", "moveFrom", "Fallback", "txbxContent", "instrText", "rPr", "sdtPr", "footnoteReference")
MOST_ENTRIES, MOST_PART, MOST_UNPACKED, MOST_RATIO, RATIO_FROM = 1000, 50 << 20, 200 << 20, 100, 1 << 20
MOST_PARAGRAPHS = MOST_CELLS = 50_000
CELLS = "array<struct<row:int,col:int,colspan:int,rowspan:int,text:string>>"
LINKS = "array<struct<start:int,end:int,href:string>>"
ELEMENT = f"struct<ord:int,type:string,level:int,content:string,cells:{CELLS},links:{LINKS}>"
#: What a damaged, encrypted or unusually packed file raises.
DAMAGED = (ValueError, KeyError, TypeError, RuntimeError, EOFError, OSError, zlib.error, zipfile.BadZipFile, ET.ParseError)
TARGET = {"caption": "caption", "quote": "quote", "intensequote": "quote", "footnotetext": "footnote"}


def package_problem(data: bytes) -> str | None:
    """Why a file is not an acceptable Word package, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts = z.infolist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return "not a zip"
    if len(parts) > MOST_ENTRIES:
        return "too many entries"
    if "word/document.xml" not in {p.filename for p in parts}:
        return "no document"
    for p in parts:
        if p.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", p.filename):
            return "unsafe path"
        if p.filename.endswith((".xml", ".rels")) and p.file_size > MOST_PART:
            return "large part"
        if p.file_size >= RATIO_FROM and p.file_size > MOST_RATIO * max(1, p.compress_size):
            return "compression ratio"
    return "too large" if sum(p.file_size for p in parts) > MOST_UNPACKED else None


def part(data: bytes, name: str) -> ET.Element | None:
    """A part's root; one with a document type is refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name not in z.namelist():
            return None
        raw = z.read(name)
    if b"<!DOCTYPE" in raw:
        raise ValueError("a document type is not allowed")
    return ET.fromstring(raw)


def inline(node: ET.Element, targets: dict[str, str], href: str | None = None) -> Iterator[tuple[str, str | None]]:
    """(text, address of its link) of a paragraph's pieces in order.

    What was deleted or moved away is left out, and so are the copies that Word keeps for older readers and text in boxes
    of its own; what was inserted stays. A field shows its last result. An equation is its text.
    """
    for x in node:
        kind = x.tag.rpartition("}")[2]
        if kind in GONE:
            continue
        if x.tag in (f"{NS}t", f"{MATH}t"):
            yield x.text or "", href
        elif x.tag == f"{NS}tab" and x.get(f"{NS}val") is None:
            yield "\t", href
        elif x.tag in (f"{NS}br", f"{NS}cr"):
            yield "\n", href
        elif x.tag == f"{MATH}f":  # a fraction
            top, low = ("".join(t for part in x.findall(f"{MATH}{n}") for t, _ in inline(part, targets)) for n in ("num", "den"))
            yield f"({top})/({low})", href
        elif x.tag == f"{NS}hyperlink":
            yield from inline(x, targets, targets.get(x.get(f"{RELS}id") or "") or ("#" + x.get(f"{NS}anchor") if x.get(f"{NS}anchor") else None))
        elif kind != "pPr":
            yield from inline(x, targets, href)


def text_of(node: ET.Element, targets: dict[str, str] | None = None) -> str:
    """Text of a paragraph."""
    return "".join(t for t, _ in inline(node, targets or {}))


def links_of(node: ET.Element, targets: dict[str, str]) -> list[dict]:
    """Places and addresses of a paragraph's links."""
    out, at = [], 0
    for text, href in inline(node, targets):
        if href and text:
            if out and out[-1]["href"] == href and out[-1]["end"] == at:
                out[-1]["end"] = at + len(text)
            else:
                out.append({"start": at, "end": at + len(text), "href": href})
        at += len(text)
    return out


def link_targets(data: bytes) -> dict[str, str]:
    """Addresses of the body's external relationships by id."""
    root = part(data, "word/_rels/document.xml.rels")
    return {r.get("Id") or "": r.get("Target") or "" for r in (root if root is not None else ()) if r.get("TargetMode") == "External"}


def notes(data: bytes) -> list[str]:
    """Texts of footnotes and endnotes, without Word's own separators."""
    out = []
    for name, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
        root = part(data, name)
        for n in root.iter(f"{NS}{tag}") if root is not None else ():
            if n.get(f"{NS}type") in (None, "normal"):
                out.append("\n".join(text_of(p) for p in n.iter(f"{NS}p")).strip())
    return out


def blocks(body: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs and tables of a body or cell, those in content controls too."""
    for x in body:
        if x.tag in (f"{NS}p", f"{NS}tbl"):
            yield x
        elif x.tag in (f"{NS}sdt", f"{NS}sdtContent", f"{NS}ins", f"{NS}customXml"):
            yield from blocks(x)


def table_cells(table: ET.Element) -> list[dict]:
    """Cells of a table with their spans; a cell that continues one above is part of it, and a table in a cell is its text."""
    out: list[dict] = []
    above: dict[int, dict] = {}
    for r, row in enumerate(table.findall(f"{NS}tr")):
        col, open_ = 0, {}
        for c in row.findall(f"{NS}tc"):
            span, merge = c.find(f"{NS}tcPr/{NS}gridSpan"), c.find(f"{NS}tcPr/{NS}vMerge")
            wide = int(span.get(f"{NS}val") or 1) if span is not None else 1
            if merge is not None and merge.get(f"{NS}val") != "restart" and col in above:
                open_[col] = above[col]
                above[col]["rowspan"] += 1
            else:
                text = "\n".join(text_of(b) if b.tag == f"{NS}p" else "\n".join(x["text"] for x in table_cells(b)) for b in blocks(c))
                out.append({"row": r, "col": col, "colspan": wide, "rowspan": 1, "text": text})
                if merge is not None:
                    open_[col] = out[-1]
            col += wide
        above = open_
    return out


def style_levels(data: bytes) -> dict[str, tuple[str, int | None]]:
    """Kind and level of each style: its own name, else that of the style it is based on; cycles end."""
    root = part(data, "word/styles.xml")
    known: dict[str, tuple[str, str | None]] = {}
    for s in root.iter(f"{NS}style") if root is not None else ():
        name, base = s.find(f"{NS}name"), s.find(f"{NS}basedOn")
        known[s.get(f"{NS}styleId") or ""] = ((name.get(f"{NS}val") or "").lower().replace(" ", "") if name is not None else "", base.get(f"{NS}val") if base is not None else None)
    out = {}
    for style in known:
        at, seen = style, set()
        while at in known and at not in seen:
            seen.add(at)
            if m := re.fullmatch(r"heading([1-6])", known[at][0]):
                out[style] = ("heading", int(m[1]))
            elif known[at][0] in TARGET:
                out[style] = (TARGET[known[at][0]], None)
            if style in out:
                break
            at = known[at][1]
    return out


def read(data: bytes) -> list[dict]:
    """Elements of the body in order, then the notes; neighbouring list paragraphs of one numbering are one list."""
    if problem := package_problem(data):
        raise ValueError(problem)
    root, levels, targets, out = part(data, "word/document.xml"), style_levels(data), link_targets(data), []
    if sum(1 for _ in root.iter(f"{NS}p")) > MOST_PARAGRAPHS or sum(1 for _ in root.iter(f"{NS}tc")) > MOST_CELLS:
        raise ValueError("too many paragraphs or cells")
    run: str | None = None

    def put(kind: str, content: str, level: int | None = None, cells: list | None = None, links: list | None = None) -> None:
        out.append({"ord": len(out), "type": kind, "level": level, "content": content, "cells": cells or [], "links": links or []})

    body = root.find(f"{NS}body")
    for node in blocks(body) if body is not None else ():
        if node.tag == f"{NS}tbl":
            cells = table_cells(node)
            put("table", "\n".join("\t".join(c["text"] for c in cells if c["row"] == r) for r in sorted({c["row"] for c in cells})), cells=cells)
            run = None
            continue
        style, number = node.find(f"{NS}pPr/{NS}pStyle"), node.find(f"{NS}pPr/{NS}numPr/{NS}numId")
        kind, level = levels.get(style.get(f"{NS}val") if style is not None else "", ("paragraph", None))
        text, links = text_of(node, targets), links_of(node, targets)
        if any(b.get(f"{NS}type") == "page" for b in node.iter(f"{NS}br")) and not text.strip():
            put("page_break", "")
            run = None
        elif number is not None and kind == "paragraph":
            if run == number.get(f"{NS}val"):
                shift = len(out[-1]["content"]) + 1
                out[-1]["content"] += "\n" + text
                out[-1]["links"] += [k | {"start": k["start"] + shift, "end": k["end"] + shift} for k in links]
            else:
                put("list", text, links=links)
            run = number.get(f"{NS}val")
        else:
            put(kind, text, level, links=links)
            run = None
    for text in notes(data):
        put("footnote", text)
    return out


def source_words(data: bytes) -> list[str]:
    """All words of the body by a reader that shares nothing with `read` but the XML parser: the text nodes, block by block."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        raw = z.read("word/document.xml")
    words: list[str] = []
    buffer: list[str] = []
    for event, node in ET.iterparse(io.BytesIO(raw), ("end",)):
        if node.tag.endswith("}t"):
            buffer.append(node.text or "")
        elif node.tag.endswith(("}tab", "}br")):
            buffer.append(" ")
        elif node.tag.endswith("}p"):
            words += re.findall(r"\w+", "".join(buffer))
            buffer = []
    return words


def table_xml(cells: list[dict], para) -> str:
    """A table's markup: each place that a cell from above covers gets a cell that continues it."""
    rows: dict[int, list[tuple]] = {}
    for c in cells:
        wide, high = c.get("colspan") or 1, c.get("rowspan") or 1
        for k in range(high):
            rows.setdefault(c["row"] + k, []).append((c["col"], wide, "" if high == 1 else '<w:vMerge w:val="restart"/>' if k == 0 else "<w:vMerge/>", (c["text"] or "") if k == 0 else ""))
    made = ("".join(f'<w:tc><w:tcPr><w:gridSpan w:val="{w}"/>{m}</w:tcPr>{para(t)}</w:tc>' for _, w, m, t in sorted(rows[r])) for r in sorted(rows))
    return "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in made) + "</w:tbl>"


def write(elements: list[dict]) -> bytes:
    """A package with these elements (type, level, content, cells)."""
    def para(text: str, style: str = "", number: bool = False) -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ('<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>' if number else "")
        lines = "<w:br/>".join("<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in line.split("\t")) for line in text.split("\n"))
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r>{lines}</w:r></w:p>"

    body = []
    for e in elements:
        kind, text = e["type"], e["content"] or ""
        if kind == "heading":
            body.append(para(text, f"Heading{e['level'] or 1}"))
        elif kind == "list":
            body += [para(x, number=True) for x in text.split("\n")]
        elif kind == "page_break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        elif kind == "table":
            body.append(table_xml(e["cells"], para))
        else:
            body.append(para(text, {"quote": "Quote", "caption": "Caption", "footnote": "FootnoteText"}.get(kind, "")))
    main = NS[1:-1]
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (*((f"Heading{k}", f"heading {k}") for k in range(1, 7)), ("Quote", "Quote"), ("Caption", "caption"), ("FootnoteText", "footnote text")))
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{main}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{main}">{styles}</w:styles>',
    }
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text, zipfile.ZIP_DEFLATED)
    return made.getvalue()


def elements(files: DataFrame, *, key: str = "key", content: str = "content") -> DataFrame:
    """(key, problem, ord, type, level, content, cells): a file that cannot be read gives one row with its problem."""
    kind = files.schema[key].dataType.simpleString()

    made = pa.list_(to_arrow_type(_parse_datatype_string(ELEMENT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, problems = [], []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(read(data or b""))
                    problems.append(None)
                except DAMAGED as e:
                    found.append([])
                    problems.append((str(e) or type(e).__name__)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(problems, pa.string()), pa.array(found, made)], names=[key, "problem", "e"])

    out = files.select(key, content).mapInArrow(run, f"{key} {kind}, problem string, e array<{ELEMENT}>")
    return out.select(key, "problem", F.inline_outer("e"))


def packages(elements: DataFrame, *, key: str) -> DataFrame:
    """(key, content): a package for each document of elements (key, ord, type, level, content, and cells where there are tables); one document must fit in memory."""
    cells = F.col("cells") if "cells" in elements.columns else F.array()
    own = F.struct("ord", "type", "level", "content", F.coalesce(cells.cast(CELLS), F.array().cast(CELLS)).alias("cells"))
    rows = elements.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("e"))
    kind = elements.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write(e) for e in batch.column(1).to_pylist()], pa.binary())], names=[key, "content"])

    return rows.mapInArrow(run, f"{key} {kind}, content binary")
