"""Markdown into elements: headings, paragraphs, lists, quotes, code, tables, rules; inline marks and safe links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

RUN = "struct<text:string,marks:array<string>,href:string>"
ELEMENT = f"struct<ord:int,type:string,level:int,content:string,runs:array<{RUN}>,items:array<struct<level:int,ordered:boolean,checked:boolean,text:string>>,cells:array<struct<row:int,col:int,header:boolean,text:string>>>"
#: Characters of the texts whose elements are handed on together.
AT_ONCE = 1 << 18
SAFE = re.compile(r"(?i)(https?|ftps?|mailto|tel|callto|sms|xmpp):|www\.")
INLINE = re.compile(r"\\(?P<mark>[!-/:-@\[-`{-~])|(?P<code>`+)(?P<c>.+?)(?P=code)|!\[(?P<alt>[^\]\n]*)\]\([^)\n]*\)|\[(?P<label>[^\]\n]+)\]\((?P<href>[^)\s]+)[^)\n]*\)|(?P<strike>~~)(?P<s>.+?)~~|(?P<bold>\*\*|__)(?P<b>.+?)(?P=bold)|(?P<it>[*_])(?P<i>[^*_\s].*?)(?P=it)", re.S)
FENCE, ATX = re.compile(r" {0,3}(`{3,}|~{3,})"), re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
RULE, ITEM = re.compile(r" {0,3}([-*_])(?:\s*\1){2,}\s*$"), re.compile(r"(\s*)(?:([-*+])|(\d{1,9})[.)])\s+(.*)")
DELIMITER, SETEXT = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"), re.compile(r" {0,3}(=+|-+)\s*$")


def inline(text: str, marks: tuple[str, ...] = ()) -> list[dict]:
    """Runs of a line of Markdown; a link that may not be followed keeps its text only, a picture goes, a mark behind a backslash is itself."""
    out, at = [], 0
    for m in INLINE.finditer(text):
        if m.start() > at:
            out.append({"text": text[at : m.start()], "marks": list(marks), "href": None})
        at = m.end()
        if m["mark"]:
            out.append({"text": m["mark"], "marks": list(marks), "href": None})
        elif m["code"]:
            out.append({"text": m["c"].strip(), "marks": [*marks, "code"], "href": None})
        elif m["label"]:
            safe = SAFE.match(m["href"]) is not None
            for run in inline(m["label"], (*marks, "link") if safe else marks):
                out.append(run | ({"href": m["href"]} if safe else {}))
        elif m["strike"] or m["bold"] or m["it"]:
            kind = "strike" if m["strike"] else "bold" if m["bold"] else "italic"
            out.extend(inline(m["s"] or m["b"] or m["i"], (*marks, kind)))
    if at < len(text):
        out.append({"text": text[at:], "marks": list(marks), "href": None})
    return [r for r in out if r["text"]]


def plain(text: str) -> str:
    return "".join(r["text"] for r in inline(text))


def row_cells(line: str) -> list[str]:
    return [plain(c.strip()) for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def parse(text: str) -> list[dict]:
    """Elements in order; a soft line break is a blank."""
    lines, out, k = text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), [], 0

    def put(kind: str, content: str, **more) -> None:
        out.append({"ord": len(out), "type": kind, "level": None, "content": content, "runs": [], "items": [], "cells": []} | more)

    def opens(line: str) -> bool:
        return not line.strip() or bool(FENCE.match(line) or ATX.match(line) or RULE.match(line) or ITEM.match(line) or line.lstrip().startswith(">"))

    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif fence := FENCE.match(line):
            body, k = [], k + 1
            while k < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[k]):
                body.append(lines[k])
                k += 1
            put("code_block", "\n".join(body))
            k += 1
        elif head := ATX.match(line):
            runs = inline(head[2] or "")
            put("heading", "".join(r["text"] for r in runs), level=len(head[1]), runs=runs)
            k += 1
        elif RULE.match(line):
            put("horizontal_rule", "")
            k += 1
        elif line.lstrip().startswith(">"):
            body = []
            while k < len(lines) and lines[k].lstrip().startswith(">"):
                body.append(lines[k].lstrip()[1:].removeprefix(" "))
                k += 1
            runs = inline(" ".join(x.strip() for x in body if x.strip()))
            put("quote", "".join(r["text"] for r in runs), runs=runs)
        elif ITEM.match(line):
            items: list[dict] = []
            stack: list[int] = []
            while k < len(lines) and lines[k].strip():
                if m := ITEM.match(lines[k]):
                    indent = len(m[1].expandtabs(4))
                    while stack and indent < stack[-1]:
                        stack.pop()
                    if not stack or indent > stack[-1] + 1:
                        stack.append(indent)
                    box = re.match(r"\[([ xX])\]\s+(.*)", m[4])
                    items.append({"level": len(stack) - 1, "ordered": m[3] is not None, "checked": box[1] != " " if box else None, "text": box[2] if box else m[4]})
                else:
                    items[-1]["text"] += " " + lines[k].strip()
                k += 1
            for i in items:
                i["text"] = plain(i["text"])
            put("list", "\n".join(i["text"] for i in items), items=items)
        elif "|" in line and k + 1 < len(lines) and DELIMITER.match(lines[k + 1]) and "-" in lines[k + 1]:
            rows, k = [row_cells(line)], k + 2
            while k < len(lines) and "|" in lines[k]:
                rows.append(row_cells(lines[k]))
                k += 1
            cells = [{"row": r, "col": c, "header": r == 0, "text": t} for r, row in enumerate(rows) for c, t in enumerate((row + [""] * len(rows[0]))[: len(rows[0])])]
            put("table", "\n".join("\t".join(r) for r in rows), cells=cells)
        else:
            body, level = [line.strip()], None
            k += 1
            while k < len(lines) and not level:
                if under := SETEXT.match(lines[k]):
                    level = 1 if under[1][0] == "=" else 2
                elif opens(lines[k]):
                    break
                else:
                    body.append(lines[k].strip())
                k += 1
            runs = inline(" ".join(body))
            put("heading" if level else "paragraph", "".join(r["text"] for r in runs), level=level, runs=runs)
    return out


def elements(docs: DataFrame, *, doc: str, text: str) -> DataFrame:
    """(doc, ord, type, level, content, runs, items, cells) of Markdown texts; a null text has no elements.

    Elements are handed on as soon as the texts they are from have AT_ONCE characters, so a task's Python holds those of a few
    texts, however many rows a batch has.
    """
    kind = docs.schema[doc].dataType.simpleString()

    made_of = pa.list_(to_arrow_type(_parse_datatype_string(ELEMENT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size, begin = [], 0, 0
            for k, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                made.append(parse(text))
                size += len(text)
                if size >= AT_ONCE or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(made)), pa.array(made, made_of)], names=[doc, "e"])
                    made, size, begin = [], 0, k + 1

    made = docs.select(doc, text).mapInArrow(run, f"{doc} {kind}, e array<{ELEMENT}>")
    return made.select(doc, F.inline("e"))
