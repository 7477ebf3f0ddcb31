"""Word packages as relations: their XML is shredded into rows once, and checks, safety counts and features are queries on those."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as X
from .docx import DAMAGED, NS, RELS, package_problem

NODE = "struct<part:string,seq:int,tag:string,id:string,value:string,kind:string,inside:array<string>,marks:array<string>,text:string>"
#: Elements that are told; what is worth knowing of the elements around one; kinds of drawings by the address of their data.
TOLD = ("Relationship", "style", "pStyle", "rStyle", "tblStyle", "num", "numId", "bookmarkStart", "comment", "commentReference", "footnoteReference", "instrText", "fldSimple", "mailMerge", "hyperlink", "sdt", "graphicData", "r", "sectPr", "ins", "del", "moveFrom", "moveTo", "oMath", "blip", "p")
AROUND = ("tbl", "txbxContent", "del", "moveFrom", "hyperlink", "sdt", "Fallback", "p", "pPr")
DRAWINGS = {"http://schemas.openxmlformats.org/drawingml/2006/chart": "chart", "http://schemas.openxmlformats.org/drawingml/2006/diagram": "smartart"}
#: Run properties by feature; underlines that are shown as another one.
HIDDEN, EFFECTS = ("vanish",), ("outline", "shadow", "emboss", "imprint", "effect", "bdr", "em", "fitText", "eastAsianLayout")
UNDERLINES = ("words", "dottedHeavy", "dashedHeavy", "dashLong", "dashLongHeavy", "dotDash", "dashDotHeavy", "dotDotDash", "dashDotDotHeavy", "wavyHeavy", "wavyDouble")
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def shredded(data: bytes) -> Iterator[dict]:
    """The told elements of a package's XML parts, in document order."""
    if problem := package_problem(data):
        raise ValueError(problem)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if n.endswith((".xml", ".rels")) and n != "[Content_Types].xml"):
            raw = z.read(name)
            if b"<!DOCTYPE" in raw:
                raise ValueError("a document type is not allowed")
            around: list[str] = []
            n = 0
            for event, x in ET.iterparse(io.BytesIO(raw), ("start", "end")):
                kind = local(x.tag)
                if event == "start":
                    around.append(kind)
                    continue
                around.pop()
                if kind in TOLD:
                    look = x.find(f"{NS}rPr") if kind == "r" else None
                    off = ("0", "false", "off", "none", "nil")
                    marks = [f"{local(p.tag)}={v}" if (v := p.get(f"{NS}val")) is not None else local(p.tag) for p in (look if look is not None else ()) if p.get(f"{NS}val") not in off]
                    if kind == "sdt":
                        marks = [local(p.tag) for p in (x.find(f"{NS}sdtPr") if x.find(f"{NS}sdtPr") is not None else ())]
                    elif kind == "sectPr":
                        marks = [local(p.tag) for p in x]
                    held = {local(k): v for k, v in x.attrib.items()}
                    text = "".join(t.text or "" for t in x.iter(f"{NS}t")) if kind in ("r", "sdt", "p") else x.text if kind == "instrText" else None
                    own = x.get(f"{RELS}id") or x.get(f"{RELS}embed") or held.get("Id") or held.get("styleId") or held.get("numId") or held.get("id")
                    yield {"part": name, "seq": n, "tag": kind, "id": own, "value": held.get("val") or held.get("Target") or held.get("uri") or held.get("instr"), "kind": held.get("TargetMode") or held.get("type"), "inside": [a for a in around if a in AROUND], "marks": marks + ([f"type={held['Type']}"] if "Type" in held else []), "text": text}
                    n += 1


def nodes(files: DataFrame, *, key: str = "key", content: str = "content") -> DataFrame:
    """(key, problem, part, seq, tag, id, value, kind, inside, marks, text) of all packages; one that cannot be read gives one row with its problem."""
    kind = files.schema[key].dataType.simpleString()
    made = pa.list_(to_arrow_type(_parse_datatype_string(NODE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, problems = [], []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(list(shredded(data or b"")))
                    problems.append(None)
                except DAMAGED as e:
                    found.append([])
                    problems.append((str(e) or type(e).__name__)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(problems, pa.string()), pa.array(found, made)], names=[key, "problem", "e"])

    out = files.select(key, content).mapInArrow(run, f"{key} {kind}, problem string, e array<{NODE}>")
    return out.select(key, "problem", F.inline_outer("e"))


def broken(rows: DataFrame, *, key: str = "key") -> DataFrame:
    """(key, problem, name, n): what a package refers to and does not have, and ids that two things have.

    Relationships by part, styles and lists that are not defined, comments and bookmarks of one id.
    """
    tag = F.col("tag")
    home = F.concat(F.regexp_replace("part", r"([^/]+)$", ""), F.lit("_rels/"), F.regexp_extract("part", r"([^/]+)$", 1), F.lit(".rels"))
    used = rows.where(tag.isin("hyperlink", "blip") & F.col("id").isNotNull()).select(key, home.alias("part"), "id")
    have = rows.where(tag == "Relationship").select(key, "part", "id")
    out = [used.join(have, [key, "part", "id"], "left_anti").select(key, F.lit("relationship").alias("problem"), F.col("id").alias("name"))]
    for problem, uses, defines in (("style", ("pStyle", "rStyle", "tblStyle"), "style"), ("list", ("numId",), "num")):
        named = rows.where(tag.isin(*uses) & (F.col("value") != "0")).select(key, F.col("value").alias("name"))
        known = rows.where(tag == defines).select(key, F.col("id").alias("name")).distinct()
        out.append(named.join(known, [key, "name"], "left_anti").select(key, F.lit(problem).alias("problem"), "name"))
    for one in ("bookmarkStart", "comment"):
        named = rows.where(tag == one).select(key, F.lit(f"twice {one}").alias("problem"), F.col("id").alias("name"))
        out.append(named)
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.groupBy(key, "problem", "name").agg(F.count("*").alias("n")).where(~F.col("problem").startswith("twice") | (F.col("n") > 1))


def unsafe(rows: DataFrame, *, key: str = "key") -> DataFrame:
    """(key, fields, links, external): what a package has to lose before it is kept: fields that may not stay fields, links to addresses that a link may not have, other external targets and mail merges."""
    tag, outside = F.col("tag"), (F.col("tag") == "Relationship") & (F.col("kind") == "External")
    link = F.array_contains("marks", f"type={LINK}")
    field = tag.isin("instrText", "fldSimple") & ~X.field_allowed(F.coalesce("text", "value"))
    counts = {"fields": field, "links": outside & link & X.safe_href(F.col("value")).isNull(), "external": (outside & ~link) | (tag == "mailMerge")}
    return rows.where("problem is null").groupBy(key).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()))


def features(rows: DataFrame, *, key: str = "key") -> DataFrame:
    """(key, feature, n, text, seq): what the body of a package has that is not shown or not kept as it is, a row each, for `fidelity.findings`.

    Looks that a run sets itself are told; `looks.features` follows its styles as well.
    """
    body = rows.where(F.col("part") == "word/document.xml")
    tag, marks, inside = F.col("tag"), F.col("marks"), F.col("inside")
    run = (tag == "r") & (F.trim("text") != "") & ~F.arrays_overlap(inside, F.array(F.lit("del"), F.lit("moveFrom"), F.lit("Fallback")))
    name = lambda m: F.split_part(m, F.lit("="), F.lit(1))

    def has(*names: str) -> Column:
        return F.exists(marks, lambda m: name(m).isin(*names))

    scale = F.filter(marks, lambda m: name(m) == "w")
    control = (tag == "sdt") & ~has("checkbox", "docPartObj")
    nested = F.arrays_overlap(inside, F.array(F.lit("tbl"), F.lit("txbxContent")))
    drawing = F.element_at(F.create_map(*(F.lit(x) for kv in DRAWINGS.items() for x in kv)), F.col("value"))
    told = {
        "hidden": run & has(*HIDDEN), "effects": run & has(*EFFECTS), "underline": run & F.exists(marks, lambda m: m.isin(*(f"u={u}" for u in UNDERLINES))), "scale": run & (F.size(scale) > 0) & ~F.array_contains(scale, "w=100"),
        "rtl": run & has("rtl"), "content_control": control & ~nested, "content_control_nested": control & nested, "chart": (tag == "graphicData") & (drawing == "chart"), "smartart": (tag == "graphicData") & (drawing == "smartart"),
        "tracked": tag.isin("ins", "del", "moveFrom", "moveTo") & ~F.array_contains(inside, "Fallback"), "equation": tag == "oMath", "page_borders": (tag == "sectPr") & has("pgBorders"), "line_numbers": (tag == "sectPr") & has("lnNumType"),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in told.items())))
    return body.select(key, F.explode(found).alias("feature"), F.lit(1).alias("n"), F.when(tag.isin("r", "sdt"), F.col("text")).alias("text"), "seq")
