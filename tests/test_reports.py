"""Comparisons of versions as one relation, manifests, stored exports, new documents, editor values."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import compare, fidelity
from quire.sources import sinks

AT = dt.datetime(2024, 1, 2)


def test_all_that_differs_between_two_versions(spark):
    kind = "doc_id string, element_id string, ord int, type string, level int, content string"
    before = spark.createDataFrame([("d", "a", 0, "heading", 1, "A"), ("d", "b", 1, "paragraph", None, "B"), ("d", "c", 2, "paragraph", None, "C"), ("d", "x", 3, "paragraph", None, "X"), ("same", "a", 0, "paragraph", None, "A")], kind)
    after = spark.createDataFrame([("d", "c", 0, "paragraph", None, "C"), ("d", "a", 1, "heading", 2, "A"), ("d", "b", 2, "paragraph", None, "B!"), ("d", "n", 3, "paragraph", None, "N"), ("same", "a", 0, "paragraph", None, "A")], kind)
    looks = [spark.createDataFrame([("d", t, c, v) for t, c, v in rows], "doc_id string, target string, css string, value string") for rows in ([("P", "color", "red"), ("P", "font-size", "9pt")], [("P", "color", "blue"), ("H", "color", "red")])]
    pages = [spark.createDataFrame([("d", s, "portrait"), ("same", "A4", "portrait")], "doc_id string, size string, orientation string") for s in ("A4", "Letter")]
    got = {tuple(r) for r in compare.document_comparison(before, after, tuple(looks), tuple(pages), ["size", "orientation"]).collect()}
    assert got == {
        ("d", "structure", "a", "retyped", "A", "A"), ("d", "structure", "b", "edited", "B", "B!"), ("d", "structure", "c", "moved", "C", "C"), ("d", "structure", "x", "removed", "X", None), ("d", "structure", "n", "added", None, "N"),
        ("d", "styles", "P color", "changed", "red", "blue"), ("d", "styles", "P font-size", "removed", "9pt", None), ("d", "styles", "H color", "added", None, "red"), ("d", "settings", "size", "changed", "A4", "Letter"),
    }


def test_manifests_are_one_text_a_file(spark):
    item = "array<struct<feature:string,policy:string,n:long,changed:boolean>>"
    rows = [("f", "pdf", None, None), ("f", "import", "verified", [("a", "lossy", 2, False), ("b", "kept", 1, None)]), ("g", "import", "unknown", [])]
    got = {r.key: r.manifest for r in fidelity.manifests(spark.createDataFrame(rows, f"key string, stage string, content string, items {item}").repartition(3), key="key").collect()}
    want = {"import": {"content": "verified", "items": [{"feature": "a", "policy": "lossy", "n": 2, "changed": False}, {"feature": "b", "policy": "kept", "n": 1, "changed": None}]}, "pdf": {"content": None, "items": []}}
    assert json.loads(got["f"]) == want and list(json.loads(got["f"])) == ["import", "pdf"] and json.loads(got["g"]) == {"import": {"content": "unknown", "items": []}}


def test_exports_are_stored_told_and_counted_once(spark, tmp_path):
    rendered = spark.createDataFrame([(1, "d", "w", "docx", b"abc", "one two"), (2, "d", "w", "pdf", b"abcd", "one"), (3, "e", "v", "pdf", b"x", None)], "job int, doc string, workspace string, format string, content binary, text string")
    sources = spark.createDataFrame([("d", "one, two"), ("e", "three")], "doc string, text string")
    for _ in range(2):
        sinks.export_batch(rendered, sources, str(tmp_path), batch=0, at=AT)
    assert {r.key: bytes(r.content) for r in sinks.stored_blobs(spark, f"{tmp_path}/blobs").collect()} == {"jobs/1/output": b"abc", "jobs/2/output": b"abcd", "jobs/3/output": b"x"}
    assert {(r.job, r.size, r.verified) for r in spark.read.parquet(f"{tmp_path}/reports").collect()} == {(1, 3, True), (2, 4, False), (3, 1, None)}
    assert {(r.workspace, r.metric, r.quantity) for r in spark.read.parquet(f"{tmp_path}/usage").collect()} == {("w", "exports", 2), ("v", "exports", 1)}


def test_new_documents_within_the_plan(spark):
    docs = spark.createDataFrame([("a", "w", 1, "{}"), ("b", "w", 2, "{}"), ("c", "w", 3, "{}"), ("d", "v", 1, "{}")], "doc string, workspace string, seq int, json string")
    png = "data:image/png;base64,iVBORw0KGgo="
    images = spark.createDataFrame([("a", 0, png), ("b", 0, png), ("c", 0, png), ("a", 1, "https://example.org/x.png")], "doc string, place int, src string")
    out = sinks.created(docs, spark.createDataFrame([("w", 1)], "workspace string, n int"), images, F.lit(3), at=AT)
    assert sorted(r.doc for r in out["rows"].collect()) == ["a", "b", "d"] and [tuple(r) for r in out["refused"].collect()] == [("c", "w")]
    assert out["assets"].count() == 1 and {(r.doc, r.place, r.src, r.asset_id is not None) for r in out["pictures"].collect()} == {("a", 0, "", True), ("b", 0, "", True), ("a", 1, "https://example.org/x.png", False)}
    assert {(r.doc, r.number, r.kind) for r in out["versions"].collect()} == {("a", 1, "created"), ("b", 1, "created"), ("d", 1, "created")}
    assert {(r.workspace, r.quantity) for r in out["usage"].collect()} == {("w", 2), ("v", 1)}


def test_values_of_an_editor(spark):
    colors = {"rgb(300, 0,7)": "#FF0007", "rgba(1,2,3,0.00)": None, "rgba(1,2,3, .25 )": "#010203", "#AbC": "#ABC", "#abcd": None, "RED": "red", "rgb(1,2)": None, "": None, None: None}
    rows = spark.createDataFrame([(c,) for c in colors], "c string")
    assert {r.c: r.v for r in rows.select("c", X.editor_color(F.col("c")).alias("v")).collect()} == colors
    sizes = {"12": 12.0, "16px": 12.0, "7.5 PT": 7.5, "400.01": None, "0": None, "1.005pt": 1.0, "x": None, "-3": None, "10 em": None}
    rows = spark.createDataFrame([(c,) for c in sizes], "c string")
    got = {r.c: r.v for r in rows.select("c", X.editor_size(F.col("c")).alias("v")).collect()}
    assert {k: v for k, v in got.items() if k != "1.005pt"} == {k: v for k, v in sizes.items() if k != "1.005pt"} and got["1.005pt"] in (1.0, 1.01)
    fonts = {"'Times New Roman', serif": "Times New Roman", "Georgia": "Georgia", "\"\"": None, "a;b": None, "x" * 101: None, "Ñandú 2-b.": "Ñandú 2-b."}
    rows = spark.createDataFrame([(c,) for c in fonts], "c string")
    assert {r.c: r.v for r in rows.select("c", X.editor_font(F.col("c")).alias("v")).collect()} == fonts
