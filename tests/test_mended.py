"""Cases in which an operator once gave a wrong answer."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import fidelity, rules, tree
from quire.sources import docx
from quire.streaming import metering as SM


def at(day, hour, minute):
    return dt.datetime(2024, 1, day, hour, minute)


def test_refusals_over_several_batches(spark, tmp_path):
    """Hits of an earlier window in a later batch do not disturb the later window's count."""
    batches = [[(1, at(1, 10, 50)), (2, at(1, 11, 1)), (3, at(1, 11, 2)), (4, at(1, 11, 3))], [(5, at(1, 10, 55)), (6, at(1, 11, 4))], [(7, at(1, 10, 56)), (8, at(1, 10, 57)), (9, at(3, 9, 0))], [(10, at(3, 9, 1))]]
    for rows in batches:
        spark.createDataFrame([(e, 7, t) for e, t in rows], "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = SM.refusals(SM.event_stream(spark, f"{tmp_path}/in", per_trigger=1), key="user_id", limit=3, seconds=3600)
    SM.drained(out, f"{tmp_path}/out", mode="append", checkpoint=f"{tmp_path}/state")
    got = spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.event_id, r.nth) for r in got) == [(6, 4), (8, 4)]


def test_upsert_keeps_the_latest_of_each_key(spark, tmp_path):
    put = SM.upsert(f"{tmp_path}/state", ["k"], "seq", buckets=4)
    kind = "k int, seq int, status string"
    batches = [[(1, 5, "a"), (2, 1, "b"), (2, 2, "c")], [(1, 4, "late"), (3, 1, "d")], [], [(2, 3, "e"), (1, 5, "a")]]
    for epoch, rows in enumerate(batches):
        put(spark.createDataFrame(rows, kind), epoch)
        put(spark.createDataFrame(rows, kind), epoch)  # a batch that is run again
    assert sorted(map(tuple, SM.upserted(spark, f"{tmp_path}/state").select("k", "seq", "status").collect())) == [(1, 5, "a"), (2, 3, "e"), (3, 1, "d")]


def test_tables_are_written(spark):
    cells = [{"row": 0, "col": 0, "colspan": 2, "rowspan": 1, "text": "a"}, {"row": 1, "col": 0, "colspan": 1, "rowspan": 1, "text": "b"}, {"row": 1, "col": 1, "colspan": 1, "rowspan": 1, "text": "c"}]
    rows = spark.createDataFrame([("d", 0, "table", None, "a\nb\tc", [tuple(c.values()) for c in cells]), ("d", 1, "paragraph", None, "x", None)], f"key string, ord int, type string, level int, content string, cells {docx.CELLS}")
    got = docx.elements(docx.packages(rows, key="key")).orderBy("ord").collect()
    assert [c.asDict() for c in got[0].cells] == cells and got[0].content == "a\nb\tc" and got[1].content == "x"


def test_damaged_and_encrypted_packages_are_problems(spark):
    whole = docx.write([{"type": "paragraph", "level": None, "content": "words " * 500, "cells": []}])
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        place = z.getinfo("word/document.xml").header_offset
    damaged = bytearray(whole)
    damaged[place + 60 : place + 90] = b"\xff" * 30
    locked = bytearray(whole)
    for k in range(len(locked) - 4):
        if locked[k : k + 4] == b"PK\x01\x02":
            locked[k + 8] |= 1
        if locked[k : k + 4] == b"PK\x03\x04":
            locked[k + 6] |= 1
    files = [("whole", whole), ("damaged", bytes(damaged)), ("locked", bytes(locked)), ("half", whole[: len(whole) // 2]), ("none", None), ("text", b"hello")]
    got = {r.key: r.problem for r in docx.elements(spark.createDataFrame(files, "key string, content binary")).collect()}
    assert got.pop("whole") is None and all(got.values()) and len(got) == 5


def test_operations_leave_what_they_should(spark):
    e = spark.createDataFrame([("d", k, x) for k, x in enumerate("ab")] + [("r", k, x) for k, x in enumerate("ab")], "doc_id string, ord int, element_id string")
    kind = "doc_id string, seq int, op string, target string, after_id string, content string, property string, value string"
    ops = spark.createDataFrame([("d", 1, "set_style", "a", None, None, "bold", "true"), ("d", 2, "page_break", None, "a", None, None, None), ("d", 3, "insert", "n", "b", "x", None, None), ("d", 4, "delete", "b", None, None, None, None), ("d", 5, "move", "a", "b", None, None, None), ("r", 1, "delete", "a", None, None, None, None), ("r", 2, "move", "b", "zz", None, None, None)], kind)
    got = tree.applied(e, ops).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.element_id) for r in got] == [("d", "page_break-2"), ("d", "n"), ("d", "a"), ("r", "a"), ("r", "b")]
    assert {(r.doc_id, r.seq) for r in tree.invalid_operations(ops, e).collect()} == {("r", 2)}


def test_threads_of_documents_with_the_same_ids(spark):
    rows = [(d, i, p, i == 1) for d in (1, 2) for i, p in ((1, None), (2, 1), (3, 2), (4, 9), (5, 4))]
    got = tree.threads(spark.createDataFrame(rows, "doc_id int, id int, parent_id int, resolved boolean")).collect()
    assert sorted((r.doc_id, r.id, r.thread, r.resolved) for r in got) == [(d, i, t, t == 1) for d in (1, 2) for i, t in ((1, 1), (2, 1), (3, 1), (4, 4), (5, 4))]


def test_autolinks_of_addresses_that_begin_like_urls(spark):
    text = "http.fan@example.org www.bob@example.org http://a.org/x@y www.c.org HTTPS://D.org, z@e.org."
    got = tree.autolinks(spark.createDataFrame([(1, text)], "k int, t string"), key="k", text="t").orderBy("nth").collect()
    assert [r.href for r in got] == ["mailto:http.fan@example.org", "mailto:www.bob@example.org", "http://a.org/x@y", "https://www.c.org", "HTTPS://D.org", "mailto:z@e.org"]


def test_pdf_mark_behind_a_shifted_one(spark):
    shifted = bytes.fromhex("0255044462D0")
    files = [(1, shifted + b"%PDF-1.4"), (2, shifted), (3, b"%PDF-"), (4, b"x" * 1020 + b"%PDF-")]
    got = spark.createDataFrame(files, "k int, c binary").select("k", X.is_pdf(F.col("c")).alias("p")).collect()
    assert {r.k: r.p for r in got} == {1: True, 2: False, 3: True, 4: False}


def test_overrides_of_the_document_and_cleared_ones(spark):
    e = spark.createDataFrame([("d", "a")], "doc_id string, element_id string")
    kind = "doc_id string, target string, property string, value string, unit string, priority int, source string, seq long"
    held = spark.createDataFrame([("d", "a", "bold", "true", None, 1, "live_override", 1), ("d", "a", "color", "red", None, 1, "live_override", 2), ("d", "Document", "pageSize", "A4", None, 1, "live_override", 3), ("d", "Paragraph", "bold", "true", None, 5, "template", 4)], kind)
    asked = [("a", "bold", "yes", None, 10), ("a", "color", None, None, 11), ("Document", "pageSize", "letter", None, 12), ("Document", "marginTop", "2", "cm", 13), ("Document", "bold", "true", None, 14), ("gone", "bold", "true", None, 15), ("a", "alignment", "left", None, 16), ("a", "alignment", "right", None, 17)]
    wanted = spark.createDataFrame([("d", *a) for a in asked], "doc_id string, target string, property string, value string, unit string, seq long")
    got = rules.set_overrides(held, wanted, e).collect()
    assert sorted((r.target, r.property, r.value, r.unit, r.seq) for r in got if r.priority == 1) == [("Document", "marginTop", "2", "cm", 13), ("Document", "pageSize", "Letter", None, 12), ("a", "alignment", "right", None, 17), ("a", "bold", "true", None, 1)]
    assert [r.target for r in got if r.priority == 5] == ["Paragraph"]


def test_structure_changes_of_two_versions(spark):
    kind = "doc_id int, ord int, type string, level int, ordered boolean, levels array<int>, widths array<int>"
    before = [(1, 0, "heading", 1, None, None, None), (1, 1, "list", None, True, [0, 1], None), (1, 2, "table", None, None, None, [2, 3]), (2, 0, "paragraph", None, None, None, None)]
    after = [(1, 0, "heading", 2, None, None, None), (1, 1, "list", None, True, [0, 1], None), (3, 0, "quote", None, None, None, None)]

    def lines(rows):
        return spark.createDataFrame(rows, kind).select("doc_id", "ord", fidelity.block_line(*(F.col(c) for c in ("type", "level", "ordered", "levels", "widths"))).alias("line"))

    got = fidelity.structure_changes(lines(before), lines(after)).orderBy("doc_id", "nth").collect()
    assert [tuple(r) for r in got] == [(1, 0, "replace", ["heading 1"], ["heading 2"]), (1, 1, "delete", ["table [2, 3]"], []), (2, 0, "delete", ["paragraph"], []), (3, 0, "insert", [], ["quote"])]


def test_categories_of_text_differences(spark):
    cases = [
        ("give 5 mg now", "give 5 g now", "changed", "unit", {"unit"}), ("give 5 mg now", "give 6 mg now", "changed", "number", {"number"}), ("it is good", "it is not good", "added", "negation", {"negation"}),
        ("one two.", "one two!", "changed", "punctuation", {"punctuation"}), ("a b c d", "a b c d b c", "added", "duplicate", {"duplicate"}), ("keep. We all left early.", "keep.", "missing", "sentence", {"sentence"}),
        ("alpha beta gamma delta one two three", "one two three alpha beta gamma delta", "moved", "reordered", {"reordered"}), ("big house", "small house", "changed", "words", {"words"}),
    ]
    rows = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, a string, b string")
    got = {r.k: r for r in fidelity.token_edits(rows, keys=["k"], source="a", result="b").collect()}
    assert [(got[k].kind, got[k].category, set(got[k].categories)) for k in range(len(cases))] == [c[2:] for c in cases]
    said = {r.k: (r.protected, r.summary) for r in fidelity.check_text(rows, keys=["k"], source="a", result="b").collect()}
    assert said[0] == (True, "1 difference(s): unit x1") and said[2] == (False, "1 difference(s): negation x1")


def test_a_length_that_cannot_be_kept_is_noted(spark):
    from quire.operators import styles

    kind = "doc_id string, target string, property string, value string, unit string, priority int, source string, seq long"
    held = spark.createDataFrame([("d", "Quote", "indentLeft", "36", "cm", 2, "i", 1), ("d", "Quote", "fontSize", "12.50", "pt", 2, "i", 2), ("d", "Image", "bold", "true", None, 2, "i", 3)], kind)
    got = {r.property: (r.value, r.note) for r in styles.from_rules(held, ["doc_id"]).collect()}
    assert got == {"indentLeft": (None, "Quote: 'indentLeft' = '36' cm skipped"), "fontSize": ("12.5", None), "bold": (None, "Image: 'bold' has no place in a style system")}
