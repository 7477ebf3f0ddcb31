"""Decisions one after another: admissions, proposals, threads, captions, headers of pictures."""

import random

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import edits, tree


def test_a_refused_request_takes_nothing(spark):
    rows = [("w", 1, 4), ("w", 2, 1), ("w", 3, 3), ("w", 4, 1), ("w", 5, 1), ("v", 1, 9), ("v", 2, None), ("u", 1, 2)]
    own = spark.createDataFrame(rows, "workspace string, id int, n int")
    held = spark.createDataFrame([("u", 2), ("w", None)], "workspace string, n int")
    got = edits.admitted(own, held, workspace="workspace", order=["id"], limit=F.when(F.col("workspace") != "v", 3)).collect()
    assert sorted((r.workspace, r.id, r.ok) for r in got) == [("u", 1, False), ("v", 1, True), ("v", 2, True), ("w", 1, False), ("w", 2, True), ("w", 3, False), ("w", 4, True), ("w", 5, True)]


def plain_admissions(rows, limit):
    used, out = {}, []
    for w, i, n in sorted(rows):
        ok = used.get(w, 0) + n <= limit
        used[w] = used.get(w, 0) + n * ok
        out.append((w, i, ok))
    return out


def test_admissions_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), i, rng.randrange(1, 6)) for i in range(300)]
    held = spark.createDataFrame([], "workspace int, n int")
    got = edits.admitted(spark.createDataFrame(rows, "workspace int, id int, n int").repartition(4), held, workspace="workspace", order=["id"], limit=F.lit(17)).collect()
    assert sorted((r.workspace, r.id, r.ok) for r in got) == plain_admissions(rows, 17)


ELEMENTS = [("d", 0, "a"), ("d", 1, "b")]
PROPOSALS = [("d", 1, 1, "delete", "a", None, None), ("d", 2, 2, "insert", None, "a", "new"), ("d", 3, 3, "move", "b", None, None)]


def decide(spark, elements, proposals, decisions):
    e = spark.createDataFrame(elements, "doc_id string, ord int, element_id string")
    p = spark.createDataFrame(proposals, "doc_id string, id int, seq int, op string, target string, after_id string, content string")
    out, left, stale = edits.decided(e, p, spark.createDataFrame(decisions, "doc_id string, id int, accept boolean"))
    return sorted(map(tuple, out.select("doc_id", "ord", "element_id").collect())), sorted(map(tuple, left.collect()), key=str), sorted(r.id for r in stale.collect())


def test_what_an_earlier_decision_took_away_is_stale(spark):
    out, left, stale = decide(spark, ELEMENTS, PROPOSALS, [("d", 1, True), ("d", 2, True)])
    assert out == [("d", 0, "b")] and stale == [2] and [r[1] for r in left] == [3]


def test_the_same_in_two_batches(spark):
    out, left, stale = decide(spark, ELEMENTS, PROPOSALS, [("d", 1, True)])
    assert out == [("d", 0, "b")] and stale == [] and [r[1] for r in left] == [3]
    again, left, stale = decide(spark, out, left, [("d", 2, True), ("d", 3, True)])
    assert again == [("d", 0, "b")] and stale == [2] and left == []


def test_threads_of_any_depth_and_rings(spark):
    rows = [("a", i, i - 1 if i else None, i == 0) for i in range(40)] + [("b", 1, 2, False), ("b", 2, 3, True), ("b", 3, 1, False), ("b", 0, 3, False), ("c", 5, 99, True)]
    got = tree.threads(spark.createDataFrame(rows, "doc_id string, id int, parent_id int, resolved boolean")).collect()
    assert {(r.doc_id, r.thread, r.resolved) for r in got if r.doc_id != "b"} == {("a", 0, True), ("c", 5, True)}
    assert {(r.id, r.thread) for r in got if r.doc_id == "b"} == {(0, 1), (1, 1), (2, 1), (3, 1)} and len(got) == len(rows)


def test_captions_have_a_separator(spark):
    texts = {"Figure 2": False, "Figure 2.": True, "Схема 1: изглед": True, "СХЕМА 1.2 – x": True, "Table 3 shows": False, " фиг. 4) x": True, "Image 1-2: y": True, "Scheme 1:": False}
    rows = [(i, 2 * k, "paragraph", t) for i, t in enumerate(texts) for k in (0,)] + [(i, 1, "image", "") for i in range(len(texts))]
    got = tree.captioned(spark.createDataFrame(rows, "doc_id int, ord int, type string, content string")).where("ord = 0").collect()
    assert {r.content: r.type == "caption" for r in got} == texts


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + (len(b) + 2).to_bytes(2) + b for m, b in segments)


def frame(width: int, height: int) -> bytes:
    return b"\x08" + height.to_bytes(2) + width.to_bytes(2) + b"\x03" + bytes(9)


def test_sizes_of_jpegs(spark):
    thumbnail = (0xE1, jpeg((0xC0, frame(160, 120))))
    cases = {
        "thumbnail": (jpeg(thumbnail, (0xC0, frame(4000, 3000))), (4000, 3000), None), "large headers": (jpeg(*[(0xE2, b"\xff\xc0" * 32000)] * 3, (0xC1, frame(30000, 10))), (30000, 10), "too_large"),
        "progressive": (jpeg((0xDB, bytes(65)), (0xC2, frame(7, 9))), (7, 9), None), "tables only": (jpeg((0xC4, frame(1, 1)), (0xDA, b"x" * 20)), None, "unreadable"), "cut": (jpeg((0xC0, frame(5, 6)))[:8], None, "unreadable"),
    }
    rows = spark.createDataFrame([(k, c) for k, (c, _, _) in cases.items()], "k string, c binary")
    got = {r.k: (r.s and tuple(r.s), r.p) for r in rows.select("k", X.picture_size(F.col("c")).alias("s"), X.picture_problem(F.col("c")).alias("p")).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}
