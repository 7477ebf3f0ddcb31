"""Stores, workbooks and whole requests."""

from pyspark.sql import functions as F

from quire.operators import edits
from quire.operators import rules as R
from quire.sources import sinks, tables, workbooks


def test_blobs_are_put_replaced_and_deleted(spark, tmp_path):
    def blobs(**kv):
        return spark.createDataFrame([(k, v.encode()) for k, v in kv.items()], "key string, content binary")

    path = str(tmp_path / "store")
    sinks.put_blobs(blobs(a="1", b="2"), path, batch=0)
    sinks.put_blobs(blobs(b="3", c="4"), path, batch=1)
    sinks.put_blobs(blobs(b="3", c="4"), path, batch=1)
    sinks.delete_blobs(blobs(c="", z=""), path, batch=2)
    got = {r.key: bytes(r.content) for r in sinks.stored_blobs(spark, path).collect()}
    assert got == {"a": b"1", "b": b"3"}
    assert [r.key for r in sinks.stored_blobs(spark, path, blobs(b="", c="")).collect()] == ["b"]


def test_json_stores_and_readable_blobs(spark, tmp_path):
    docs = spark.createDataFrame([("x", 3, "t"), ("y", 4, None)], "id string, revision int, title string")
    sinks.write_json(docs, str(tmp_path / "json"))
    back = tables.json_store(spark, str(tmp_path / "json"), "id string, title string")
    assert sorted(map(tuple, back.collect())) == [("x", "t"), ("y", None)]
    assert [r.id for r in tables.json_store(spark, str(tmp_path / "json"), "id string, title string", ["y"]).collect()] == ["y"]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "k1").write_bytes(b"one")
    (tmp_path / "files" / "k2").write_bytes(b"two")
    files = tables.blobs(spark, str(tmp_path / "files"))
    assets = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, workspace_id int")
    members = spark.createDataFrame([("u", 1)], "user_id string, workspace_id int")
    assert [(r.key, bytes(r.content), r.size) for r in tables.readable_blobs(files, assets, members, "u").collect()] == [("k1", b"one", 3)]


def test_workbooks_come_back_as_they_were(spark):
    rows = spark.createDataFrame([(k, n, f"id{n}", "a & <b>" if n % 2 else None) for k in "pq" for n in range(30)], "book string, n int, ID string, Note string")
    made = workbooks.workbooks(rows, key="book", order="n", columns=["ID", "Note"]).withColumnRenamed("book", "key")
    both = made.unionByName(spark.createDataFrame([("bad", b"no")], "key string, content binary"))
    got = workbooks.table_rows(both, first="ID").orderBy("key", "nth").collect()
    assert [r.problem for r in got if r.key == "bad"] and len(got) == 61
    assert [(r.nth, r.row["ID"], r.row["Note"]) for r in got if r.key == "q"] == [(n, f"id{n}", "a & <b>" if n % 2 else "") for n in range(30)]
    assert workbooks.letters(27) == "AB" and workbooks.column_of("AB7") == 27


def test_an_instruction_to_several_documents(spark):
    e = spark.createDataFrame([(d, k, x, "paragraph", None, x) for d in ("free", "clash", "wrong") for k, x in enumerate("ab")], "doc_id string, ord int, element_id string, type string, level int, content string")
    kind = "doc_id string, target string, property string, value string, unit string, priority int, source string, seq long"
    rules = spark.createDataFrame([("clash", "a", "bold", "false", None, 1, "live_override", 1), ("free", "a", "color", "red", None, 1, "live_override", 2), ("wrong", "Quote", "bold", "true", None, 5, "template", 3)], kind)
    given = spark.createDataFrame([("Paragraph", "bold", "true", None, 2, "instruction", 0)], R.RULES)
    ops = "doc_id string, seq int, op string, target string, after_id string, content string, property string, value string"
    operations = spark.createDataFrame([("free", 1, "set_style", "b", None, None, "italic", "true"), ("free", 2, "page_break", None, "a", None, None, None), ("free", 3, "delete", "b", None, None, None, None), ("free", 4, "insert", None, "b", "x", None, None), ("wrong", 1, "delete", "zz", None, None, None, None), ("clash", 1, "delete", "a", None, None, None, None)], ops)
    waiting = operations.where("op = 'delete' and doc_id = 'free'")
    got = edits.instructed(e, rules, given, operations, waiting)
    assert [(r.doc_id, r.element_id) for r in got["conflicts"].collect()] == [("clash", "a")] and [(r.doc_id, r.target) for r in got["invalid"].collect()] == [("wrong", "zz")]
    after = got["elements"].groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "element_id"))).alias("l")).collect()
    assert {r.doc_id: [x.element_id for x in r.l] for r in after} == {"free": ["a", "page_break-2", "b"], "clash": ["a", "b"], "wrong": ["a", "b"]}
    assert sorted((r.doc_id, r.target, r.property, r.priority) for r in got["rules"].collect()) == [("clash", "a", "bold", 1), ("free", "Paragraph", "bold", 2), ("free", "a", "color", 1), ("free", "b", "italic", 2), ("wrong", "Quote", "bold", 5)]
    assert [(r.doc_id, r.op) for r in got["proposals"].collect()] == [("free", "insert")]


def test_a_save_keeps_what_is_the_servers(spark):
    stored = spark.createDataFrame([("d", 0, "a", "file-1"), ("d", 1, "b", "file-2")], "doc_id string, ord int, element_id string, origin string")
    sent = spark.createDataFrame([("d", 5, "b", "mine"), ("d", 9, "n", "mine"), ("d", 7, "b", "mine")], stored.schema)
    rules = spark.createDataFrame([("d", "a", "bold"), ("d", "b", "bold"), ("d", "Quote", "bold")], "doc_id string, target string, property string")
    own, kept = edits.saved(stored, sent, rules, ["origin"])
    assert [(r.ord, r.element_id, r.origin) for r in own.orderBy("ord").collect()] == [(0, "b", "file-2"), (1, "b", None), (2, "n", None)]
    assert sorted(r.target for r in kept.collect()) == ["Quote", "b"]
