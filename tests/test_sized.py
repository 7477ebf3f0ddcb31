"""Steps whose cost once grew faster than their input: what they now give, and how they are planned."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, compare
from quire.operators import edits as E
from quire.operators import fidelity as V
from quire.operators import health as H
from quire.operators import looks
from quire.operators import rules as R
from quire.operators import segment as G
from quire.operators import styles as S
from quire.operators import tree
from quire.sources import markdown
from quire.streaming import metering as SM


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_meet_in_one_shuffle(spark):
    block = "doc_id int, piece int, ord int, type string, level int, content string"
    pieces = spark.createDataFrame([(1, 0, "one two"), (1, 1, "three"), (1, 30, "late"), (2, 0, "alone")], "doc_id int, piece int, text string")
    answers = spark.createDataFrame([(1, 0, 1, "paragraph", None, "two"), (1, 0, 0, "heading", 1, "one"), (1, 1, 0, "heading", 1, "three more"), (1, 30, 0, "heading", 1, "late")], block)
    segments = spark.createDataFrame([(1, 0, 0, "paragraph", None, "one two"), (1, 1, 0, "paragraph", None, "three"), (1, 30, 0, "paragraph", None, "late"), (2, 0, 0, "paragraph", None, "alone")], block)
    out = E.structured(pieces, answers, segments)
    assert "Join" not in planned(out) and planned(out).count("Exchange") == 1
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == [
        (1, 0, "heading", 1, "one", True), (1, 1, "paragraph", None, "two", True), (1, 2, "paragraph", None, "three", False), (1, 3, "paragraph", None, "late", False), (2, 0, "paragraph", None, "alone", False)]


def test_looks_are_asked_once_a_row(spark):
    """The fixed table is laid out as rows: nothing is searched for in lists of a key's whole look; all rules of a key meet in one shuffle."""
    kind = "doc_id int, target string, property string, value string, unit string, priority int, source string, seq long"
    rules = spark.createDataFrame([
        (1, "Paragraph", "color", "red", None, 4, "x", 1), (1, "Heading 1", "color", "blue", None, 4, "x", 2), (1, "Paragraph", "alignment", "right", None, 4, "x", 3), (1, "List", "alignment", "center", None, 4, "x", 4),
        (1, "Paragraph", "fontSize", "12", "pt", 9, "x", 5), (1, "Nowhere", "bold", "true", None, 4, "x", 6), (2, "Paragraph", "color", "plaid", None, 4, "x", 1),
    ], kind)
    out = R.resolve(rules, ["doc_id"])
    assert planned(out).count("Exchange") == 1
    got = {(r.doc_id, r.target, r.css): r.value for r in out.collect()}
    assert out.count() == len(got)
    assert [got[1, "Quote", c] for c in ("color", "text-align", "font-size", "line-height", "font-style")] == ["red", "right", "11pt", "1.15", "italic"]
    assert [got[1, t, c] for t, c in (("Heading 1", "color"), ("Heading 2", "color"), ("List", "text-align"), ("Paragraph", "font-size"), ("Nowhere", "font-weight"))] == ["blue", "red", "center", "11pt", "bold"]
    assert not [k for k in got if k[0] == 2 and k[2] == "color"] and not [k for k in got if k[1] == "Nowhere" and k[2] != "font-weight"]
    assert [got[2, "Caption", c] for c in ("font-size", "font-family", "text-align")] == ["9pt", "Arial", "left"]


@pytest.mark.parametrize("kind", ["refusals", "burst_history", "admissions"])
def test_keys_share_states(spark, tmp_path, kind):
    """A stream of more keys than there are buckets, a null one too: as many states as buckets at most, and what each key's own rows say."""
    n = 1500
    rows = spark.range(n * 4).select(F.when(F.col("id") % n > 0, F.col("id") % n).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / n) * 600).alias("ts"), F.lit("content").alias("kind"), F.lit(1).alias("n"), F.lit(3).alias("most"))
    rows.write.parquet(f"{tmp_path}/in")
    SM.keyed_state(spark)
    stream = SM.event_stream(spark, f"{tmp_path}/in")
    if kind == "refusals":
        out = SM.refusals(stream, key="user_id", limit=3, seconds=86400).select("user_id", "nth")
        want = {(u, 4) for u in [None, *range(1, n)]}
    elif kind == "burst_history":
        out = SM.burst_history(stream, doc="user_id", seconds=1500).select("user_id", "step", "saves")
        want = {(u, *x) for u in [None, *range(1, n)] for x in ((1, 3), (2, 1))}
    else:
        held = spark.createDataFrame([(7, 2), (8, 9)], "user_id long, n int")
        out = SM.admissions(stream, held, workspace="user_id", order=["ts", "event_id"]).where("ok").select("user_id", "event_id")
        want = {(u or None, u + n * k) for u in range(n) for k in range({7: 1, 8: 0}.get(u, 3))}
    q = out.writeStream.format("memory").queryName(f"shared_{kind}").outputMode("update" if kind == "burst_history" else "append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table(f"shared_{kind}").collect()} == want
    assert max(p["stateOperators"][-1]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= SM.BUCKETS


def test_texts_are_compared_once(spark):
    pairs = spark.createDataFrame([(1, "a b c d", "a b c d a b"), (2, "a b c", "a b c x y"), (3, "a b a c", "a b a c a c z"), (4, "same", "same")], "k int, s string, r string")
    out = V.token_edits(pairs, keys=["k"], source="s", result="r")
    assert planned(out).count("MapInArrow") == 1 and "Join" not in planned(out)
    assert sorted((r.k, r.kind, r.category, r.result) for r in out.collect()) == [(1, "added", "duplicate", "a b"), (2, "added", "words", "x y"), (3, "added", "words", "a c z")]
    assert [(r.n, r.p) for r in V.check_text(pairs, keys=["k"], source="s", result="r").selectExpr("k", "differences n", "verified p").sort("k").collect()] == [(1, False), (1, False), (1, False), (0, True)]


def test_levels_are_one_number(spark):
    used = spark.createDataFrame([(1, 2), (1, 4), (1, 4), (2, 6)], "doc_id int, level int")
    every = G.nearest_level(None, used)
    assert "Join" not in planned(every) and "SortAggregate" not in planned(every) and planned(every).count("Exchange") == 1
    assert sorted(map(tuple, every.collect())) == [(1, 1, 2), (1, 2, 2), (1, 3, 4), (1, 4, 4), (1, 5, 4), (1, 6, 4), *((2, k, 6) for k in range(1, 7))]
    wanted = spark.createDataFrame([(1, 3), (2, 1), (3, 1)], "doc_id int, level int")
    assert sorted(map(tuple, G.nearest_level(wanted, used).collect())) == [(1, 3, 4), (2, 1, 6)]


def test_cells_take_their_looks_where_they_are(spark):
    """A cell that meets its table needs no more: what the regions of its style give is not joined by style and region, whose few values most cells share."""
    styles = spark.createDataFrame([(1, "wholeTable", "fill", "w"), (1, "firstRow", "fill", "f"), (1, "firstRow", "bold", None), (1, "band1Horz", "edge", "b"), (1, "elsewhere", "fill", "x")], "style int, region string, property string, value string")
    cells = spark.createDataFrame([("t", r, 0, {"fill": "own"} if r == 1 else {}) for r in range(3)] + [("no style", 0, 0, {}), ("no table", 0, 0, {"fill": "own"})], "table_id string, row int, col int, own map<string,string>")
    tables = spark.createDataFrame([("t", 1, 3, 1), ("no style", 9, 1, 1)], "table_id string, style int, rows int, cols int").withColumn("look", looks.look_flags(F.lit("0420"), F.lit(None).cast("map<string,string>")))
    out = looks.cell_looks(cells, tables, styles)
    assert "Window" not in planned(out) and planned(out).count("Join") == 2 and not re.search(r"Exchange hashpartitioning\(style#\d+, region", planned(out))
    assert sorted((r.table_id, r.row, r.property, r.value, r.region) for r in out.collect()) == [
        ("no table", 0, "fill", "own", "own"), ("t", 0, "bold", None, "firstRow"), ("t", 0, "fill", "f", "firstRow"), ("t", 1, "edge", "b", "band1Horz"), ("t", 1, "fill", "own", "own"), ("t", 2, "fill", "w", "wholeTable")]


def test_a_writers_features_go_to_the_items(spark):
    """Items are dealt by report, never by feature, of which there are few; they meet before they are grouped."""
    items = spark.createDataFrame([(1, "a", "r ", "p", "e2", "s", True, 1, 2), (1, "a", "r ", "q", "e1", "s", True, 2, 1), (1, "b", "r ", "p", None, "s", True, 1, 3), (2, "c", None, "p", None, "s", False, 1, 4)], "report int, feature string, reason string, policy string, element_id string, source string, changed boolean, n int, seq int")
    kept = spark.createDataFrame([("a", "k", "new", None), ("b", None, None, " (s)")], "feature string, policy string, reason string, suffix string")
    out = V.reclassified(items, kept, ["report"])
    steps = planned(out)
    assert "SortMergeJoin" not in steps and steps.count("Exchange hashpartitioning(report") == 1 and steps.count("Exchange hashpartitioning") == 1
    assert sorted((r.report, r.feature, r.reason, r.policy, r.changed, r.n, r.element_ids) for r in out.collect()) == [
        (1, "a", "new", "k", False, 3, ["e1", "e2"]), (1, "b", "r (s)", "p", True, 1, []), (2, "c", None, "p", False, 1, [])]


def test_elements_are_handed_on_a_few_texts_at_a_time(spark, monkeypatch):
    """Tasks hold the elements of a few texts, not of a batch: three texts come out in batches of their own, and all are there."""
    sent = []

    class Docs:
        schema = spark.createDataFrame([], "k int, t string").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            sent.extend(run([pa.RecordBatch.from_pydict({"k": pa.array([1, 2, 3, 4], pa.int32()), "t": ["a *b*\n\n# c", None, "d" * 9, "e"]}), pa.RecordBatch.from_pydict({"k": pa.array([], pa.int32()), "t": pa.array([], pa.string())})]))
            return spark.createDataFrame([(0, [])], schema)

    monkeypatch.setattr(markdown, "AT_ONCE", 8)
    markdown.elements(Docs(), doc="k", text="t")
    assert [[(r["k"], [e["content"] for e in r["e"]]) for r in b.to_pylist()] for b in sent] == [[(1, ["a b", "c"])], [(2, []), (3, ["d" * 9])], [(4, ["e"])]]


@pytest.mark.parametrize("words", [1, 7, 1 << 18])
def test_texts_stand_behind_one_another(spark, monkeypatch, words):
    """Each text is dealt once and a block's last one twice; whatever is compared together, each text has the one before it."""
    monkeypatch.setattr(compare, "AT_ONCE", words)
    rng = random.Random(words)
    texts = [(i, rng.choice([None, "", *(" ".join(rng.choices("abcé", k=rng.randrange(1, 9))) for _ in range(6))])) for i in sorted(rng.sample(range(-50, 900), 150))]
    want, before = [], Counter()
    for k, text in texts:
        left, before = before, Counter((text or "").split())
        for at, w in enumerate((text or "").split(), 1):
            if left[w] > 0:
                left[w] -= 1
            else:
                want.append((k, at, w))
    out = compare.bag_missing_after(spark.createDataFrame(texts, "k long, t string").repartition(3), key="k", text="t", block=4)
    assert planned(out).count("regexp_extract_all") == 1
    assert sorted(map(tuple, out.collect())) == want


def test_words_that_lack_are_handed_on_before_a_batch_ends(spark):
    sent = []

    class Pairs:
        def select(self, *names):
            self.schema = spark.createDataFrame([], "k int").schema
            return self

        def mapInArrow(self, run, schema):
            words = pa.list_(pa.string())
            sent.extend(run([pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), pa.array([["a"] * compare.AT_ONCE, ["b", "a"], ["c"]], words), pa.array([None, ["a"], None], words)], names=["k", "a", "b"])]))

    compare.bag_missing(Pairs(), key="k", source="a", kept="b")
    assert [b.num_rows for b in sent] == [compare.AT_ONCE, 2] and sent[1].to_pylist() == [{"k": 1, "at": 1, "word": "b"}, {"k": 2, "at": 1, "word": "c"}]


def test_lists_of_those_above_are_doubled(spark, monkeypatch):
    """A chain of 70, two rings with tails, a row that is its own parent, parents without a row: as many rounds as the longest list's length has bits, and one."""
    rounds = []
    monkeypatch.setattr(catalog, "written", lambda df, label, f=catalog.written: rounds.append(label) or f(df, label))
    parents = {k: k - 1 for k in range(1, 71)} | {100: 101, 101: 102, 102: 100, 103: 101, 104: 103, 105: 106, 106: 105, 107: 105, 110: 110, 111: 110, 112: 111, 120: 999}
    rows = [(0, None), *parents.items()]
    want = []
    for k in parents:
        path, at = [k], parents.get(k)
        while at is not None and at not in path:
            path.append(at)
            at = parents.get(at)
        want.extend((k, a, n) for n, a in enumerate(path[1:], 1))
    got = catalog.ancestors(spark.createDataFrame(rows, "id long, parent long"), key="id", parent="parent")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(rounds) == 8
    several = catalog.ancestors(spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "id long, parent long"), key="id", parent="parent")
    assert sorted(map(tuple, several.collect())) == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 4, 2), (2, 4, 1), (3, 4, 1)]


def test_comments_are_read_in_order_and_the_rest_is_followed(spark, monkeypatch):
    """Chains of answers with larger ids need no round; parents with larger ids, rings of one, two and five, and parents that are not there are followed."""
    rounds = []
    monkeypatch.setattr(tree, "written", lambda df, label, f=tree.written: rounds.append(label) or f(df, label))
    rows = [("a", i, i - 1 if i % 40 else None) for i in range(200)] + [("c", 5, 5)]
    kind = "doc_id string, id int, parent_id int, resolved boolean"
    got = tree.threads(spark.createDataFrame([(*r, r[1] % 3 == 0) for r in rows], kind)).collect()
    assert sorted((r.doc_id, r.id, r.thread, r.resolved) for r in got) == [*(("a", i, i // 40 * 40, i // 40 * 40 % 3 == 0) for i in range(200)), ("c", 5, 5, False)] and len(rounds) == 1
    rows += [("b", i, i + 1 if i < 30 else None) for i in range(31)] + [("d", 1, 2), ("d", 2, 1), ("d", 3, 2), ("d", 0, 3)] + [("e", i, (i + 1) % 5) for i in range(5)] + [("f", 1, 99), ("f", 0, 1), ("f", 2, 0), ("f", 3, 8), ("f", 4, 3)]
    want = {"a": lambda i: i // 40 * 40, "b": lambda i: 30, "c": lambda i: 5, "d": lambda i: 1, "e": lambda i: 0, "f": lambda i: 1 if i < 3 else 3}
    got = tree.threads(spark.createDataFrame([(*r, False) for r in rows], kind)).collect()
    assert sorted((r.doc_id, r.id, r.thread) for r in got) == sorted((d, i, want[d](i)) for d, i, _ in rows)


def test_a_document_holds_so_many_comments(monkeypatch):
    monkeypatch.setattr(tree, "HELD", 2)
    state = tree.Roots(("d",))
    assert [state.step({"id": i, "parent_id": p})[0][2:] for i, p in ((1, None), (2, 1), (3, 2), (4, 3))] == [(1, True), (1, True), (1, True), (3, False)]


def test_style_systems_are_dealt_before_they_are_laid_out(spark):
    """Many rules are made of few bytes: style systems are dealt by their keys below the joins with the fixed table of places."""
    rows = [(k, s, f, v) for k in (1, 2) for s, f, v in (("document", "fontFamily", "Georgia"), ("code", "fontFamily", "Courier"), ("paragraph", "fontSizePt", "9.50"))]
    out = S.compiled(spark.createDataFrame(rows, "style int, section string, field string, value string"), ["style"], priority=1, source="x")
    steps = planned(out).split("Initial Plan")[-1]
    assert steps.rindex("Exchange hashpartitioning(style") > steps.rindex("BroadcastHashJoin")
    got = {(r.style, r.target, r.property): r.value for r in out.collect()}
    assert got[1, "Paragraph", "fontSize"] == "9.5" and got[2, "CodeBlock", "fontFamily"] == "Courier" and got[2, "Quote", "fontFamily"] == "Georgia" and len(got) == 28


@pytest.fixture(scope="module")
def marked_up(spark):
    """Elements with what the checks ask for, odd values too: (elements, runs, items)."""
    rng = random.Random(15)
    texts = ["", " \u00a0\t", "one two", "1. One", "1.1 Sub", "1.2 Sub", "01.2 Sub", "2) Two", "2. Two", "3 Three", "word\u2003" * 40, "x" * 90, "w " * 320]
    kinds = ["paragraph"] * 5 + ["heading"] * 4 + ["list", "quote", "table", "caption", "footnote", "image", "page_break", "page_break", "other"]
    rows, runs, items = [], [], []
    for d in range(90):
        own = rng.sample(kinds, rng.choice([2, 5, len(kinds)]))
        for k in range(rng.choice([1, 4, 12, 40])):
            css = {"font-family": rng.choice(["Arial", "'Arial', serif", "", "Georgia"]) if rng.random() < 0.2 else "Arial", "font-size": rng.choice(["12pt", "14pt", "a|b", "large"]) if rng.random() < 0.3 else "14pt"}
            css |= {n: rng.choice(some) for n, some in (("line-height", ["1|", "1"]), ("margin-bottom", ["2", "|2"]), ("text-align", ["left", "right"])) if rng.random() < 0.4}
            key = f"{d}-{99 - k}"
            rows.append((d, key, k, rng.choice(own), rng.choice([None, 1, 2, 3]), rng.choice(texts), rng.choice([key, "Paragraph", "Paragraph", None]), rng.choice([True, False, None]), rng.choice([True, False]), css))
            for _ in range(rng.choice([0, 0, 1, 3])):
                mark, font = rng.choice(["link", "textStyle", "bold"]), rng.choice([None, None, "Arial", " Verdana ", ""])
                runs.append((d, key, rng.choice(["", " ", "seen"]), mark, rng.choice([None, "", "https://example.org/1", "javascript:void(0)"]) if mark == "link" else None, font, rng.choice([None, None, 9.0]), rng.choice([None, None, "red"])))
            items += [(d, key, rng.choice(["1. typed", "2) typed", "plain"])) for _ in range(rng.choice([0, 1, 2]))]
    return (
        spark.createDataFrame(rows, "doc_id long, element_id string, ord int, type string, level int, content string, style_ref string, ordered boolean, has_header boolean, css map<string,string>"),
        spark.createDataFrame(runs, "doc_id long, element_id string, text string, mark string, href string, font_family string, font_size_pt double, color string"),
        spark.createDataFrame(items, "doc_id long, element_id string, text string"),
    )


def test_all_checks_are_told_in_one_pass(spark, marked_up):
    """all eleven checks meet in one shuffle, and their rows are those that each check gives by itself."""
    e, runs, items = marked_up
    out = H.all_checks(e, runs, items)
    assert planned(H.score(out)).count("Exchange") == 1 and "Join" not in planned(out)
    docs = e.select("doc_id").distinct()
    own = [H.hierarchy(e, docs), H.fonts(e, runs, docs), H.heading_sizes(e, docs), H.spacing(e, docs), H.direct_formatting(e, runs, docs), H.numbering(e, items, docs), H.alignment(e, docs), H.tables(e, docs), H.captions(e, docs), H.page_breaks(e, docs), H.links(runs, docs)]
    want = sorted(tuple(r) for f in own for r in f.collect())
    assert sorted(map(tuple, out.collect())) == want and out.columns == own[0].columns and [f.dataType for f in out.schema] == [f.dataType for f in own[0].schema]
    told = {(r[1], r[3]) for r in want}
    assert {n for n, s in told if s == "warn"} >= set(H.WEIGHTS) - {"links"} and {n for n, s in told if s == "skip"} >= set(H.WEIGHTS) - {"hierarchy"}


def test_scores_deal_elements_once_and_without_their_texts(spark, marked_up):
    """one shuffle, into which no content goes, and the scores of the checks' rows."""
    e, runs, items = marked_up
    out = H.scores(e, runs, items)
    steps = planned(out)
    assert steps.count("Exchange") == 1 and "Join" not in steps
    assert "content" not in steps[: steps.index("Exchange")]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, H.score(H.all_checks(e, runs, items)).collect()))
