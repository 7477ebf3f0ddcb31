"""Folds, diffs and readers against plain models."""

import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import numbering as N
from quire.functions import text as X
from quire.operators import compare, fidelity, layout, numbered, segment
from quire.sources import docx, markdown


def checked(spark, pairs, **more):
    rows = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return [r for r in sorted(compare.compare_words(rows, keys=["k"], source="a", result="b", **more).collect())]


def test_word_check_counts_and_moves(spark):
    cases = [("a b", "a b"), ("one two three four", "one three four five"), ("a b c x y z d e f", "x y z a b c d e f"), ("a b", "b c")]
    same, gone, moved, changed = checked(spark, [tuple(x.split() for x in c) for c in cases])
    assert same.verified and same.missing == 0 and same.samples == []
    assert (gone.missing, gone.added, gone.verified) == (1, 1, False)
    assert [tuple(s) for s in gone.samples] == [("missing", "two", "", "one"), ("added", "", "five", "one two three four")]
    assert moved.moved == 3 and moved.missing == moved.added == 0 and [s.kind for s in moved.samples] == ["moved"]
    assert (changed.missing, changed.added) == (1, 1)
    more = checked(spark, [("a b".split(), "1 a 2 b 3".split()), ("a b".split(), "b 1".split())], additions=True)
    assert [r.verified for r in more] == [True, False] and all(s.kind != "added" for s in more[1].samples)


def plain_check(a, b):
    """Counts of the edits between two word lists whose common ends are set aside."""
    low = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    high = next((k for k, (x, y) in enumerate(zip(a[low:][::-1], b[low:][::-1])) if x != y), min(len(a), len(b)) - low)
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    ops = [o for o in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]
    came = [tuple(y[j:k]) for tag, _, _, j, k in ops if tag == "insert"]
    missing = added = moved = 0
    for tag, i, j, k, m in ops:
        if tag == "delete" and tuple(x[i:j]) in came:
            came.remove(tuple(x[i:j]))
            moved += j - i
        elif tag != "insert":
            missing, added = missing + j - i, added + m - k
    return missing, added + sum(map(len, came)), moved


def test_word_check_agrees_with_a_plain_one(spark):
    rng = random.Random(4)
    lists = [([rng.choice("abcde") for _ in range(rng.randrange(14))], [rng.choice("abcde") for _ in range(rng.randrange(14))]) for _ in range(400)]
    for (a, b), r in zip(lists, checked(spark, lists)):
        assert (r.missing, r.added, r.moved) == plain_check(a, b) and r.verified == (a == b) and (r.source_words, r.result_words) == (len(a), len(b))


def in_order(a, b):
    """Members of a longest common subsequence, by its definition: the first list's head goes unless every longest one needs it or it is next."""
    from functools import cache

    @cache
    def longest(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + longest(i + 1, j + 1) if a[i] == b[j] else max(longest(i + 1, j), longest(i, j + 1))

    kept, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            kept.append(a[i])
            i, j = i + 1, j + 1
        elif longest(i + 1, j) == longest(i, j):
            i += 1
        else:
            j += 1
    return kept


def test_kept_in_order_is_longest_and_breaks_ties_alike():
    from itertools import permutations

    rng = random.Random(9)
    lists = [list(p) for n in range(7) for p in permutations(range(n))] + [rng.sample(range(40), 40) for _ in range(200)]
    for b in lists:
        place = {x: k for k, x in enumerate(b)}
        a = list(range(len(b)))
        assert [a[k] for k in compare.kept_in_order([place[x] for x in a])] == in_order(tuple(a), tuple(b))


def test_moved_elements_of_documents(spark):
    rng = random.Random(10)
    before, after, want = [], [], set()
    for d in range(60):
        a = [f"{d}-{k}" for k in rng.sample(range(30), rng.randrange(20))]
        b = rng.sample([*a, f"{d}-new"], rng.randrange(len(a) + 1))
        before += [(d, x, float(k)) for k, x in enumerate(a)]
        after += [(d, x, float(k)) for k, x in enumerate(b)]
        both = [x for x in a if x in b], [x for x in b if x in a]
        want |= {(d, x) for x in set(both[0]) - set(in_order(*map(tuple, both)))}
    kind = "doc_id int, element_id string, ord double"
    got = compare.moved_elements(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    many = [(1, str(k), float(k)) for k in range(1001)]
    assert compare.moved_elements(spark.createDataFrame(many, kind), spark.createDataFrame([(d, x, -k) for d, x, k in many], kind)).count() == 0


def test_cut_keeps_all_but_blanks():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abc \n") for _ in range(rng.randrange(1, 80))).strip()
        parts = segment.cut(text, 10)
        assert all(0 < len(p) <= 10 for p in parts)
        at = 0
        for p, q in zip(parts, parts[1:]):  # a piece ends as late as it can, at a line end before a blank
            at = text.index(p, at) + len(p)
            assert text[at] in " \n" or not set(" \n") & set(text[at - 9 : at + 1])
            assert text[at] != " " or "\n" not in text[at - len(p) + 1 : at - len(p) + 11]
        assert "".join(parts).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_packed_chunks(spark):
    pieces = ["a" * 5, "b" * 3, "c" * 4, "d" * 12, "e"]
    got = spark.range(1).select(segment.packed(F.array(*(F.lit(p) for p in pieces)), 10).alias("c")).first().c
    assert got == ["aaaaa\n\nbbb", "cccc", "d" * 12, "e"]


def plain_numbers(levels, starts, restarts):
    values, out = [s - 1 for s in starts], []
    for at in levels:
        values[at] += 1
        for k in range(at + 1, len(starts)):
            r = restarts[k]
            if r is None or r > k or at < r:
                values[k] = starts[k] - 1
        out.append(values[: at + 1])
    return out


def test_counters_restart(spark):
    rng = random.Random(3)
    for starts, restarts in (([1, 1, 5], [None, None, 0]), ([1, 3, 1, 2], [None, 0, 1, 2]), ([2, 1, 1, 1], [None, 1, 3, None])):
        levels = [rng.randrange(len(starts)) for _ in range(200)]
        rows = spark.createDataFrame([("k", n, lv) for n, lv in enumerate(levels)], "key string, ord int, level int")
        got = numbered.counted(rows, key="key", starts=starts, restarts=restarts).orderBy("ord").collect()
        assert [r["values"] for r in got] == plain_numbers(levels, starts, restarts)
    rows = spark.createDataFrame([("k", n, lv) for n, lv in enumerate([0, 1, 2, 0, 1, 2])], "key string, ord int, level int")
    got = numbered.counted(rows, key="key", starts=[1, 1, 5], restarts=[None, None, 0]).orderBy("ord").collect()
    assert [r["values"] for r in got] == [[1], [1, 1], [1, 1, 5], [2], [2, 1], [2, 1, 6]]


def test_numbers(spark):
    rows = spark.createDataFrame([(4, "lowerRoman"), (27, "lowerLetter"), (29, "russianUpper"), (4000, "upperRoman"), (0, "lowerLetter"), (7, "decimalZero")], "n int, f string")
    assert [r[0] for r in rows.select(N.format_number(F.col("n"), F.col("f"))).collect()] == ["iv", "aa", "АА", "4000", "0", "07"]


def test_pages_and_grid():
    p = layout.Pages(("d",), 10.0)
    units = [(4, None), (4, None), (4, "any"), (1, "even"), (12, None), (1, None)]
    assert [p.step({"ord": k, "height": h, "break_after": b})[0][2] for k, (h, b) in enumerate(units)] == [1, 1, 2, 3, 4, 5]
    g = layout.Grid(("t",))
    cells = [(0, 0, 1, 2), (0, 1, 2, 1), (1, 0, 1, 1), (1, 1, 1, 1), (2, 0, 3, 1)]
    assert [g.step({"row": r, "col": c, "colspan": w, "rowspan": h})[0][-1] for r, c, w, h in cells] == [0, 1, 1, 2, 0]


def test_markdown_blocks():
    text = "Title\n=====\n\nSome **bold** and [a link](https://example.org) and [bad](javascript:x).\n\n- one\n- [x] two\n  - deep\n\n1. first\n\n> quoted\n> text\n\n```\ncode # x\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n"
    got = markdown.parse(text)
    assert [e["type"] for e in got] == ["heading", "paragraph", "list", "list", "quote", "code_block", "table", "horizontal_rule"]
    assert got[1]["content"] == "Some bold and a link and bad."
    assert [r["href"] for r in got[1]["runs"] if "link" in r["marks"]] == ["https://example.org"]
    assert [(i["level"], i["checked"]) for i in got[2]["items"]] == [(0, None), (0, True), (1, None)]
    assert got[4]["content"] == "quoted text" and got[5]["content"] == "code # x"
    assert [(c["row"], c["col"], c["text"]) for c in got[6]["cells"]] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]
    assert markdown.parse("") == []


def test_word_packages():
    elements = [
        {"type": "heading", "level": 2, "content": "A & B", "cells": []}, {"type": "paragraph", "level": None, "content": "x\ty\nz <", "cells": []}, {"type": "list", "level": None, "content": "one\ntwo", "cells": []},
        {"type": "table", "level": None, "content": "", "cells": [{"row": 0, "col": 0, "colspan": 2, "rowspan": 1, "text": "a"}, {"row": 1, "col": 0, "colspan": 1, "rowspan": 1, "text": "b"}, {"row": 1, "col": 1, "colspan": 1, "rowspan": 1, "text": "c"}]},
        {"type": "page_break", "level": None, "content": "", "cells": []}, {"type": "quote", "level": None, "content": "q", "cells": []},
    ]
    data = docx.write(elements)
    assert data == docx.write(elements)
    back = docx.read(data)
    assert [(e["type"], e["level"]) for e in back] == [(e["type"], e["level"]) for e in elements]
    assert [e["content"] for e in back] == ["A & B", "x\ty\nz <", "one\ntwo", "a\nb\tc", "", "q"]
    assert back[3]["cells"][0]["colspan"] == 2
    assert docx.source_words(data) == ["A", "B", "x", "y", "z", "one", "two", "a", "b", "c", "q"]
    assert docx.package_problem(b"no") == "not a zip"
    with pytest.raises(ValueError):
        docx.read(data[: len(data) // 2])


def plain_pages(units, height, top, bottom):
    """units: (height, break after); absolute places on pages that follow one another without gaps."""
    page, y, pending, out = 1, top, None, []
    for h, brk in units:
        if pending:
            page, y = page + 1, top
            page += pending in ("even", "odd") and (page % 2 == 0) != (pending == "even")
        elif y < top:
            y = top
        elif y >= top + height or (y > top and y + h > top + height and h <= height):
            page, y = page + 1, top
        out.append((page, y - top))
        y += h
        while y > top + height + bottom:
            page, y = page + 1, y - (top + height + bottom)
        pending = brk
    return out


def test_pages_against_a_plain_layout(spark):
    rng = random.Random(4)
    docs = {d: [(rng.choice([0, 3, 10, 25, 60, 61, 130, 200]) / 2, rng.choice([None] * 6 + ["any", "even", "odd"])) for _ in range(rng.randrange(1, 40))] for d in range(20)}
    rows = spark.createDataFrame([(d, i, h, b) for d, us in docs.items() for i, (h, b) in enumerate(us)], "doc_id int, ord int, height double, break_after string").repartition(4)
    for top, bottom in ((0.0, 0.0), (5.0, 8.0)):
        got = {(r.doc_id, r.ord): (r.page, r.top) for r in layout.paginate(rows, key="doc_id", height=30.0, top=top, bottom=bottom).collect()}
        assert got == {(d, i): p for d, us in docs.items() for i, p in enumerate(plain_pages(us, 30.0, top, bottom))}


def test_a_unit_in_the_top_margin_is_pushed_down(spark):
    rows = spark.createDataFrame([("d", 0, 36.0, None), ("d", 1, 4.0, None)], "doc_id string, ord int, height double, break_after string")
    got = layout.paginate(rows, key="doc_id", height=30.0, top=5.0, bottom=2.0).orderBy("ord").collect()
    assert [(r.page, r.top) for r in got] == [(1, 0.0), (2, 0.0)]


def test_list_items_are_units(spark):
    e = spark.createDataFrame([("d", 0, "list", 9.0, None), ("d", 1, "section_break", 0.0, "oddPage"), ("d", 2, "paragraph", 4.0, None)], "doc_id string, ord int, type string, height double, start string")
    items = spark.createDataFrame([("d", 0, 0, 4.0), ("d", 0, 1, 5.0), ("d", 2, 0, 1.0)], "doc_id string, ord int, item int, height double")
    got = {tuple(r) for r in layout.layout_units(e, items).collect()}
    assert got == {("d", 0, 0, 4.0, None), ("d", 0, 1, 5.0, None), ("d", 1, None, 0.0, "odd"), ("d", 2, None, 4.0, None)}


def test_row_heights_share_what_spans_need(spark):
    rng = random.Random(8)
    rows, cells, want = [], [], {}
    for t in range(40):
        n = rng.randrange(1, 6)
        own = [(rng.choice([None, 5.0, 12.0]), rng.choice(["exact", "atLeast", None])) for _ in range(n)]
        heights = [h or 0.0 for h, _ in own]
        fixed = [r == "exact" and h is not None for h, r in own]
        spans = []
        for r in range(n):
            for c in range(3):
                span, need = rng.choice([1, 1, 2, 3]), float(rng.randrange(1, 40))
                cells.append((t, r, c, span, need))
                if span == 1 and not fixed[r]:
                    heights[r] = max(heights[r], need)
                elif span > 1:
                    spans.append((r, span, need))
        for r, span, need in spans:
            own_rows = range(r, min(n, r + span))
            free = [x for x in own_rows if not fixed[x]]
            more = need - sum(heights[x] for x in own_rows)
            for x in free if more > 0 else ():
                heights[x] += more / len(free)
        rows += [(t, r, *own[r]) for r in range(n)]
        want |= {(t, r): heights[r] for r in range(n)}
    got = layout.row_heights(spark.createDataFrame(rows, "t int, row int, height double, rule string").repartition(3), spark.createDataFrame(cells, "t int, row int, col int, rowspan int, need double"), key="t").collect()
    assert {(r.t, r.row): r.height for r in got} == want


def test_sniffed_files(spark):
    """Each kind by its first bytes, and what is text."""
    cases = [(bytes.fromhex(h) + b" rest", k) for k, h in X.SIGNATURES] + [(b"plain", None), (b"", None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c binary")
    got = {r.i: r.k for r in rows.select("i", X.sniffed(F.col("c")).alias("k")).collect()}
    firsts = [next((k for k, h in X.SIGNATURES if c.startswith(bytes.fromhex(h))), None) for c, _ in cases]
    assert [got[i] for i in range(len(cases))] == firsts


def test_doubtful_texts_are_told_and_composed(spark):
    """Whatever composition changes, alone or behind a letter, the pattern tells; composed and decomposed texts have the same tokens."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    doubtful = [c for c in chars if unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFC", "e" + c) != "e" + c]
    rows = spark.createDataFrame([(c,) for c in doubtful], "c string")
    assert rows.where(~F.col("c").rlike(X.UNCOMPOSED)).count() == 0
    joins = [a + b for a, b in (("ᄀ", "ᅡ"), ("가", "ᆨ"), ("େ", "ା"), ("e", "́"), ("и", "̆"))]
    plain = "Обикновен текст, plain text — “quoted” 1,5 é"
    got = spark.createDataFrame([(t,) for t in [*joins, plain, None]], "t string").select("t", X.composed(F.col("t")).alias("c")).collect()
    assert all(r.c == (r.t and unicodedata.normalize("NFC", r.t)) for r in got)
    texts = ["Café naïve 4,5 — Ångström", "Също й и ё"]
    pairs = spark.createDataFrame([(i, unicodedata.normalize("NFD", t), t) for i, t in enumerate(texts)], "k int, a string, b string")
    assert all(r.verified and r.differences == 0 for r in fidelity.check_text(pairs, keys=["k"], source="a", result="b").collect())


def test_words_that_are_lacking(spark):
    rng = random.Random(6)
    rows = [(i, rng.choices("abcd", k=rng.randrange(0, 12)), rng.choice([None, rng.choices("abcde", k=rng.randrange(0, 12))])) for i in range(60)] + [(None, None, ["a"])]
    want = []
    for k, own, other in rows:
        left = list(other or ())
        for at, w in enumerate(own or (), 1):
            if w in left:
                left.remove(w)
            else:
                want.append((k, at, w))
    got = compare.bag_missing(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), key="k", source="a", kept="b").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_following_over_several_levels(spark):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-500, 4000), 300))
    got = compare.following(spark.createDataFrame([(i,) for i in ids], "i long"), "i", block=4).collect()
    assert sorted(map(tuple, got)) == list(zip(ids[1:], ids))
