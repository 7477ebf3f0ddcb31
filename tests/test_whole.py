"""Queries do the whole job: against plain models on cases that the given tables lack."""

import random

import duckdb
import pytest

from quire.plans import catalogue, health_queries, rule_queries
from quire.plans.relations import with_

from .test_catalogue import SF, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(spark, duck, name, sql):
    df = catalogue.queries()[name](spark, SF)
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), columns)


@pytest.mark.parametrize("name", ["p22_usable_rules", "w1_winning_rules", "d21_rule_css", "w2_resolved_styles", "a18_first_by_priority"])
def test_rules_of_all_orders(spark, duck, name):
    same(spark, duck, name, catalogue.oracle_sql()[name])
    docs = duck.execute(with_(rule_queries.RULES) + "select count(distinct doc_id) from rules").fetchone()[0]
    if name in ("w2_resolved_styles", "p22_usable_rules"):
        found = catalogue.queries()[name](spark, SF).select("doc_id").distinct().count()
        assert found == docs if name == "w2_resolved_styles" else found > 0.9 * docs


def test_bag_difference_of_every_document(spark, tmp_path):
    from collections import Counter

    docs = [(3, "b a b"), (4, "a c b b b"), (1500, "c a"), (9000, "x"), (9001, "x x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, before = [], Counter()
    for k, text in docs:
        left, before = before, Counter(text.split())
        for at, w in enumerate(text.split(), 1):
            if left[w] > 0:
                left[w] -= 1
            else:
                want.append((k, at, w))
    assert sorted(map(tuple, catalogue.queries()["j16_bag_missing"](spark, str(tmp_path)).collect())) == want


def benchmarked(spark, folder):
    docs = [(1, "the cat sat on the mat and slept"), (2, "a b a b a b a b"), (3, ""), (4, "mat the on sat cat the"), (5, "zero one two three four five six"), (6, "one two")]
    items = [(0, "the cat sat on the mat and slept"), (41, "b a b a b a b"), (77, "one two"), (150, "nothing before zero one two three four"), (199, "the mat slept"), (200, "..."), (201, "sat cat the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(d, t.split()) for d, t in docs], [(i, t.replace(".", "").split()) for i, t in items]


def test_runs_of_all_items_in_all_documents(spark, tmp_path):
    docs, items = benchmarked(spark, tmp_path)
    want = set()
    for i, needed in items:
        n = min(5, len(needed))
        for at in range(len(needed) - n + 1) if n else ():
            want |= {(d, i, at + 1) for d, w in docs if any(w[k : k + n] == needed[at : at + n] for k in range(len(w) - n + 1))}
    got = catalogue.queries()["o14_contiguous_words"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "at").collect()) == sorted(want)
    assert {i for _, i, _ in want} == {0, 41, 77, 150, 201}


def test_whole_items_in_order_in_all_documents(spark, tmp_path):
    docs, items = benchmarked(spark, tmp_path)

    def in_order(needed, found):
        rest = iter(found)
        return all(w in rest for w in needed)

    want = sorted((d, i) for d, w in docs for i, needed in items if needed and in_order(needed, w))
    assert sorted(map(tuple, catalogue.queries()["o13_subsequence"](spark, str(tmp_path)).collect())) == want
    assert (1, 199) in want and (5, 77) in want and (4, 201) in want


def test_levels_inferred_where_there_are_no_headings(spark, tmp_path):
    import re
    from collections import defaultdict

    rng = random.Random(5)
    docs = [(k, "\n".join("w" * rng.randrange(1, 14) + " " + "x" * rng.randrange(1, 30) + rng.choice(["", "", "."]) for _ in range(rng.randrange(1, 6)))) for k in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for d, text in docs:
        lines = text.split("\n")
        if len(lines) > 3 and d % 2 == 0:  # the fourth line is a heading
            continue
        looks = [(len(c) % 4 + 10.0, len(c) % 7 == 0) for c in lines]
        weight, first = defaultdict(int), {}
        for k, c in enumerate(lines):
            weight[looks[k]] += max(1, len(c.strip(" ")))
            first.setdefault(looks[k], k)
        size, bold = min(weight, key=lambda x: (-weight[x], first[x]))
        out = [k for k, c in enumerate(lines) if not re.search(r"[.,;]$", c) and (looks[k][0] >= size + 1 or (looks[k][1] and not bold))]
        ranks = sorted({looks[k] for k in out}, key=lambda x: (-x[0], not x[1]))
        want |= {(d, f"{d}-{k}"): ranks.index(looks[k]) + 1 for k in out} if len(out) * 2 <= len(lines) else {}
    got = catalogue.queries()["o5_inferred_levels"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.element_id): r.level for r in got} == want and len(got) == len(want) > 0


def test_scores_of_all_eleven_checks(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    docs = [(k, "\n".join(rng.choice(["", "1. ", "2) ", "1.1 ", f"{j // 11 + 1}. "] if k % 2 or j % 11 != 3 else [""]) + "word " * rng.randrange(1, 20) for j in range(rng.choice([3, 10, 30, 80])))) for k in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    with monkeypatch.context() as m:
        m.delitem(health_queries.CHECKS, "numbering")
        ten = sorted(con.execute(health_queries.score_sql()).fetchall())
    states = {r[0] for r in con.execute("select distinct status from (" + health_queries.sql_of("numbering") + ")").fetchall()}
    want = sorted(con.execute(health_queries.score_sql()).fetchall())
    got = catalogue.queries()["a13_health_score"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.score, r.rating) for r in got.collect()) == want != ten
    assert states == {"skip", "pass", "warn", "fail"}


def conversations(spark, folder, rows):
    spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")


def test_every_turn_is_written_and_read_again(spark, duck, tmp_path):
    conversations(spark, tmp_path, [(1, k, f"turn {k} of a long talk") for k in range(25)] + [(2, 9, "late only"), (3, 0, "  ")])
    got = catalogue.queries()["k1_word_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 25, True), (2, 1, True)]
    same(spark, duck, "k1_word_round_trip", catalogue.oracle_sql()["k1_word_round_trip"])


def test_numbers_lost_are_told(spark, tmp_path):
    conversations(spark, tmp_path, [(1, 0, "8 of 9"), (1, 1, "3 cats"), (1, 2, "7 dogs and 7 cats and 12"), (1, 5, "no digits")])
    got = catalogue.queries()["o12_changed_numbers"](spark, str(tmp_path)).select("turn", "missing", "added").collect()
    assert sorted(map(tuple, got)) == [(0, [], []), (1, [], ["17"]), (2, ["7"], []), (5, [], [])]


def test_pairs_of_every_turn_are_verified(spark, tmp_path):
    conversations(spark, tmp_path, [(1, 0, "a b"), (1, 1, "a b"), (1, 2, "alone"), (1, 3, "c"), (1, 5, "one two")])
    got = catalogue.queries()["v1_verified_pairs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, 2, True), (1, 1, 2, 5, False), (1, 2, 1, 1, True), (1, 3, 1, 1, True), (1, 5, 2, 1, False)]


def test_line_heights_of_all_quantities(spark, duck):
    same(spark, duck, "d17_line_heights", catalogue.oracle_sql()["d17_line_heights"])


def test_chunks_of_short_texts_and_long_lines(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "x" * rng.randrange(1, 12)
    lines = {1: ["short"], 2: [" ".join(word() for _ in range(4000)), "end"], 3: ["y" * 20000, "z"], 4: ["a" * 4000] * 9, 5: ["b" * 8999, "c", "d" * 9001], 6: ["e" * 9000]}
    spark.createDataFrame([(k, "\n".join(v)) for k, v in lines.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, own in lines.items():
        sizes = []
        for line in own:
            while len(line) > 9000:
                at = line.rfind(" ", 0, 9001)
                sizes.append(at if at > 0 else 9000)
                line = line[at + 1 :] if at > 0 else line[9000:]
            sizes.append(len(line))
        packed = [sizes[0]]
        for n in sizes[1:]:
            if packed[-1] + 2 + n > 9000:
                packed.append(n)
            else:
                packed[-1] += 2 + n
        want += [(k, j, n) for j, n in enumerate(packed)]
    assert sorted(map(tuple, catalogue.queries()["g1_packed_chunks"](spark, str(tmp_path)).collect())) == want
