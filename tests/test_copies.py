"""Copied blocks against a plain plan with union-find."""

import random

from pyspark.sql import functions as F

from quire.operators import components, copies


def joined(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges, want = [], set()
    for key in range(6):
        n = 40
        pairs = [(i, i + 1) for i in range(20)] if key == 0 else [(5, i) for i in range(30)] if key == 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(25)]
        root = joined(n, pairs)
        want |= {(key, x, root[x]) for x in {x for p in pairs if p[0] != p[1] for x in p}}
        edges += [(key, a, b) for a, b in pairs]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "k long, u long, v long"), "k").collect()}
    assert got | {(k, r, r) for k, _, r in got} >= want and {(k, x, r) for k, x, r in got if x != r} == {(k, x, r) for k, x, r in want if x != r}


def plain_plan(elements, blocks, regions, uses, breaks):
    """elements: (sources, unchanged, is_break) in order; blocks: (contained, safe, drawings)."""
    count, owner, pairs = len(blocks), {}, []
    for p, (sources, *_) in enumerate(elements):
        for c in sources:
            if 0 <= c < count:
                pairs.append((p, owner.setdefault(c, p)))
    pairs += [(p, a) for a, b in regions for p in range(a, b + 1) if elements[a][0] and elements[p][0]]
    root = joined(len(elements), pairs)
    groups, children = {}, {}
    for p, (sources, *_) in enumerate(elements):
        if sources:
            groups.setdefault(root[p], []).append(p)
            children.setdefault(root[p], set()).update(c for c in sources if 0 <= c < count)
    held = [sum(c in e[0] for e in elements) for c in range(count)]
    deleted = {c for c in range(count) if uses[c] > held[c]}
    gone = {c for c in deleted if not held[c]}
    for c in range(count):
        if not held[c] and c not in gone and owner:
            near = max((x for x in owner if x < c), default=min(owner))
            children[root[owner[near]]].add(c)
    out = set()
    for g, members in groups.items():
        took = sorted(children[g])
        sources = [min(elements[p][0]) for p in members]
        good = all(elements[p][1] and all(0 <= c < count for c in elements[p][0]) and (breaks or not elements[p][2]) for p in members)
        good = good and members == list(range(members[0], members[-1] + 1)) and sources == sorted(sources) and not deleted & set(took)
        good = good and took == [c for c in range(took[0], took[-1] + 1) if c not in gone] and all(blocks[c][0] and blocks[c][1] for c in took)
        alone = [c for c in took if not held[c] and blocks[c][2]]
        out.add((g, good, tuple(took), None if good or not alone else tuple(alone)))
    return out


def test_plans_against_union_find(spark):
    rng = random.Random(7)
    rows = {"e": [], "b": [], "r": [], "u": []}
    want = {}
    for doc in range(60):
        n = rng.randrange(1, 14)
        blocks = [(rng.random() < 0.93, rng.random() < 0.95, rng.random() < 0.5) for _ in range(rng.randrange(1, 16))]
        order = sorted(rng.choices(range(len(blocks)), k=n)) if rng.random() < 0.8 else rng.choices(range(len(blocks)), k=n)
        elements = [([] if rng.random() < 0.1 else sorted({c, *([c + 1] if rng.random() < 0.2 else [])}), rng.random() < 0.9, rng.random() < 0.1) for c in order]
        regions = [(a, rng.randrange(a, n)) for a in range(n) if rng.random() < 0.05]
        uses = [rng.choice([0, 1, 1, 1, 2]) for _ in blocks]
        want[doc] = {b: plain_plan(elements, blocks, regions, uses, b) for b in (True, False)}
        rows["e"] += [(doc, p, f"{doc}-{p}", s, u, x) for p, (s, u, x) in enumerate(elements)]
        rows["b"] += [(doc, c, *b) for c, b in enumerate(blocks)]
        rows["r"] += [(doc, a, b) for a, b in regions]
        rows["u"] += [(doc, c, k) for c, k in enumerate(uses)]
    e = spark.createDataFrame(rows["e"], "doc_id int, pos long, element_id string, sources array<long>, unchanged boolean, is_break boolean")
    b = spark.createDataFrame(rows["b"], "doc_id int, child long, contained boolean, safe boolean, drawings boolean")
    r, u = spark.createDataFrame(rows["r"], "doc_id int, first long, last long"), spark.createDataFrame(rows["u"], "doc_id int, child long, uses int")
    for breaks in (True, False):
        groups, out = copies.copy_plan(e, b, r, u, breaks=breaks)
        got = {}
        for x in groups.collect():
            got.setdefault(x.doc_id, set()).add((x.group, x.copied, tuple(x.children), tuple(x.after) if x.after else None))
        assert got == {d: w[breaks] for d, w in want.items() if w[breaks]}
        first = {(d, g, c) for d, w in want.items() for g, good, c, _ in w[breaks] if good}
        assert {(x.doc_id, x.pos, tuple(x.write)) for x in out.where("copied and size(write) > 0").collect()} == first
    assert sum(g[1] for w in want.values() for g in w[True]) > 20


def test_losses_are_differences_of_bags(spark):
    groups = spark.createDataFrame([("a", 0, False, [0, 1]), ("a", 5, False, [2]), ("a", 6, True, [3]), ("b", 0, False, [0]), ("c", 0, False, [0])], "doc_id string, group long, copied boolean, children array<long>")
    held = spark.createDataFrame([("a", 0, "text effects", 2), ("a", 1, "tracked changes", 1), ("a", 2, "drop caps", 1), ("a", 3, "page borders", 1), ("b", 0, "tracked changes", 3), ("c", 0, "text boxes", 2)], "doc_id string, child long, kind string, n int")
    back = spark.createDataFrame([("a", 0, "text effects", 1), ("c", 0, "text boxes", 2), ("c", 0, "drop caps", 1)], "doc_id string, child long, kind string, n int")
    got = {r.doc_id: (r.blocks, r.kinds) for r in copies.rewritten_losses(groups, held, back, F.col("doc_id") == "b").collect()}
    assert got == {"a": (2, ["drop caps", "text effects"]), "b": (1, ["tracked changes"])}
