"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, golay, learning, lines, mixing, quality, repeats, secrets, sharding, simhash, toxicity, urls

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rules string, _size long, _verdict string, fp string"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(40_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)),
    (6, PASSAGE + " tail", None, "b", 3), (7, PASSAGE, "en", None, 4), (7, PASSAGE, "en", None, 4), (None, PASSAGE + " other words follow here", "de", "c", 5), (None, None, None, None, None),
    (8, "é" * 300 + "\u2028 ñandú 😀😀 " + PASSAGE, "es", "c", 9), (9, "password = hunter2hunter2 AKIA" + "A1" * 10 + " " + "0af3" * 10, "en", "a", 3), (10, "x" * 49, "en", "a", 49), (11, "y" * 120, "en", "a", 120),
    (12, "secret=abc token: 'longenough1' 😀 api_key=\"abcdefgh\"", "en", "a", 1), (13, "one two three", "en", "d", 1), (14, "ONE two three", "en", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "r", 5, "v", "f") for r in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_secrets(spark, odd, none, tmp_path):
    rows = odd.withColumnRenamed("text", "content").drop("fp")
    out, _ = secrets.scan(rows.selectExpr("*", "1 as blob", "2 as findings", "3 as _found", "4 as _blob"))
    assert out.columns[:-1] == [*rows.columns, "blob", "findings", "_found", "_blob"]
    out = out.withColumn("findings", out[out.columns[-1]])
    base = tuple(r.kind for r in secrets.BASE)
    got = [(r.content, brute.sha(",".join(f"{f.kind}:{f.start}:{f.end}" for f in r.findings if f.kind in base))) for r in out.collect()]
    assert Counter(got) == Counter((t, brute.secrets(t)[1]) for _, t, *_ in ODD)
    assert secrets.scan(none.withColumnRenamed("text", "content"))[0].count() == 0


def test_ledger_scans_only_what_it_has_not_seen(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "nothing"), ("c", "nothing")], "path string, content string")
    secrets.scan(first, path=path)
    n = spark.read.parquet(path).count()
    assert n == 2 * len(secrets.RULES)
    again, _ = secrets.scan(first.union(spark.createDataFrame([("d", "token=abcdefgh1"), ("e", "AKIA" + "Z" * 16)], first.schema)), path=path)
    assert spark.read.parquet(path).count() == n + len(secrets.RULES)
    assert {r.path: len(r.findings) for r in again.collect()} == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 1}
    newer = (*secrets.RULES[1:], secrets.Rule("assign", "token=[a-z]+", version=2))
    secrets.scan(first, path=path, rules=newer)
    assert spark.read.parquet(path).count() == n + len(secrets.RULES) + 2


def test_contamination(spark, odd, none):
    items = [(1, PASSAGE), (2, PASSAGE), (3, "one two"), (4, ""), (5, None), (None, "three"), (6, "😀")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(x[1:] for x in brute.contamination([r[:2] for r in ODD], items))
    for size in (decontaminate.ITEM_BYTES, 40, 4):  # one block, and several
        out, name = decontaminate.decontaminate(odd, bench, item_bytes=size)
        got = Counter((a.n_words, a.n_hit, len(a.item_ids), decontaminate.digest(a.item_ids), a.n_hit > 0 and 20 * a.n_hit >= a.n_words) for a in (r[name] for r in out.collect()))
        assert got == want
        assert set(odd.columns) < set(out.columns)
    assert decontaminate.decontaminate(none, bench)[0].count() == 0
    out, name = decontaminate.decontaminate(odd, bench.limit(0))
    assert all(r[name].n_hit == 0 for r in out.collect()) and out.count() == len(ODD)


def test_rules(spark, odd, none):
    out = lines.judge(odd, share=0, floor=1).collect()
    assert bag((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == bag(brute.rules(t) for _, t, *_ in ODD)
    assert lines.judge(none).count() == 0
    shared = "this line stands in many documents of one host"
    many = spark.createDataFrame([(i, f"{shared}\n{'own words ' * 6} {i} and some more of it", "h") for i in range(5)] + [(9, shared + "\nwords 1 2", "h"), (10, shared + "\nwords 1 2", "h"), (11, shared + "\nother", "g")], "doc_id long, text string, source string")
    got = {r.id: (r.n_removed_words, r.kept) for r in lines.judge(many, share=0, floor=5).collect()}
    assert got[0][0] == 9 and got[9] == (9, False) and got[10] == (9, False) and got[11][0] == 0


def test_salted_join_of_frequent_lines_agrees(spark, odd):
    rows = odd.selectExpr("doc_id as id", "source as host", "text")
    rows = lines.read_once(rows, id_col="id", host_col="host", text_col="text")
    frequent = lines.frequent_lines(rows, share=0, floor=0).cache()
    a, b = (bag(lines.removed_words(rows, frequent, n).collect()) for n in (0, lines.BROADCAST_ROWS + 1))
    assert a == b and a


def test_classifiers(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 15)] + [(1, 1, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for module, kw in ((toxicity, {"label": "toxic"}), (quality, {"label": "quality"})):
        for labelled in (labels, labels.where("toxic = 1"), labels.limit(0)):
            model = module.train(odd, labelled, **kw)
            out, name = module.score(odd, model)
            scores = [r[name] if module is toxicity else r[name].score for r in out.collect()]
            assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
        assert module.score(none, model)[0].count() == 0
        assert module.train(none, labels, **kw) is not None
    folds = {r[0]: r[1] for r in odd.select("doc_id", learning.fold(odd.doc_id)).collect()}
    assert all(v == brute.fold(k) for k, v in folds.items())


def test_repeats(spark, odd, none):
    got = bag(repeats.remove_repeats(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter(brute.repeats([r[:2] for r in ODD]))
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_on_text_of_few_symbols(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(900))
    docs = []
    for i in range(40):
        at = rng.randrange(0, 700)
        own = list(base[at : at + rng.randrange(40, 200)])
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = "c"
        docs.append((rng.randrange(30), "a" * rng.randrange(0, 130) + "".join(own) + "ab" * rng.randrange(0, 60)))
    monkeypatch.setattr(repeats, "CHUNK", 700)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = bag(repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter(brute.repeats(docs))


def test_sharding(spark, odd, none):
    out = sharding.shard(odd, shards=3).collect()
    assert len(out) == len(ODD)
    slots, home = defaultdict(list), defaultdict(set)
    names = out[0].asDict().keys()
    size, crc = "_size_", "_crc"
    assert {size, crc, "_shard", "_slot"} < set(names)
    for r in out:
        assert r[size] == len((r.text or "").encode()) + 1 and r[crc] == zlib.crc32((r.text or "").encode())
        slots[r._shard].append(r._slot)
        home[r.text or ""].add(r._shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in home.values())
    assert sharding.shard(none).count() == 0
    bare = sharding.shard(odd, shards=3, texts=False)
    assert bag((r.doc_id, r[size], r[crc], r._shard) for r in bare.collect()) == bag((r.doc_id, r[size], r[crc], r._shard) for r in out)


@pytest.mark.parametrize("texts", [True, False])
def test_sharding_in_many_parts_with_a_hot_row(spark, monkeypatch, texts):
    """Slots over several numbering groups, one row in a third of all, and groups fetched bucket by bucket."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    monkeypatch.setattr(sharding, "MOST_GROUPS", 1)
    monkeypatch.setattr(sharding, "MOST_HELD", 2)
    rows = [(i % 150, f"text {i % 90}") for i in range(300)] + [(7, "hot")] * 150 + [(None, None)] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard(docs, shards=4, texts=texts).collect()
    slots, home = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r._shard].append(r._slot)
        home[r._crc].add(r._shard)
    assert Counter((r.doc_id, r._crc) for r in out) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in home.values()) and len(slots) == 4


class Listed(sharding.Ordered):
    """Groups held in a list: 64 buckets of them."""

    def __init__(self, sizes):
        import numpy as np

        self.sizes = sizes
        self.parts = [sizes[k : k + 3] for k in range(0, len(sizes), 3)]
        self.names = list(range(len(self.parts)))
        self.after = np.cumsum([sum(p) for p in self.parts])
        self.counts = np.array([len(p) for p in self.parts])
        self.total, self.most, self.held, self.fetched = sum(sizes), max(sizes), {}, set()

    def fetch(self, ks):
        self.fetched |= set(ks)

    def detail(self, k):
        import numpy as np

        assert k in self.fetched, "a bucket that was not foreseen"
        base = int(self.after[k - 1]) if k else 0
        return base + np.cumsum(self.parts[k]), [f"{k}-{i}" for i in range(len(self.parts[k]))]


def test_least_capacity_is_least():
    import random

    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice((1, 2, 5, 40)) for _ in range(rng.randrange(1, 25))]
        shards = rng.randrange(1, 6)
        best = [[0] * (len(sizes) + 1) for _ in range(shards + 1)]
        best[0] = [0] + [10**9] * len(sizes)
        for s in range(1, shards + 1):
            for j in range(len(sizes) + 1):
                best[s][j] = min(max(best[s - 1][i], sum(sizes[i:j])) for i in range(j + 1))
        order = Listed(sizes)
        capacity, cuts = sharding.cuts(order, shards)
        edges = [0, *cuts, order.total]
        assert capacity == best[shards][len(sizes)]
        assert all(0 <= b - a <= capacity for a, b in zip(edges, edges[1:]))


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://WWW.Example.COM/en/x?y#z"), (5, "http://example.com/en/"), (6, "https://a.net/es/1"), (7, "https://a.net/ES/1"), (8, "http://example.com"), (9, "x://b.org/p\nq?r"), (9, "x://b.org/p\nq?r")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' as _host"))
    got = {r.page_id: (r._host_, r._path, r._rule, r._verdict) for r in out.collect()}
    assert got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[6][2:] == ("net/es/", "block") and got[7][2] is None and got[8][2] is None and got[9][:2] == ("b.org", "/p\nq")
    assert out.count() == len(rows)


def test_mixing(spark, odd, none):
    out, plan = mixing.mix(odd)
    rows = out.collect()
    assert len(rows) == len(ODD)
    total = sum(r["size"] for r in rows)
    target = {r.source: r.mix.target for r in rows}
    assert abs(sum(target.values()) - 1.5 * total) < 1
    for s in target:
        assert abs(sum(r.mix.taken for r in rows if r.source == s) - target[s]) <= 2 * mixing.BLOCK
    assert all(r.mix.taken <= 2 * r["size"] for r in rows)
    quotas = defaultdict(int)
    for r in plan.quotas.collect():
        quotas[r.source] += r.blocks
    assert quotas == {r.source: r.blocks for r in plan.sources.collect()}
    assert mixing.mix(none)[0].count() == 0
    assert mixing.mixed_texts(odd, plan).columns == odd.columns


def test_mixing_fills_the_quotas_of_shards(spark):
    import random

    rng = random.Random(4)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(rng.choice((0, 1, 5, 60, 700)))), rng.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    out, plan = mixing.mix(df)
    rows = out.withColumn("own", mixing.shard_words(out["mix"])).collect()
    quotas = {(r.shard, r.source): r.blocks for r in plan.quotas.collect()}
    size = {r.source: r.mix.source_size for r in rows}
    for s in "abc":
        ends = [min(mixing.BLOCK * sum(quotas[k, s] for k in range(upto)), 2 * size[s]) for upto in range(9)]
        assert [sum(r.own[k] for r in rows if r.source == s) for k in range(8)] == [b - a for a, b in zip(ends, ends[1:])]
    mixed = mixing.mixed_texts(df, plan, shard_to="shard").collect()
    words = defaultdict(list)
    for r in sorted(mixed, key=lambda r: (r.doc_id, r.shard)):
        words[r.doc_id, r.shard] += r.text.split()
    assert {k: len(v) for k, v in words.items()} == {(r.id, k): n for r in rows for k, n in enumerate(r.own) if n}
    text = {d: t.split() for d, t, _ in docs}
    for d, own in text.items():
        taken = Counter(w for k in range(8) for w in words[d, k])
        assert all(taken[w] in (1, 2) for w in taken) and set(taken) <= set(own)
    joined = Counter((r.doc_id, w) for r in mixing.mixed_texts(df, plan).collect() for w in r.text.split())
    assert joined == Counter((d, w) for (d, _), v in words.items() for w in v)


def test_mixing_of_many_repeated_rows(spark):
    docs = [(7, "one two three four five", "a")] * 1000 + [(i, "w " * 40, "b") for i in range(100)]
    out, _ = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg(F.sum("mix.taken").alias("taken"), F.first("mix.target").alias("target")).collect():
        assert -1000 - mixing.BLOCK < r.taken - r.target <= mixing.BLOCK


def test_sainte_lague_by_rounds():
    import random
    from fractions import Fraction

    rng = random.Random(2)
    for _ in range(200):
        votes = [Fraction(rng.choice((0, 1, 3, 10, 10, 500))) for _ in range(rng.randrange(1, 8))]
        seats = rng.randrange(0, 60)
        want = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[k] += 1
        assert mixing.sainte_lague(votes, seats) == want


def test_simhash(spark, odd, none):
    out = simhash.near_duplicates(odd).collect()
    prints = [(i, brute.fingerprint(t)) for i, t, *_ in ODD]
    want = Counter((i, f, c) for (i, f), c in zip(prints, brute.components(prints)))
    assert Counter((r.id, r.fp % (1 << 64), r.component) for r in out) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd).collect()
    assert len(kept) == len(set(brute.components(prints))) and kept[0].asDict().keys() == set(odd.columns)


def test_golay_keys_find_every_near_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000)
    for flips in (1, 2):
        u = v.copy()
        for _ in range(flips):
            u ^= 1 << rng.integers(0, 23, len(u))
        (a, ra), (b, rb) = golay.keys(v), golay.keys(u)
        assert all(set(x[p]) & set(y[q]) for x, p, y, q in zip(a, ra, b, rb))
        if flips == 1:
            assert all(x[0] in set(y[q]) for x, y, q in zip(a, b, rb))


def test_fingerprint_links_are_all_found(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    fps = []
    for _ in range(150):
        f = int(rng.integers(0, 1 << 63)) * 2 + 1
        fps.append(f)
        for _ in range(3):
            g = f
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted(set(fps))
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "id long, fp long")
    got = {r.fp: r.component for r in simhash.group(table, id_col="id", print_col="fp").collect()}
    want = brute.components(list(enumerate(fps)))
    assert [got[r[1]] for r in rows] == want


def test_long_runs_of_one_key_lose_no_link(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(11)
    fps = []
    for _ in range(60):
        f = int(rng.integers(0, 1 << 40)) << 20 | 77
        fps += [f, *(f ^ sum(1 << int(b) for b in 20 + rng.choice(40, k, replace=False)) for k in (2, 4, 5))]
    fps = np.unique(np.array(fps, np.uint64))
    want = brute.components([(k, int(f)) for k, f in enumerate(fps)])
    for most in (8, 10**6):
        monkeypatch.setattr(simhash, "LONG_RUN", most)
        a, b = simhash.forest(np.zeros(len(fps), np.uint64), fps)
        least = {int(f): int(f) for f in fps} | {int(x): int(y) for x, y in zip(a, b)}
        assert [int(np.searchsorted(fps, least[int(f)])) for f in fps] == want


def test_window_classes_are_strings():
    import random

    import numpy as np

    rng = random.Random(8)
    base = "".join(rng.choice("ab\0") for _ in range(400)).encode() + b"a" * 150
    rows = np.zeros((300, repeats.BLOCK + 2), np.uint8)
    for r in rows:
        n = rng.randrange(1, repeats.SPAN + 1)
        at = rng.randrange(0, len(base) - repeats.BLOCK)
        own = bytearray(base[at : at + n + repeats.LENGTH - 1])
        if rng.random() < 0.3:
            own[rng.randrange(len(own))] = 99
        r[: len(own)] = own
        r[repeats.BLOCK] = n
    row, window, kind = repeats.window_classes(rows)
    assert len(row) == rows[:, repeats.BLOCK].sum()
    strings = [rows[r, w : w + repeats.LENGTH].tobytes() for r, w in zip(row, window)]
    assert len(set(zip(strings, kind.tolist()))) == len(set(strings)) == len(set(kind.tolist())) < len(strings)


def test_pipeline_stages(spark, odd, none):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*plain), odd, none.select(*plain)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert name == "sharding" or out.columns == docs.columns
            if docs is odd and name in ("toxicity", "decontamination", "sharding"):
                assert out.count() == len(ODD)
            else:
                out.write.format("noop").mode("overwrite").save()


def test_pipeline_run(spark, odd, none, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs, name in ((odd.select(*plain), "odd"), (none.select(*plain), "none")):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(folder / f"{t}.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == [*plain, "shard", "slot"]
        rows = out.collect()
        assert (name == "odd") == bool(rows)
        assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(8))
