"""Repeated phrases, vector codes and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import codes, importance, phrases, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted(rows, key=str)


def plain_phrases(docs, n=20):
    texts = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, w in texts:
        for p in range(len(w) - n + 1):
            if i is not None:
                least[tuple(w[p : p + n])] = min(least.get(tuple(w[p : p + n]), i), i)
    out = []
    for i, w in texts:
        gone, own = [False] * len(w), {}
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            if own.setdefault(k, p) < p or (i is not None and least[k] < i):
                gone[p : p + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return ordered(out)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_phrases_of_the_query(spark):
    got = queries.queries()["op11_phrase_dedup"](spark, SF).collect()
    assert ordered(map(tuple, got)) == plain_phrases(documents(spark))
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("words", [1, 2, 3, 50])
def test_phrases_of_periodic_and_repeated_texts(spark, words):
    rng = random.Random(words)
    base = [" ".join(rng.choices([f"w{i}" for i in range(words)], k=rng.randint(0, 90))) for _ in range(30)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(base) for _ in range(rng.randint(0, 4)))
        rows.append((rng.choice([i, i, i, rng.randint(0, 120), None]), rng.choice([text, text, text, None, "", " \x0b\t"])))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, data string").repartition(5)
    for hot in (phrases.HOT_CHUNKS, 1):
        out = phrases.remove_phrases(df, hot_chunks=hot).collect()
        assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == plain_phrases(rows)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


def test_phrases_beyond_a_chunk_and_an_automaton(spark, monkeypatch):
    rng = random.Random(9)
    long = " ".join(rng.choices([f"v{i}" for i in range(3000)], k=30_000))
    words = long.split()
    rows = [(3, long), (1, " ".join(words[5000:5100])), (2, long + " " + long), (7, " ".join(words[100:119])), (8, None), (9, "é " * 19 + "  " + "é " * 21)]
    monkeypatch.setattr(phrases, "PATTERNS", 7)
    monkeypatch.setattr(phrases, "CHUNK", 40_000)
    got = phrases.remove_phrases(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert ordered(tuple(r)[:4] for r in got.collect()) == plain_phrases(rows)
    assert phrases.remove_phrases(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_are_found_where_they_stand():
    rng = np.random.default_rng(5)
    numbers = rng.integers(0, 2, 4000).astype(np.int32)
    windows = np.array([hash(numbers[i : i + 20].tobytes()) for i in range(len(numbers) - 19)], np.int64).view(np.uint64)
    first = np.arange(0, 3900, 31)
    n = rng.integers(1, phrases.SPAN + 1, len(first))
    block, window, passage = phrases.occurrences(numbers, windows, first, n, np.zeros(len(first), bool))
    told = {}
    for b, w, p in zip(block.tolist(), window.tolist(), passage.tolist()):
        told.setdefault(numbers[first[b] + w : first[b] + w + 20].tobytes(), set()).add((b, w))
    every = {}
    for b in range(len(first)):
        for w in range(n[b]):
            every.setdefault(numbers[first[b] + w : first[b] + w + 20].tobytes(), set()).add((b, w))
    assert told == {k: v for k, v in every.items() if len(v) > 1}


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label), kept ones only."""
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, i or 0))[:entries]
    v = [[math.floor(256 * float(x)) for x in r[1]] for r in rows]
    w = -(-max(map(len, v)) // parts)
    v = np.array([x + [0] * (w * parts - len(x)) for x in v], object).reshape(len(v), parts, w)
    start = [min((v[k].tolist() for k, r in enumerate(rows) if r[0] == i)) for i in ids]
    books = np.array(start, object).transpose(1, 0, 2).copy()

    def assigned():
        d = ((v[:, :, None, :] - books[None]) ** 2).sum(-1)
        best = d.min(-1)
        return np.array([[list(d[i, p]).index(best[i, p]) for p in range(parts)] for i in range(len(v))]), best

    for _ in range(rounds):
        a, _ = assigned()
        for p in range(parts):
            for k in range(len(ids)):
                own = v[a[:, p] == k, p]
                if len(own):
                    books[p, k] = own.sum(0) // len(own)
    a, d = assigned()
    errors = d.sum(1)
    by = Counter()
    for r, e in zip(rows, errors):
        by[r[2]] += e
    told = [(r[0], "".join(f"{x:02x}" for x in a[i]), errors[i], by[r[2]]) for i, r in enumerate(rows)]
    return ordered(told), hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()


def test_codes_of_the_query(spark):
    got = queries.queries()["op12_vector_codes"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, digest = plain_codes(rows)
    assert ordered(tuple(r)[:4] for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}


KIND = "vec_id long, embedding array<float>, label int, vector string, id int, code string"


@pytest.mark.parametrize("count", [5, 130])
def test_codes_of_odd_vectors(spark, count):
    rng = random.Random(count)
    rows = []
    for i in range(count):
        v = [rng.choice([0.0, 0.5, -0.5, rng.uniform(-2, 2), 1e-9, -1e-9]) for _ in range(rng.choice([35, 35, 35, 20, 0]))]
        rows.append((rng.choice([i, i, i // 3, None]), v, rng.choice([1, 1, 2, None])))
    rows += rows[:3]
    bad = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 35, 2), (None, [float("inf")] + [0.0] * 34, None), (-5, [0.0, float("-inf")], 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows + bad], KIND).repartition(3)
    out, books = codes.compress(df)
    kept = [tuple(r)[:3] for r in spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KIND).collect()]
    want, digest = plain_codes(kept)
    assert ordered((r.id, r.code, r.error, r.label_error) for r in out.collect()) == want and books.digest() == digest


def test_codes_without_rows_and_with_many_labels(spark, monkeypatch):
    out, books = codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert out.count() == 0 and books is None
    monkeypatch.setattr(codes, "LABELS_AT_ONCE", 2)
    rows = [(i, [float(i % 7), 1.0], i % 5 or None) for i in range(90)]
    out, _ = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert ordered(map(tuple, out.select("id", "code", "error", "label_error").collect())) == plain_codes(rows)[0]


def test_trees_find_the_nearest_entry_among_ties():
    rng = np.random.default_rng(1)
    for width, high in ((1, 4), (3, 2), (4, 1 << 26)):
        entries = rng.integers(-high, high + 1, (16, 64, width))
        vectors = rng.integers(-high, high + 1, (500, 16 * width))
        index, square = codes.Codebooks(entries).assign(vectors)
        d = ((vectors.reshape(500, 16, 1, width) - entries[None]) ** 2).sum(-1)
        assert (index == d.argmin(-1)).all() and (square == d.min(-1)).all()


def plain_resampling(docs, bench, longest=1, buckets=10_000, least=20, share=10):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in bench for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(drawn[: share * len(drawn) // 100])}
    return ordered((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows)


def test_resampling_of_the_query(spark):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.queries()["op13_importance_resampling"](spark, SF).collect()
    assert ordered(map(tuple, got)) == plain_resampling(documents(spark), bench)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_odd_texts(spark, longest, monkeypatch):
    rng = random.Random(longest)
    texts = [None, "", " . ", "ONE two", "é ñandú 😀😀 x1", " ".join(rng.choices("abcdefgh", k=5000)), " ".join(rng.choices(["Word", "other", "3rd", "é"], k=40))]
    rows = [(rng.choice([i, i, i // 2, None]), rng.choice(texts)) for i in range(150)]
    bench = [None, "", "word OTHER word", "a b c"]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, side int, words string, score int").repartition(3)
    target = spark.createDataFrame([(t, 5) for t in bench], "text string, doc_id int")
    monkeypatch.setattr(importance, "CHUNK", 3000)
    monkeypatch.setattr(importance, "RANKED", 20)
    out = importance.resample(df, target, longest=longest)
    assert ordered(map(tuple, out.select("id", "n_features", "weight", "score", "rank").collect())) == plain_resampling(rows, bench, longest)
    assert out.where("rank is not null").count() == 10 * out.where("n_words >= 20").count() // 100


def test_resampling_of_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(docs, target).count() == 0
    some = spark.createDataFrame([(i, "w " * 30) for i in range(20)], "doc_id long, text string")
    assert sorted(r.rank for r in importance.resample(some, target).where("rank > 0").collect()) == [1, 2]
