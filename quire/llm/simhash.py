"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit i is set if more than half of the text's shingle hashes have it. Two fingerprints link if
they differ in at most four bits. Candidates: the fingerprint is cut into segments of 21, 21 and 22 bits, each decoded to
nearby Golay codewords. By the pigeonhole principle, of at most four errors over three segments either

- one segment is free of errors and of the other two one has at most two: the exact segment and a Golay key of the other
  agree (six pairings, up to six keys each); or
- every segment has an error, two of them exactly one and the third at most two: then all three agree in a Golay key -
  for the third both sides give all their keys, of the other two one side gives its nearest codeword only, the left
  side in the one segment and the right side in the other (three choices of the third, up to 36 keys a side).

Distinct fingerprints are keyed, not documents, so groups of copies cost one row. Keys travel packed: a task sends each
bucket one array. A bucket sorts its keys, compares all bits of the fingerprints that share one and sends back a
spanning forest of the links it has confirmed - never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import golay
from .base import append_arrow, fresh, gathered, quoted, written
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Packed (key, fingerprint) rows that one bucket should get.
BUCKET_ROWS = 1 << 20
#: Fingerprints keyed at once in a task.
KEYED = 1 << 13
#: Fingerprints with one key that are split by their other bits before they are compared.
LONG_RUN = 1 << 10


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """SimHash of a text's n-word shingles with repetitions; of the whole sequence if it is shorter; 0 if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(body, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    end = (start + length)[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], SEED) for a, b in zip(start.tolist(), end)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a long column of fingerprints (its name is returned too); whole texts, null as empty."""
    name = fresh("fingerprint", docs)

    def make():
        return lambda texts: pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return append_arrow(docs, [text_col], name, T.LongType(), make), name


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of several integer columns."""
    h = np.zeros(np.broadcast_shapes(*(p.shape for p in parts)), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


def keyed(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of each fingerprint; equal keys of two rows make them a candidate, whichever side sent them."""
    rows = np.arange(len(fp))
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [golay.keys(s) for s in seg]
    out_k, out_r = [], []

    def put(key: np.ndarray, real: np.ndarray) -> None:
        out_k.append(key[real])
        out_r.append(np.broadcast_to(rows.reshape((-1,) + (1,) * (key.ndim - 1)), key.shape)[real])

    for i in range(3):
        for j in range(3):
            if i != j:
                k, real = near[j]
                put(mixed(np.int64(1 + 3 * i + j) + np.zeros_like(k), seg[i][:, None], k), real)
    for third in range(3):
        one, two = (x for x in range(3) if x != third)
        (a, ra), (b, rb), (c, rc) = near[third], near[one], near[two]
        tag = np.int64(20 + third)
        own = tag + np.zeros((len(fp), golay.KEYS, golay.KEYS), np.int64)
        left = mixed(own, a[:, :, None], b[:, :1, None], c[:, None, :])
        put(left, ra[:, :, None] & rc[:, None, :])
        right = mixed(own, a[:, :, None], b[:, None, :], c[:, :1, None])
        again = ra[:, :, None] & rb[:, None, :]
        again[:, :, 0] = False  # the left side has sent the key of both nearest codewords
        put(right, again)
    return np.concatenate(out_k), np.concatenate(out_r)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member of each component) after links a-b have come to those that label stands for."""
    while True:
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, was[a], low)
        np.minimum.at(label, was[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label[a] == label[b]).all():
            return label


def split_runs(fp: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, where runs begin) of the runs that take the place of the given long ones.

    The bits in which a run's members differ are dealt into DISTANCE + 1 parts. Members that differ in DISTANCE bits at most
    agree in a part, so those that agree in one make a new run, part by part.
    """
    fps, begins, n = [], [], 0
    for b, s in zip(begin.tolist(), size.tolist()):
        own = fp[b : b + s]
        differ = int(np.bitwise_or.reduce(own) & ~np.bitwise_and.reduce(own))
        bits = [k for k in range(64) if differ >> k & 1]
        for part in range(DISTANCE + 1):
            value = own & np.uint64(sum(1 << k for k in bits[part :: DISTANCE + 1]))
            order = np.argsort(value, kind="stable")
            value = value[order]
            fps.append(own[order])
            begins.append(n + np.flatnonzero(np.append(True, value[1:] != value[:-1])))
            n += s
    return np.concatenate(fps), np.concatenate(begins)


def forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of fingerprints) that span what the confirmed candidates of one bucket connect.

    Member k of each run of equal keys meets member k + step, for all runs at once; pairs that are connected already are
    not compared, and a run that has become one component is left. Runs longer than LONG_RUN are split first.
    """
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    shared = ~new | np.append(~new[1:], False) if len(key) else new
    fp, new = fp[shared], new[shared]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(fp)))
    if (long := size > LONG_RUN).any():
        more, at = split_runs(fp, begin[long], size[long])
        begin = np.concatenate([begin[~long], len(fp) + at])
        size = np.concatenate([size[~long], np.diff(np.append(at, len(more)))])
        fp = np.concatenate([fp, more])
        begin, size = begin[size > 1], size[size > 1]
    names, node = np.unique(fp, return_inverse=True)
    label, step = np.arange(len(names)), 0
    while len(begin):
        step += 1
        begin, size = begin[size > step], size[size > step]
        for part in range(0, len(begin), 1 << 15):
            b, s = begin[part : part + (1 << 15)], size[part : part + (1 << 15)] - step
            i = gathered(b, s)
            i = i[label[node[i]] != label[node[i + step]]]
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= DISTANCE]
            if len(i):
                label = joined(label, node[i], node[i + step])
        if step & (step - 1) == 0 and len(begin):  # now and then: which runs still have several components
            own = label[node[gathered(begin, size)]]
            start = np.cumsum(size) - size
            open_ = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
            begin, size = begin[open_], size[open_]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def candidate_links(distinct: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of linked fingerprints whose connected components are those of all links; `distinct` has n fingerprints."""
    buckets = 1 + 120 * n // BUCKET_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(whole), KEYED):
                fp = whole[at : at + KEYED]
                key, row = keyed(fp)
                home = (key >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(home, kind="stable")
                key, value, home = key[order], fp[row[order]], home[order]
                edge = np.searchsorted(home, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int64()),
                    pa.array([key[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary()),
                    pa.array([value[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary()),
                ], names=["bucket", "keys", "fps"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(k, []).append((a, b))
        for k in sorted(held):
            own = held.pop(k)
            a, b = forest(*(np.frombuffer(b"".join(x), np.uint64) for x in zip(*own)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    packed = distinct.select("fp").repartition(1 + n // KEYED, "fp").mapInArrow(pack, "bucket long, keys binary, fps binary")
    return packed.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(link, "a long, b long").distinct()


def group(prints: DataFrame, *, id_col: str, print_col: str) -> DataFrame:
    """(fp, root, component) for every distinct fingerprint of a written table of ids and fingerprints.

    component is the least id that links reach; root, a fingerprint, names the group also where that is null.

    Rows with a null id take part in linking; a component of null ids only is null.
    """
    distinct = written(prints.groupBy(quoted(print_col).alias("fp")).agg(F.min(quoted(id_col)).alias("first")), "prints")
    links = candidate_links(distinct, distinct.count())
    reached = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = distinct.join(reached, distinct.fp == reached.node, "left").select("fp", "first", F.coalesce("least", "fp").alias("root"))
    best = named.where("fp != root").groupBy("root").agg(F.min("first").alias("inner"))
    tops = named.where("fp = root").select("root", F.col("first").alias("outer"))
    least = tops.join(best, "root", "left").select("root", F.least("outer", "inner").alias("component"))
    return written(named.select("fp", "root").join(least, "root").select("fp", "root", "component"), "groups")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp: fingerprint as a long, root, component) for every row, and the columns named in keep.

    component is the least id that a chain of links reaches, the row's own included. Equal fingerprints link, so repeated
    rows and all rows without words (null, empty, blank texts: fingerprint 0) are one group each, joined to others only by
    distance. An empty table gives an empty result. Texts of any length are hashed whole; other columns are not read.
    """
    prints, name = fingerprints(docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), *(quoted(c) for c in keep)))
    prints = written(prints.select("id", F.col(name).alias("fp"), *(quoted(c) for c in keep)), "fingerprints")
    groups = group(prints, id_col="id", print_col="fp")
    return prints.join(groups, "fp", "left")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group the row whose id is the component; of rows alike in id and text, one.

    A group whose ids are all null keeps one row; null, empty and blank texts are one group. Of rows with one id and
    different texts the one with the least content hash stays. Very long texts are hashed whole; helper columns take names
    that docs has not; an empty table stays empty. A row that a third of the table repeats is cut to one a task before the
    last shuffle, as its number among its like is only asked to be 1.
    """
    code, nth = fresh("_code", docs), fresh("_nth", docs)
    own = docs.withColumn(code, F.xxhash64(quoted(text_col)))
    rows = near_duplicates(own.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), F.col(code).alias("code")), keep=("code",))
    kept = rows.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min(F.struct("id", "code")).alias("k")).select("k.id", "k.code")
    found = own.join(kept, quoted(id_col).eqNullSafe(kept["id"]) & (F.col(code) == kept["code"]), "left_semi")
    only = W.partitionBy(quoted(id_col), F.col(code)).orderBy(F.lit(0))
    return found.withColumn(nth, F.row_number().over(only)).where(F.col(nth) == 1).drop(code, nth)
