"""Product codes of vectors: the nearest entry of each part's codebook, found by vantage-point trees.

Components become integers floor(SCALE * x), vectors are cut into equal parts, and each part position has a codebook of
at most ENTRIES entries. Of each codebook a vantage-point tree is built: a node holds an entry and splits the others into
those within the median distance and those beyond it, each side with its least and greatest distance from the entry. A
search goes down with a batch of parts: a side is left out only where the triangle inequality, with radii rounded outward,
shows that all of it is farther than the best so far; a side that could only tie is visited. Distances that decide are
integers, compared as (distance, index).

The codebooks (parts * ENTRIES entries, whatever the table's size) are what the driver holds. A round is one pass: every
task adds up its own parts by entry, and only these sums are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh, quoted, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries of a leaf, which are compared one by one.
LEAF = 6
#: Up to so many distinct labels their sums are broadcast (some 40 bytes each); beyond, rows are spread over SALTS.
LABELS_AT_ONCE = 100_000
SALTS = 32
#: Far above the rounding of a square root and of the conversion of a 62-bit integer.
OUTWARD = 1e-12
#: Of no codebooks at all.
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


class Node:
    """A vantage entry and its two sides, or a leaf."""

    def __init__(self, entries: np.ndarray, own: np.ndarray):
        self.own, self.sides = own, ()
        if len(own) <= LEAF:
            return
        centre = entries[own].astype(np.float64).mean(axis=0)
        self.vantage = int(own[np.argmax(((entries[own] - centre) ** 2).sum(axis=1))])  # far from the middle, so that distances spread
        rest = own[own != self.vantage]
        far = np.sqrt(squares(entries[rest], entries[self.vantage]).astype(np.float64))
        by = np.argsort(far, kind="stable")
        half = len(by) // 2
        self.middle = far[by[half]]
        self.sides = tuple((Node(entries, np.sort(rest[side])), far[side].min() * (1 - OUTWARD), far[side].max() * (1 + OUTWARD)) for side in (by[:half], by[half:]))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def improve(parts: np.ndarray, entries: np.ndarray, own: np.ndarray, which: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
    """Takes the entries `own` into account for the parts `which`; among equal distances the lower index wins."""
    d = squares(parts[which][:, None, :], entries[own][None, :, :])
    at = d.argmin(axis=1)  # own is ascending: the first is the lowest
    d, i = d[np.arange(len(which)), at], own[at]
    better = (d < best[which]) | ((d == best[which]) & (i < index[which]))
    best[which[better]], index[which[better]] = d[better], i[better]


def search(node: Node, parts: np.ndarray, entries: np.ndarray, which: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
    """Branch and bound below a node for the parts `which`: the likelier side first, the other where it could still win or tie."""
    if not node.sides:
        improve(parts, entries, node.own, which, best, index)
        return
    improve(parts, entries, np.array([node.vantage]), which, best, index)
    d = np.sqrt(squares(parts[which], entries[node.vantage]).astype(np.float64))
    near = d < node.middle
    for first, some in ((0, near), (1, ~near)):
        for side in (first, 1 - first):
            child, low, high = node.sides[side]
            own, at = which[some], d[some]
            reach = np.sqrt(best[own].astype(np.float64)) * (1 + OUTWARD)
            open_ = (at * (1 - OUTWARD) - high <= reach) & (low - at * (1 + OUTWARD) <= reach)
            if open_.any():
                search(child, parts, entries, own[open_], best, index)


class Codebooks:
    """entries: (parts, entries, width) integers. assign gives the nearest entry of every part of every vector."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees: list[Node] | None = None

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance), each (vectors, parts)."""
        n, p, w = len(vectors), *self.entries.shape[::2]
        self.trees = self.trees or [Node(e, np.arange(len(e))) for e in self.entries]
        cut = vectors.reshape(n, p, w)
        best, index = np.full((p, n), np.iinfo(np.int64).max), np.full((p, n), np.iinfo(np.int64).max)
        for k, tree in enumerate(self.trees):
            search(tree, np.ascontiguousarray(cut[:, k]), self.entries[k], np.arange(n), best[k], index[k])
        return index.T, best.T

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limit_of(size: int) -> int:
    """Components are held within this, so that a vector's squared distances always add up within 63 bits."""
    return math.isqrt((1 << 62) // size) // 2


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integer vectors): without null vectors, null components and components that are not finite."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    ends = np.cumsum(lengths)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    kept = np.flatnonzero((bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False))
    out = np.zeros((len(kept), size), np.int64)
    rows = np.repeat(np.arange(len(kept)), lengths[kept])
    place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths[kept]) - lengths[kept], lengths[kept])
    edge = float(limit_of(size))
    with np.errstate(over="ignore"):
        out[rows, place] = np.clip(np.floor(values[np.repeat(ends[kept] - lengths[kept], lengths[kept]) + place] * SCALE), -edge, edge).astype(np.int64)
    return kept, out


def batches_of(batch: pa.RecordBatch, most: int = 16_384) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, most):
        yield batch.slice(k, most)


def smallest(rows: DataFrame, entries: int, size: int) -> np.ndarray:
    """Integer vectors of the smallest ids of kept rows; every task sends its own smallest ones only."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, list[int]] = {}
        for whole in batches:
            for batch in batches_of(whole):
                kept, vectors = integers(batch.column(1), size)
                for i, v in zip(batch.column(0).take(pa.array(kept)).to_pylist(), vectors.tolist()):
                    if i not in held or v < held[i]:
                        held[i] = v
                for i in sorted(held, key=lambda i: (i is None, i or 0))[entries:]:
                    del held[i]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["id", "vector"])

    few = rows.mapInArrow(own, "id long, vector array<long>").groupBy("id").agg(F.min("vector").alias("vector"))
    got = few.orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    return np.array([r.vector for r in got], np.int64).reshape(len(got), size)


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: the floor of the mean of an entry's parts takes its place; unused entries stay."""
    p, k, w = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p * k, w + 1), np.int64)
        for whole in batches:
            for batch in batches_of(whole):
                _, vectors = integers(batch.column(1), p * w)
                index, _ = books.assign(vectors)
                slot, cut = (index + np.arange(p) * k).ravel(), vectors.reshape(-1, w)
                for j in range(w):  # a batch's sums are far below 2^53, so doubles hold them exactly
                    total[:, j] += np.bincount(slot, cut[:, j], p * k).astype(np.int64)
                total[:, w] += np.bincount(slot, minlength=p * k)
        used = np.flatnonzero(total[:, w])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, w + 1) * (w + 1) + np.tile(np.arange(w + 1), len(used))), pa.array(total[used].ravel())], names=["place", "total"])

    got = rows.mapInArrow(sums, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # parts * entries * (width + 1) rows at most
    total = np.zeros((p * k, w + 1), object)
    for r in got:
        total[r.place // (w + 1), r.place % (w + 1)] = int(r.total)
    new = books.entries.reshape(p * k, w).copy()
    for i in np.flatnonzero(total[:, w]):
        new[i] = [s // total[i, w] for s in total[i, :w]]
    return Codebooks(new.reshape(p, k, w))


def trained(rows: DataFrame, size: int, parts: int, entries: int, rounds: int) -> Codebooks | None:
    start = smallest(rows, entries, size)
    if not len(start):
        return None
    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """One row for each kept row: id, label, code, error, label_error; and the codebooks (None without any kept row).

    Rows whose vector is null or holds a null, NaN or infinite component are dropped. Rows with one id are all coded; for
    the start of the codebooks they count once, by the least vector, and a null id counts as one id after all others.
    Vectors shorter than the longest, or of a length that the parts do not divide, are filled up with zeros, which add no
    distance; empty vectors are all zeros. Components are held within `limit_of` (2^19 for 64 of them). Fewer kept ids
    than entries give smaller codebooks. Equal distances take the lower index. Null labels are one label. Errors of a
    label are added as decimals; beyond 63 bits label_error is null. Other columns play no part; an empty table gives none.
    """
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("vector"), quoted(label_col).alias("label"))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(1, -(-longest // parts)) * parts
    narrow = rows.select("id", "vector")
    books = trained(narrow, size, parts, entries, rounds)
    digits = max(2, len(f"{entries - 1:x}"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"{i:0{digits}x}" for i in range(entries)]
        for whole in batches:
            for batch in batches_of(whole):
                kept, own = integers(batch.column(1), size)
                if not len(kept):
                    continue
                index, square = books.assign(own)
                told, at = ["".join(names[i] for i in row) for row in index.tolist()], pa.array(kept)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(told, pa.string()), pa.array(square.sum(axis=1))], names=["id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    schema = f"id long, label {kind}, code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"{schema}, label_error long"), None
    return with_label_errors(written(rows.mapInArrow(code, schema), "codes")), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the errors of each row's label. No row is shuffled by its label alone: sums are broadcast, or rows and sums carry a salt."""
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).withColumn("label_error", F.expr("try_cast(total as bigint)"))
    sums = sums.select(F.col("label").alias("of"), "label_error")
    sums = written(sums, "label_errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.limit(LABELS_AT_ONCE + 1).count() <= LABELS_AT_ONCE:
        return coded.join(F.broadcast(sums), same).drop("of")
    salt = fresh("salt", coded)
    spread = sums.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return coded.withColumn(salt, F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")).join(spread, same & (F.col(salt) == F.col("s"))).drop("of", "s", salt)
