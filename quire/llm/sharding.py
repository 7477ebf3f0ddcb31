"""Sharding by minimax contiguous partition.

Rows of equal text are an atomic group. Groups stand in the order of their content key (SHA-256 of the text), which is the
same on every run. The smallest capacity for which the ordered groups fit into the shards is found by binary search, each
capacity being checked by a greedy sweep; the cuts then lie within that capacity, each as near to an even split as the
remaining groups allow, and a row's shard follows from comparing its key with the cut keys - no join, no shuffle.

The driver never sees the groups: it holds sums of the key's first 16 bits (65,536 rows at most). Sweeps over these sums
bound the capacity and the places of all cuts from both sides; only the buckets between the bounds are fetched, all at
once, and the search is finished on their groups. The groups are written in the order of their key, so that a fetch reads
the files of its buckets only. Where the bounds leave more than MOST_GROUPS groups, buckets are fetched one by one instead.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import fresh, quoted, written

#: Hex digits of the key that name a bucket.
DIGITS = 4
#: Rows in one numbering group, about.
SLOT_ROWS = 50_000
#: Groups fetched at once at most; buckets held besides.
MOST_GROUPS, MOST_HELD = 200_000, 64


class Ordered:
    """Prefix sums over the ordered groups, by bucket on the driver and by group on demand."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        rows = groups.groupBy("bucket").agg(F.sum("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("n")).collect()
        rows.sort(key=lambda r: r.bucket)
        self.names = [r.bucket for r in rows]
        self.counts = np.array([r.n for r in rows], np.int64)
        self.after = np.cumsum([r.size for r in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
        self.total = int(self.after[-1]) if rows else 0
        self.most = max((r.most for r in rows), default=0)
        self.held: dict[int, tuple[np.ndarray, list[str]]] = {}
        self.single: list[int] = []

    def fetch(self, ks: list[int]) -> None:
        """Holds the buckets with these numbers, one job for all."""
        ks = [k for k in ks if k not in self.held]
        if not ks:
            return
        names = [self.names[k] for k in ks]
        inside = (F.col("bucket") >= min(names)) & (F.col("bucket") <= max(names)) & F.col("bucket").isin(names)
        rows = sorted(self.groups.where(inside).select("bucket", "key", "size").collect())
        for k, own in zip(ks, (list(g) for _, g in groupby(rows, lambda r: r.bucket))):
            base = int(self.after[k - 1]) if k else 0
            self.held[k] = (base + np.cumsum([r.size for r in own], dtype=np.int64), [r.key for r in own])

    def detail(self, k: int) -> tuple[np.ndarray, list[str]]:
        """Prefix sums after each group of bucket k, and the groups' keys."""
        if k not in self.held:
            self.fetch([k])
            self.single.append(k)
            if len(self.single) > MOST_HELD:
                self.held.pop(self.single.pop(0))
        return self.held[k]

    def foresee(self, spans: list[tuple[int, int]]) -> None:
        """Fetches the buckets in which places from low to high lie, unless they have too many groups."""
        ks = sorted({k for low, high in spans if self.total for k in range(*self.between(low, high))})
        if self.counts[ks].sum() <= MOST_GROUPS:
            self.fetch(ks)

    def between(self, low: int, high: int) -> tuple[int, int]:
        last = len(self.after) - 1
        return min(int(np.searchsorted(self.after, max(low, 0), "left")), last), min(int(np.searchsorted(self.after, min(high, self.total), "right")), last) + 1

    def bucket_floor(self, x: int) -> int:
        """The largest bucket boundary at or below x."""
        k = int(np.searchsorted(self.after, x, "right"))
        return int(self.after[k - 1]) if k else 0

    def bucket_ceil(self, x: int) -> int:
        """The smallest bucket boundary at or above x."""
        if x <= 0:
            return 0
        k = int(np.searchsorted(self.after, x, "left"))
        return int(self.after[min(k, len(self.after) - 1)])

    def floor(self, x: int) -> int:
        """The largest group boundary at or below x."""
        if x <= 0 or not self.total:
            return 0
        if x >= self.total:
            return self.total
        k = int(np.searchsorted(self.after, x, "right"))
        sums, _ = self.detail(k)
        i = bisect_right(sums, x)
        return int(sums[i - 1]) if i else int(self.after[k - 1]) if k else 0

    def ceil(self, x: int) -> int:
        """The smallest group boundary at or above x."""
        if x <= 0 or not self.total:
            return 0
        if x >= self.total:
            return self.total
        k = int(np.searchsorted(self.after, x, "left"))
        sums, _ = self.detail(k)
        return int(sums[bisect_left(sums, x)])

    def key_at(self, boundary: int) -> str | None:
        """Key of the last group before the boundary; None at the start."""
        if boundary <= 0:
            return None
        k = int(np.searchsorted(self.after, boundary, "left"))
        sums, keys = self.detail(k)
        return keys[bisect_left(sums, boundary)]


def swept(floor, total: int, capacity: int, shards: int) -> list[int]:
    """Ends of the shards when each takes what `floor` lets it take."""
    out, at = [], 0
    for _ in range(shards):
        at = min(floor(at + capacity), total)
        out.append(at)
    return out


def fits(order: Ordered, capacity: int, shards: int) -> bool:
    return swept(order.floor, order.total, capacity, shards)[-1] >= order.total


def least(low: int, high: int, good) -> int:
    """The smallest number from low to high that is good; high counts as good."""
    while low < high:
        mid = (low + high) // 2
        if good(mid):
            high = mid
        else:
            low = mid + 1
    return low


def least_capacity(order: Ordered, shards: int) -> int:
    """The smallest capacity by which the ordered groups fit into the shards.

    Sweeps that end each shard at a bucket's start or end bound it from above and below without a fetch.
    """
    low = max(order.most, -(-order.total // shards))
    high = low + order.most
    high = least(low, high, lambda c: swept(order.bucket_floor, order.total, c, shards)[-1] >= order.total)
    low = least(low, high, lambda c: swept(order.bucket_ceil, order.total, c, shards)[-1] >= order.total)
    order.foresee(list(zip(swept(order.bucket_floor, order.total, low, shards), swept(order.bucket_ceil, order.total, high, shards))))
    return least(low, high, lambda c: fits(order, c, shards))


def cuts(order: Ordered, shards: int) -> tuple[int, list[int]]:
    """Least capacity and the boundaries before shards 1 to shards-1."""
    capacity = least_capacity(order, shards)
    back_low, back_high, spans = order.total, order.total, []
    for k in range(shards - 2, -1, -1):
        back_low, back_high = order.bucket_floor(max(0, back_low - capacity)), order.bucket_ceil(back_high - capacity)
        even = order.total * (k + 1) // shards
        spans += [(back_low, back_high), (order.bucket_floor(even) - 1, order.bucket_ceil(even) + 1)]
    order.foresee(spans)
    earliest = [order.total] * shards
    for k in range(shards - 2, -1, -1):  # from the right: how early cut k may come
        earliest[k] = order.ceil(earliest[k + 1] - capacity)
    out, at = [], 0
    for k in range(shards - 1):
        ideal = at + (order.total - at) // (shards - k)
        low, high = max(earliest[k], at), order.floor(at + capacity)
        near = min((order.floor(ideal), order.ceil(ideal)), key=lambda b: abs(b - ideal))
        at = min(max(near, low), high)
        out.append(at)
    return capacity, out


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _size, _key and _crc; null texts count as empty texts and join their group."""
    text = quoted(text_col)
    return docs.withColumns({
        fresh("_size", docs): F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        fresh("_key", docs): F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256),
        fresh("_crc", docs): F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
    })


def shard_of(key: Column, boundaries: list[str | None]) -> Column:
    """Number of cuts at or below the key: cut k lies behind the group whose key is boundaries[k]."""
    out = F.lit(0)
    for last in boundaries:
        out = out + (F.lit(1) if last is None else (key > F.lit(last)).cast("int"))
    return out.cast("int")


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, texts: bool = True) -> DataFrame:
    """docs with size, crc, shard and slot in columns named by `fresh` from _size, _crc, _shard, _slot; without `texts`, the id and these only.

    size is the UTF-8 bytes of the text plus one; a null text counts as an empty one. Rows of equal text share a shard.
    Slots count from 0 without gaps in each shard; repeated rows get slots of their own, in any order among themselves. An
    empty table gives an empty table. A group larger than an even share, as a very long text or many copies of one can be,
    raises the capacity to its size.
    """
    base = measured(docs, text_col)
    size, key, crc = base.columns[-3:]
    held = base.select(quoted(id_col), size, key, crc)  # the texts are hashed once for groups and slots
    copies = fresh("_copies", base)
    if not texts:  # rows alike are one row with their number from here on
        held = held.groupBy(*(quoted(c) for c in held.columns)).agg(F.count("*").alias(copies))
    held = written(held, "keys")
    each = F.lit(1) if texts else F.col(copies)
    own = held.groupBy(F.col(key).alias("key")).agg(F.sum(F.col(size) * each).alias("size")).withColumn("bucket", F.substring("key", 1, DIGITS))
    groups = written(own.repartitionByRange("key").sortWithinPartitions("key"), "groups")
    order = Ordered(groups)
    _, at = cuts(order, shards)
    boundaries = [order.key_at(b) for b in at]
    shard_col, slot_col = fresh("_shard", base), fresh("_slot", base)
    if not texts:
        rows = held.withColumn(shard_col, shard_of(F.col(key), boundaries))
        return numbered_copies(rows, copies, shard_col, slot_col, [quoted(id_col), F.col(key)]).drop(key)
    placed = base.withColumn(shard_col, shard_of(F.col(key), boundaries))
    narrow = held.withColumn(shard_col, shard_of(F.col(key), boundaries))
    return numbered(placed, narrow, shard_col, slot_col, [quoted(id_col), F.col(key)]).drop(key)


def numbered(placed: DataFrame, narrow: DataFrame, shard_col: str, slot_col: str, ids: list[Column]) -> DataFrame:
    """Adds slots by a hash of the row: each numbering group is counted, starts behind those before it, and numbers its own.

    `narrow` has the columns of `placed` that the numbers depend on.
    """
    part, start, s, p = fresh("_part", placed), fresh("_start", placed), fresh("_s", placed), fresh("_p", placed)
    parts = 1 + narrow.count() // SLOT_ROWS
    home = F.pmod(F.xxhash64(*ids), F.lit(parts)).cast("int")
    counts = narrow.groupBy(F.col(shard_col).alias(s), home.alias(p)).count()
    before = counts.withColumn(start, F.sum("count").over(W.partitionBy(s).orderBy(p).rowsBetween(W.unboundedPreceding, -1)))
    own = W.partitionBy(shard_col, part).orderBy(*ids)
    numbers = placed.withColumn(part, home).withColumn(slot_col, F.row_number().over(own).cast("long") - 1)
    return (
        numbers.join(before.select(s, p, start), (F.col(shard_col) == F.col(s)) & (F.col(part) == F.col(p)))
        .withColumn(slot_col, F.col(slot_col) + F.coalesce(F.col(start), F.lit(0)))
        .drop(s, p, part, start)
    )


def numbered_copies(rows: DataFrame, copies_col: str, shard_col: str, slot_col: str, ids: list[Column]) -> DataFrame:
    """A row for each copy of each of the distinct rows, with slots as `numbered` gives them.

    Parts hold distinct rows, whose copies are only counted; they are spelled out at the end in runs of SLOT_ROWS, which
    are dealt anew where one row has more, so that no task has more than some runs of one row.
    """
    part, start, s, p, run = (fresh(n, rows) for n in ("_part", "_start", "_s", "_p", "_run"))
    n = F.col(copies_col)
    told = rows.agg(F.count("*").alias("rows"), F.max(n).alias("most")).first()
    home = F.pmod(F.xxhash64(*ids), F.lit(1 + told.rows // SLOT_ROWS)).cast("int")
    counts = rows.groupBy(F.col(shard_col).alias(s), home.alias(p)).agg(F.sum(n).alias("count"))
    before = counts.withColumn(start, F.coalesce(F.sum("count").over(W.partitionBy(s).orderBy(p).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = W.partitionBy(shard_col, part).orderBy(*ids).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn(part, home).withColumn(slot_col, F.coalesce(F.sum(n).over(own), F.lit(0)))
    placed = placed.join(before.select(s, p, start), (F.col(shard_col) == F.col(s)) & (F.col(part) == F.col(p)))
    placed = placed.withColumn(slot_col, F.col(slot_col) + F.col(start)).drop(s, p, part, start)
    runs = placed.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / SLOT_ROWS))))
    if (told.most or 0) > SLOT_ROWS:
        runs = runs.repartition(*ids, F.col(run))
    first = F.col(run) * SLOT_ROWS
    each = F.explode(F.sequence(F.col(slot_col) + first, F.col(slot_col) + F.least(n, first + SLOT_ROWS) - 1))
    return runs.withColumn(slot_col, each).drop(run, copies_col)
