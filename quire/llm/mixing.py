"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: every source gets its weight's part of `share` times all words, stopped at `most` times its own size, the excess
dealt again by weight among the others. The mix is made of blocks of `block` words. The blocks are allocated to sources
by the highest quotients target / (2 k + 1), shard by shard: the quota of shards 0 to k together is the apportionment of
their blocks together (divisor methods never take a seat back when the house grows), so a shard's quota is a difference
of two apportionments and all of them add up to that of the whole mix.

Selection: the blocks of a source stand in a seeded order, by the hash of their document and in the document's own order,
so a document is cut only where a border falls into it. The shards take their quotas one after another along that order,
again from its start when a pass over the source is over. Only sums by (source, hash bin) are shuffled; the end of each
shard in each source is then one hash and a number of words, and every row decides alone what it gives to which shard.
"""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import fresh, quoted, written

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
BLOCK = 64
#: The sources' table is held by the driver and broadcast (about 300 bytes a source); more sources than this are refused.
MOST_SOURCES = 200_000
#: About so many rows share a hash bin; there are 2 ** MOST_BITS bins of a source at most.
BIN_ROWS, MOST_BITS = 256, 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[Fraction]:
    """Targets in the sources' order; they add up to share times all sizes while most allows it."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        want = {i: left * weights[i] / whole for i in open_}
        over = {i for i in open_ if want[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(most * sizes[i]) if over else want[i]
        left -= sum((out[i] for i in over), Fraction(0))
        open_ -= over or open_
    return out


def sainte_lague(votes: list[Fraction], seats: int) -> list[int]:
    """Seats by highest quotients v / (2 k + 1); the earlier source wins a tie. Takes time by sources, not by seats."""
    n, total = len(votes), sum(votes)
    out = [0] * n
    if not total or seats <= 0:
        return out
    if 2 * seats > n:  # seats that are certain: a divisor at which not more than all are given
        divisor = Fraction(2 * total, 2 * seats - n)
        out = [max(0, -int(-(v / divisor - Fraction(1, 2)) // 1)) if v else 0 for v in votes]
        out = [max(0, k - 1) for k in out]
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, out)) if v]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def shard_quotas(votes: list[Fraction], blocks: int, shards: int) -> list[list[int]]:
    """Blocks of each source in each shard; column sums are the apportionment of all blocks."""
    upto = [sainte_lague(votes, blocks * (k + 1) // shards) for k in range(shards)]
    return [[a - b for a, b in zip(now, was)] for now, was in zip(upto, [[0] * len(votes), *upto])]


@dataclass
class Plan:
    """What rows need to know of their source. sources: source, source_size, target, blocks, borders; quotas: shard, source, blocks.

    borders has the end of each shard: the passes that are over, the hash of the document in which it lies (-1: at the start
    of a pass), and the words of that document before it.
    """

    sources: DataFrame
    quotas: DataFrame
    seed: int


BORDERS = "array<struct<pass:long,h:long,part:long>>"
KIND = f"source string, source_size long, target double, blocks long, borders {BORDERS}"


def seeded(seed: int, key: Column) -> Column:
    """A document's hash, cut to 62 bits so that bins are its leading digits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 2)


def plan_mix(narrow: DataFrame, *, seed: int = 9, block: int = BLOCK, share: Fraction = Fraction(3, 2), most: int = 2, weights=WEIGHTS, shards: int = 8) -> Plan:
    """Plans a mix of rows (key long, source string, size long); the table is read three times, so it should be a written one."""
    spark = narrow.sparkSession
    rows = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in rows]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, most)
    quotas = shard_quotas(want, round(sum(want) / block), shards)
    ends = {}
    for i, r in enumerate(rows):
        upto = itertools.accumulate(q[i] for q in quotas)
        ends[r.source] = [divmod(min(k * block, most * r["size"]), r["size"]) if r["size"] else (0, 0) for k in upto]
    bits = min(MOST_BITS, max(2, (sum(r.n for r in rows) // BIN_ROWS).bit_length()))
    inside = [(source, k, rest) for source, own in ends.items() for k, (_, rest) in enumerate(own) if rest]
    found = {(r.name, r.k): (r.h, r.part) for r in find_borders(narrow, inside, seed, bits)}
    known = []
    for i, (r, t) in enumerate(zip(rows, want)):
        borders = [(passes, *(found[r.source, k] if rest else (-1, 0))) for k, (passes, rest) in enumerate(ends[r.source])]
        known.append((r.source, r["size"], float(t), sum(q[i] for q in quotas), borders))
    table = [(k, r.source, q[i]) for k, q in enumerate(quotas) for i, r in enumerate(rows)]
    return Plan(spark.createDataFrame(known, KIND), spark.createDataFrame(table, "shard int, source string, blocks long"), seed)


def find_borders(narrow: DataFrame, ends: list[tuple], seed: int, bits: int) -> list:
    """(name, k, h, part) for the k-th end of a source, `rest` words after the start of a pass.

    Rows of one hash (repeated rows) are cut alike: each gives the same whole number of words, so that what does not divide
    among them, less than a word a row, is left out.
    """
    spark = narrow.sparkSession
    if not ends:
        return []
    wanted = F.broadcast(spark.createDataFrame(ends, "name string, k int, rest long"))  # at most MOST_SOURCES * shards rows
    each = narrow.where("size > 0").select("source", "size", seeded(seed, F.col("key")).alias("h"))
    each = each.withColumn("bin", F.shiftright("h", 62 - bits))
    sums = each.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # 2 ** bits bins of a source at most
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    at = sums.join(wanted, sums.source.eqNullSafe(wanted.name)).where("before < rest and before + words >= rest")
    at = at.select("name", "k", F.col("bin").alias("edge"), (F.col("rest") - F.col("before")).alias("need")).collect()
    held = spark.createDataFrame([tuple(r) for r in at], "name string, k int, edge long, need long")
    bins = F.broadcast(held.select("name", "edge").distinct())
    near = each.join(bins, each.source.eqNullSafe(bins.name) & (F.col("bin") == F.col("edge"))).groupBy("name", "edge", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    run = W.partitionBy("name", "edge").orderBy("h").rowsBetween(W.unboundedPreceding, -1)  # one bin
    near = near.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    e = F.broadcast(held)
    cut = near.join(e, near.name.eqNullSafe(e.name) & (near.edge == e.edge)).where("before < need and before + words >= need")
    return cut.select(near.name.alias("name"), "k", "h", F.floor((F.col("need") - F.col("before")) / F.col("n")).alias("part")).collect()


def with_plan(rows: DataFrame, plan: Plan, *, key: str, source: str, size: str, to: str) -> DataFrame:
    """rows and a struct column: source_size, target, upto (words of the row's passes given when each shard ends), taken."""
    s = F.broadcast(plan.sources.select(F.struct("*").alias(own := fresh("_plan", rows))))  # at most MOST_SOURCES rows
    out = rows.join(s, quoted(source).eqNullSafe(F.col(own)["source"]), "left")
    h = fresh("_h", out)
    out = out.withColumn(h, seeded(plan.seed, F.col(key)))
    p, n = F.col(own), F.col(size)

    def given(b: Column) -> Column:
        inside = F.when(F.col(h) < b["h"], n).when(F.col(h) == b["h"], F.least(n, b["part"])).otherwise(F.lit(0).cast("long"))
        return b["pass"] * n + inside

    upto = F.transform(p["borders"], given)
    taken = F.coalesce(F.element_at(upto, -1), F.lit(0).cast("long"))
    return out.withColumn(to, F.struct(p["source_size"].alias("source_size"), p["target"].alias("target"), upto.alias("upto"), taken.alias("taken"))).drop(own, h)


def shard_words(mix: Column) -> Column:
    """Words that each shard takes of a row."""
    return F.transform(mix["upto"], lambda x, k: x - F.when(k > 0, F.get(mix["upto"], k - 1)).otherwise(0))


def measured(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, key, source, size) of every row, written: the text is read once for the whole plan."""
    rows = docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("key"), quoted(source_col).cast("string").alias("source"), n_words(quoted(text_col)).alias("size"))
    return written(rows, "sizes")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 9, block: int = BLOCK) -> tuple[DataFrame, Plan]:
    """(id, source, size, mix) for every row, and the plan with the quotas of shards.

    A null text has size 0 and gives nothing; null sources are one source, last in order. Repeated rows hash alike and
    give alike; what does not divide among those in which a border falls, less than a word a row, is left out. An empty
    table gives an empty mix. Sources of size 0 have target 0. A text of any length is counted whole and is cut only at a
    border. Only the three named columns are read, so others may have any names.
    """
    narrow = measured(docs, id_col=id_col, source_col=source_col, text_col=text_col)
    plan = plan_mix(narrow, seed=seed, block=block)
    return with_plan(narrow, plan, key="key", source="source", size="size", to="mix"), plan


def mixed_texts(docs: DataFrame, plan: Plan, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shard_to: str | None = None) -> DataFrame:
    """The rows of the mix: a row for each piece of a document that a pass (and, with `shard_to`, a shard) takes.

    A whole document keeps its text; of a part the words are joined by a space. shard_to names a column for the shard.
    """
    key, size, to, piece = (fresh(x, docs) for x in ("_key", "_size", "_mix", "_piece"))
    rows = docs.withColumns({key: F.xxhash64(quoted(id_col), quoted(text_col)), size: n_words(quoted(text_col))})
    rows = with_plan(rows, plan, key=key, source=source_col, size=size, to=to)
    n, m = F.col(size), F.col(to)
    whole = F.array(F.struct(F.lit(None).cast("int").alias("shard"), F.lit(0).cast("long").alias("low"), m["taken"].alias("high")))
    own = F.transform(m["upto"], lambda x, k: F.struct(k.alias("shard"), F.when(k > 0, F.get(m["upto"], k - 1)).otherwise(F.lit(0).cast("long")).alias("low"), x.alias("high")))

    def passes(r: Column) -> Column:
        def one(q: Column) -> Column:
            return F.struct(r["shard"].alias("shard"), (F.greatest(r["low"], q * n) - q * n).alias("low"), (F.least(r["high"], (q + 1) * n) - q * n).alias("high"))

        return F.transform(F.sequence(F.floor(r["low"] / n), F.floor((r["high"] - 1) / n)), one)

    ranges = F.filter(own if shard_to else whole, lambda r: r["high"] > r["low"])
    out = rows.withColumn(piece, F.explode(F.flatten(F.transform(ranges, passes))))
    words = F.filter(F.split(quoted(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    low, high = F.col(piece)["low"], F.col(piece)["high"]
    part = F.array_join(F.slice(words, (low + 1).cast("int"), (high - low).cast("int")), " ")
    out = out.withColumn(text_col, F.when((low == 0) & (high == n), quoted(text_col)).otherwise(part))
    return out.select(*(quoted(c) for c in docs.columns), *([F.col(piece)["shard"].alias(shard_to)] if shard_to else []))
