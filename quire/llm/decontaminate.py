"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text is put into a canonical form, " w1 w2 ... wn " in UTF-8, so that a window of item words occurs among the words
of a document exactly if its canonical bytes occur in the document's. Patterns are grouped into length classes. Each
class has the tables of Wu and Manber: SHIFT, indexed by a hash of the block that ends the current position, says how
far the search can jump; where it is zero, the bucket of that suffix block names the test strings, a prefix comparison
thins them out and a direct comparison of all bytes confirms each occurrence. Many cursors, one for each segment of the
buffer, run through the same tables at once as numpy vectors.

Only the pattern tables are broadcast. Items are dealt into blocks of at most ITEM_BYTES of text; one block is the usual
case and costs one map over the documents without a shuffle; a larger benchmark takes one map a block, merged in the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_arrow, fresh, quoted, written

WINDOW = 13
ITEM_BYTES = 4 << 20
#: Blocks searched in one pass over the documents.
CHAIN = 8
SEGMENT = 4096
#: Lower bounds of the length classes, in bytes of a canonical pattern.
CLASSES = (3, 8, 16, 40)
MIX = np.uint64(0x9E3779B97F4A7C15)
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

KIND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def words_of(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def windows(words: list[bytes], n: int = WINDOW) -> set[bytes]:
    """Canonical bytes of every window of n consecutive words; the whole item if it has fewer, none if it is empty."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))}


class Patterns:
    """SHIFT and suffix-hash tables of one length class."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.b = b = 3 if m < 8 else 8
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.bits = bits = int(np.clip(np.ceil(np.log2(max(1, len(patterns) * (m - b + 1)))) + 2, 12, 21))
        self.shift = np.full(1 << bits, m - b + 1, np.int64)
        padded = np.concatenate([np.zeros((len(patterns), 8), np.uint8), heads], axis=1)
        for end in range(b - 1, m):
            block = np.ascontiguousarray(padded[:, end + 1 : end + 9]).view("<u8").ravel()
            np.minimum.at(self.shift, self.hashed(block), m - 1 - end)
        self.order = np.argsort(suffix := self.hashed(block), kind="stable")
        self.suffix = suffix[self.order]
        self.prefix = np.ascontiguousarray(np.pad(heads, ((0, 0), (0, max(0, 8 - m))))[:, :8]).view("<u8").ravel()

    def hashed(self, eight: np.ndarray) -> np.ndarray:
        block = eight >> np.uint64(64 - 8 * self.b)
        return ((block * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def occurrences(self, data: bytes) -> Iterable[tuple[int, int]]:
        """(offset, pattern number) of every occurrence in data, which begins with eight pad bytes and ends with eight."""
        n = len(data) - 8
        eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        first = np.arange(8, n, SEGMENT)
        last = np.minimum(first + SEGMENT, n) + self.m - 1
        at = first + self.m - 1
        last = np.minimum(last, n)
        live = at < last
        at, last = at[live], last[live]
        while at.size:
            h = self.hashed(eights[at - 7])
            step = self.shift[h]
            if not step.all():
                zero = step == 0
                yield from self.confirmed(data, eights, at[zero] - self.m + 1, h[zero])
            at = at + np.maximum(step, 1)
            live = at < last
            if not live.all():
                at, last = at[live], last[live]

    def confirmed(self, data: bytes, eights: np.ndarray, start: np.ndarray, h: np.ndarray) -> Iterable[tuple[int, int]]:
        low, high = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        k = high - low
        which = np.repeat(low, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        start, which = np.repeat(start, k), self.order[which]
        cover = np.uint64((1 << 8 * min(8, self.m)) - 1)
        same = (eights[start] & cover) == self.prefix[which]
        for s, p in zip(start[same].tolist(), which[same].tolist()):
            if data.startswith(self.patterns[p], s):
                yield s, p


def compiled(items: list[tuple[str | None, str | None]], n: int = WINDOW) -> list[tuple[Patterns, list[tuple[int, list[str]]]]]:
    """Tables for (item id, text) rows: of each length class its Patterns, and of each pattern its words and items."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(words_of(text), n):
            owners.setdefault(w, set()).update([] if item is None else [item])
    out = []
    for k, low in enumerate(CLASSES):
        high = CLASSES[k + 1] if k + 1 < len(CLASSES) else float("inf")
        if own := sorted(p for p in owners if low <= len(p) < high):
            out.append((Patterns(own), [(p.count(b" ") - 1, sorted(owners[p])) for p in own]))
    return out


def search(tables: list, texts: list[str | None]) -> list[dict]:
    """For each text its words, the words hit, the items that occur and the hit spans of words."""
    found: list[dict] = []
    parts, offsets, at = [bytes(8)], [], 8
    for text in texts:
        words = words_of(text)
        body = b" " + b" ".join(words) + b" \n" if words else b"\n"
        found.append({"n_words": len(words), "n_hit": 0, "item_ids": [], "spans": []})
        offsets.append(at)
        parts.append(body)
        at += len(body)
    data = b"".join([*parts, bytes(8)])
    starts = np.array(offsets, np.int64)
    hits: dict[int, tuple[list, list, set]] = {}
    for patterns, about in tables:
        if got := list(patterns.occurrences(data)):
            docs = np.searchsorted(starts, np.array([s for s, _ in got]), "right") - 1
            for doc, (s, p) in zip(docs.tolist(), got):
                where, length, names = hits.setdefault(doc, ([], [], set()))
                where.append(s)
                length.append(about[p][0])
                names.update(about[p][1])
    for doc, (where, length, names) in hits.items():
        size = len(parts[doc + 1])
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8, size, offsets[doc]) == 32)
        begin = np.searchsorted(spaces, np.array(where) - offsets[doc])
        edge = np.zeros(found[doc]["n_words"] + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + np.array(length), -1)
        mark = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        turn = np.flatnonzero(np.diff(mark))
        found[doc] |= {"n_hit": int(mark.sum()), "item_ids": sorted(names), "spans": [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]}
    return found


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, item_bytes: int) -> Iterable[list]:
    """The items in blocks of at most item_bytes of text (or one item): each is fetched only when the one before is done with."""
    rows = benchmark.select(quoted(id_col).cast("string").alias("item"), quoted(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * total // item_bytes if total > item_bytes else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        if block := [(r.item, r.text) for r in part.collect()]:
            yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned too): n_words, n_hit, item_ids (strings, sorted), spans of hit words.

    Every row keeps its own answer, so repeated rows and doc_ids are judged alike. A null or empty text has no words and
    is hit by nothing; null items are ignored; an item with a null id marks words but has no id to list; an empty
    benchmark hits nothing. Of equal texts under several ids all ids are listed. Extra columns pass through, whatever their
    names; an empty table stays empty; texts of any length are searched whole. A benchmark of several blocks is searched
    in runs of CHAIN blocks, each run one pass whose result is written.
    """
    spark = docs.sparkSession
    name = fresh("decontamination", docs)
    out: DataFrame | None = None
    for k, block in enumerate(item_blocks(benchmark, item_col, item_text_col, item_bytes)):
        if k and k % CHAIN == 0:
            out = written(out, "searched")
        tables = spark.sparkContext.broadcast(compiled(block, window))

        def make(tables=tables):
            built = tables.value
            return lambda texts: pa.array(search(built, texts.to_pylist()))

        if out is None:
            out = append_arrow(docs, [text_col], name, KIND, make)
        else:
            more = fresh("more", out)
            out = append_arrow(out, [text_col], more, KIND, make)
            out = out.withColumn(name, merged(quoted(name), quoted(more))).drop(more)
    if out is None:
        out = append_arrow(docs, [text_col], name, KIND, lambda: lambda texts: pa.array(search([], texts.to_pylist())))
    return out, name


def merged(a, b):
    """Two answers about one row as one: items united, spans of words laid together."""
    spans = F.array_sort(F.concat(a["spans"], b["spans"]))
    joined = F.aggregate(spans, F.array().cast(KIND["spans"].dataType), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
    total = F.aggregate(joined, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return F.struct(a["n_words"].alias("n_words"), total.alias("n_hit"), F.array_sort(F.array_union(a["item_ids"], b["item_ids"])).alias("item_ids"), joined.alias("spans"))


def contaminated(answer):
    return (answer["n_hit"] > 0) & (F.lit(20) * answer["n_hit"] >= answer["n_words"])


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
