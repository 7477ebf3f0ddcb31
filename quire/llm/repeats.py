"""Suffix-array deduplication: remove what also stands in a document with a smaller id, by bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Sorting the suffixes
of the whole corpus is not needed for that: of any LENGTH-byte window the q-gram with the least hash is the same wherever
the window occurs (its anchor). Consecutive windows with one anchor make a block, at most 2 * LENGTH - Q bytes long.

1. Texts are packed into chunks of about CHUNK bytes, compressed, and written to the shared folder; passes read them there.
2. Every chunk sends the distinct hashes of its anchors, 4 bytes each, to buckets; a bucket sends back those of several
   chunks. Buckets grow in number with the input, so their hashes stay as telling as now (a false one costs only time).
3. Chunks send the blocks of these anchors, equal blocks once with their least document, to the buckets of the anchors.
   There the suffixes of the blocks are put into buckets by their first 8 bytes. A bucket of depth d is refined by sorting
   on the bucket pointers of the suffixes d bytes later; the new pointers hold at once, so buckets refined after it jump
   further, and its own parts are refined again in the same way until their depth is LENGTH. Buckets with one window are
   left alone. In the order so found, windows of one string are neighbours: those of one bucket are equal, those of two
   buckets are compared. The least document of each string decides.
4. Answers, a bit for each window, return to the chunk, which marks the bytes and hashes what is left.

Hashes only choose candidates; strings are compared as strings. Copies within a chunk are merged before anything is sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, gathered, quoted, written

LENGTH = 50
Q = 24
#: Windows that share an anchor at most, and the bytes of their block.
SPAN = LENGTH - Q + 1
BLOCK = LENGTH + SPAN - 1
CHUNK = 2 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 12 << 20
#: Distinct blocks whose suffixes are refined at once (a group of one anchor is never split).
REFINED = 20_000
#: Suffixes refined before the next ones see their pointers.
SLICE = 1 << 16
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
NONE = np.iinfo(np.int64).max
PACKED = "chunk long, data binary, ends binary, ids binary, known binary, size long"


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts in packed rows; a text larger than a chunk has one of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = (part << 32 | n, press.compress(b"".join(texts)), np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(), size)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["chunk", "data", "ends", "ids", "known", "size"])

        for whole in batches:
            for batch in cut(whole, 1, CHUNK):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = (t or "").encode("utf-8", "surrogatepass")
                    if texts and size + len(own) > CHUNK:
                        yield flush()
                        texts, ids, size, n = [], [], 0, n + 1
                    texts.append(own)
                    ids.append(i)
                    size += len(own)
        if texts:
            yield flush()

    return docs.select(quoted(id_col).cast("long"), quoted(text_col)).mapInArrow(pack, PACKED)


class Chunk:
    """A chunk's bytes and blocks: first and last window, anchor, document."""

    def __init__(self, data: bytes, ends: bytes, ids: bytes, known: bytes):
        self.data = zstandard.ZstdDecompressor().decompress(data)
        self.ends = np.frombuffer(ends, np.int64)
        self.begins = np.append(0, self.ends[:-1])
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        n = len(self.data)
        self.bytes = np.frombuffer(self.data + bytes(BLOCK), np.uint8)
        if n < LENGTH:
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        e = np.ndarray((n - 7,), "<u8", self.data, 0, (1,))
        h = (e[: n - Q + 1] * K1) ^ (e[8 : n - Q + 9] * K2)
        h ^= h >> np.uint64(31)
        h += e[16:] * K3
        h *= K2
        h ^= h >> np.uint64(29)
        bits = np.uint64((1 << max(22, n.bit_length())) - 1)
        m = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < SPAN:
            m = np.minimum(m[: width - SPAN], m[SPAN - width :])
        at = (m & bits).astype(np.int64)  # anchor of the window that starts here
        valid = np.ones(len(at) + LENGTH, np.int8)
        for k in range(1, LENGTH):
            valid[self.ends[self.ends >= k] - k] = 0
        valid = valid[: len(at)]
        opens = (valid > 0) & (np.append(True, at[1:] != at[:-1]) | np.append(True, valid[:-1] == 0))
        closes = (valid > 0) & np.append(opens[1:] | (valid[1:] == 0), True)
        self.first, self.last = np.flatnonzero(opens), np.flatnonzero(closes)
        self.anchor = at[self.first]
        self.doc = np.searchsorted(self.ends, self.first, "right")
        keep = self.known[self.doc]  # a document without an id has no place in the order
        self.first, self.last, self.anchor, self.doc = (x[keep] for x in (self.first, self.last, self.anchor, self.doc))
        self.hash = h[self.anchor]

    def records(self, which: np.ndarray) -> np.ndarray:
        """Blocks as rows of bytes: the text, zeros behind it, the number of windows, the anchor's offset."""
        first, n = self.first[which], self.last[which] - self.first[which] + 1
        out = np.empty((len(which), BLOCK + 2), np.uint8)
        place = np.arange(BLOCK)
        out[:, :BLOCK] = self.bytes[first[:, None] + place]
        out[:, :BLOCK][place >= (n + LENGTH - 1)[:, None]] = 0
        out[:, BLOCK], out[:, BLOCK + 1] = n, self.anchor[which] - first
        return out

    def repeated(self) -> np.ndarray:
        """Blocks whose anchor's hash the chunk has more than once."""
        _, inverse, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        return np.flatnonzero(count[inverse] > 1)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct row, number of each row's class)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, inverse.ravel()


def bucket_of(hash_: np.ndarray, n: int) -> np.ndarray:
    return ((hash_ >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def batch_of(columns: list, names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "chunk": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for c, n in zip(columns, names)], names=names)


def runs(home: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    if len(home):
        begin = np.append(0, np.flatnonzero(np.diff(home)) + 1)
        for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(home)]):
            yield int(home[b]), slice(b, e)


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            yield row[0], Chunk(*row[1:5]), row[5:]


def send_hashes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk, _ in each_chunk(batches):
            own = np.unique(chunk.hash)
            home = bucket_of(own, buckets)
            order = np.argsort(home, kind="stable")
            own, home = own[order], home[order]
            got = [(k, own[s].astype(np.uint32).tobytes()) for k, s in runs(home)]
            yield batch_of([[k for k, _ in got], [name] * len(got), [v for _, v in got]], ["bucket", "chunk", "hashes"])

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """A partition's rows, which are whole buckets, bucket by bucket."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(row[0], []).append(row[1:])
    for k in sorted(held):
        yield k, held.pop(k)


def shared_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, rows in by_bucket(batches):
        parts = [np.unique(np.frombuffer(v, np.uint32)) for _, v in rows]
        name, count = np.unique(np.concatenate(parts), return_counts=True)
        many = name[count > 1]
        back = [(c, many[np.isin(many, p, assume_unique=True)].tobytes()) for (c, _), p in zip(rows, parts)]
        yield batch_of([[c for c, _ in back], [k] * len(back), [v for _, v in back]], ["chunk", "bucket", "hashes"])


def send_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for name, chunk, (flags,) in each_chunk(batches):
            told = [np.frombuffer(f["hashes"], np.uint32).astype(np.uint64) | np.uint64(f["bucket"]) << np.uint64(32) for f in flags or []]
            told = np.unique(np.concatenate(told)) if told else np.zeros(0, np.uint64)
            home = bucket_of(chunk.hash, buckets)
            wide = (chunk.hash & np.uint64(0xFFFFFFFF)) | home.astype(np.uint64) << np.uint64(32)
            pick = np.isin(wide, told)
            again = chunk.repeated()
            pick[again] = True
            which = np.flatnonzero(pick)
            which = which[np.lexsort((chunk.first[which], chunk.ids[chunk.doc[which]]))]  # the least document of equal blocks comes first
            one, _ = distinct_rows(rows := chunk.records(which))
            which, rows = which[one], rows[one]
            order = np.argsort(home[which], kind="stable")
            which, rows = which[order], rows[order]
            got = [(k, press.compress(rows[s].tobytes()), chunk.ids[chunk.doc[which[s]]].tobytes(), chunk.first[which[s]].astype(np.uint32).tobytes()) for k, s in runs(home[which])]
            yield batch_of([[g[0] for g in got], [name] * len(got), *([g[i] for g in got] for i in (1, 2, 3))], ["bucket", "chunk", "rows", "docs", "first"])

    return run


def refined(order: np.ndarray, windows: np.ndarray, pointer: np.ndarray, depth: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refines the buckets that start where `start` says by the pointers of their later suffixes; returns those still open.

    A pointer is the place of its bucket's first suffix in the order; -1 stands for the end of a block.
    """
    place = gathered(start, size)
    bucket = np.repeat(np.arange(len(start)), size)
    suffix = order[place]
    later = pointer[suffix + depth[start][bucket]]
    by = np.argsort(bucket.astype(np.int64) << 32 | later + 1, kind="stable")
    order[place], suffix, later = suffix[by], suffix[by], later[by]
    opens = np.append(True, (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1]))
    first = np.flatnonzero(opens)
    new = place[first]
    depth[new] = depth[start][bucket[first]] + np.where(later[first] < 0, LENGTH, depth[later[first]])
    sizes = np.diff(np.append(first, len(place)))
    pointer[suffix] = np.repeat(new, sizes)
    own = windows[suffix]
    open_ = (np.add.reduceat(own, first) > 1) & (depth[new] < LENGTH)
    return new[open_], sizes[open_]


def window_classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, class) of all windows of the blocks; equal classes are equal strings of LENGTH bytes."""
    n = rows[:, BLOCK].astype(np.int64)
    place, stride = np.arange(BLOCK), BLOCK + LENGTH
    held = np.zeros((len(rows), stride), np.uint8)  # zeros behind each block: nothing reaches into the next
    held[:, :BLOCK] = rows[:, :BLOCK]
    grams = np.ndarray((held.size - 7,), ">u8", held, 0, (1,))
    at = (np.arange(len(rows)) * stride)[:, None] + place
    own = place < (n + LENGTH - 1)[:, None]
    windows = np.zeros(held.size, np.int32)
    windows[at[place < n[:, None]]] = 1
    at = at[own]
    key = grams[at].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    order, key = at[by], key[by]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(order)))
    pointer = np.full(held.size, -1, np.int64)
    pointer[order] = np.repeat(start, size)
    depth = np.full(len(order), 8, np.int64)
    open_ = np.add.reduceat(windows[order], start) > 1
    start, size = start[open_], size[open_]
    while len(start):
        part = np.cumsum(size) // SLICE
        cuts = np.flatnonzero(np.diff(part)) + 1
        found = [refined(order, windows, pointer, depth, b, s) for b, s in zip(np.split(start, cuts), np.split(size, cuts)) if len(b)]
        start, size = (np.concatenate(x) for x in zip(*found))
    seen = order[windows[order] > 0]
    own = pointer[seen]
    turn = np.flatnonzero(own[1:] != own[:-1]) + 1
    a, b = seen[turn - 1], seen[turn]
    alike = np.ones(len(turn), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        alike &= grams[a + k] == grams[b + k]
    step = np.zeros(len(seen), np.int64)
    step[turn[~alike]] = 1
    return seen // stride, seen % stride, np.cumsum(step)


def answer_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for _, got in by_bucket(batches):
        rows = np.concatenate([np.frombuffer(open_.decompress(g[1]), np.uint8).reshape(-1, BLOCK + 2) for g in got])
        docs = np.concatenate([np.frombuffer(g[2], np.int64) for g in got])
        firsts = np.concatenate([np.frombuffer(g[3], np.uint32) for g in got])
        home = np.repeat([g[0] for g in got], [len(g[2]) // 8 for g in got])
        one, kind = distinct_rows(rows)
        least = np.full(len(one), NONE)
        np.minimum.at(least, kind, docs)
        rows = rows[one]
        anchors = rows[np.arange(len(rows))[:, None], rows[:, BLOCK + 1].astype(np.int64)[:, None] + np.arange(Q)]
        _, group = distinct_rows(anchors)
        less, any_ = np.zeros(len(rows), np.uint32), np.zeros(len(rows), np.uint32)  # windows that a document smaller than the block's least, or it, has
        order = np.argsort(group, kind="stable")
        order = order[np.bincount(group[kind])[group[order]] > 1]  # groups of one anchor with two blocks or more, equal ones too
        starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        at = 0
        while at < len(order):
            later = starts[starts >= at + REFINED]
            end = int(later[0]) if len(later) else len(order)
            part = order[at:end]
            row, window, string = window_classes(rows[part])
            low = np.full(string.max() + 1, NONE)
            np.minimum.at(low, string, least[part[row]])
            bit = np.uint32(1) << window.astype(np.uint32)
            np.bitwise_or.at(any_, part[row], bit)
            under = low[string] < least[part[row]]
            np.bitwise_or.at(less, part[row[under]], bit[under])
            at = end
        mask = np.where(docs > least[kind], any_[kind], less[kind])
        told = np.flatnonzero(mask)
        told = told[np.argsort(home[told], kind="stable")]
        back = [(c, firsts[told[s]].tobytes(), mask[told[s]].tobytes()) for c, s in runs(home[told])]
        yield batch_of([[b[i] for b in back] for i in range(3)], ["chunk", "first", "mask"])


def marked(chunk: Chunk, answers: list | None) -> np.ndarray:
    """Which bytes of the chunk go."""
    n = len(chunk.data)
    mask = np.zeros(len(chunk.first), np.uint32)
    if answers:
        first = np.concatenate([np.frombuffer(a["first"], np.uint32) for a in answers]).astype(np.int64)
        mask[np.searchsorted(chunk.first, first)] = np.concatenate([np.frombuffer(a["mask"], np.uint32) for a in answers])
    which = chunk.repeated()
    if len(which):
        _, kind = distinct_rows(chunk.records(which))
        ids = chunk.ids[chunk.doc[which]]
        least, told = np.full(kind.max() + 1, NONE), np.zeros(kind.max() + 1, np.uint32)
        np.minimum.at(least, kind, ids)
        np.bitwise_or.at(told, kind, mask[which])  # the answer for the least document holds for all its blocks of this text
        full = ((np.uint64(1) << (chunk.last[which] - chunk.first[which] + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        mask[which] = np.where(ids > least[kind], full, told[kind])
    edge = np.zeros(n + 1, np.int32)
    hit = np.flatnonzero(mask)
    for k in range(SPAN):
        start = chunk.first[hit[(mask[hit] >> np.uint32(k)) & 1 > 0]] + k
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge[:n]) > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for _, chunk, (answers,) in each_chunk(batches):
        gone = marked(chunk, answers)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        begin, end = turn[::2], turn[1::2]
        cols: list[list] = [[] for _ in range(6)]
        total = np.append(0, np.cumsum(gone))
        for b, e, i, known in zip(chunk.begins.tolist(), chunk.ends.tolist(), chunk.ids.tolist(), chunk.known.tolist()):
            lost, kept, spans = int(total[e] - total[b]), chunk.data[b:e], []
            if lost:
                own = slice(np.searchsorted(end, b, "right"), np.searchsorted(begin, e, "left"))
                spans = [{"start": max(x, b) - b, "end": min(y, e) - b} for x, y in zip(begin[own].tolist(), end[own].tolist())]
                kept = chunk.bytes[b:e][~gone[b:e]].tobytes()
            for c, v in zip(cols, (i if known else None, e - b, lost, len(spans), hashlib.sha256(kept).hexdigest(), spans)):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte places that go).

    Null texts are empty. Of rows with the same id none counts as smaller, so they keep what only they share. A row with
    a null id has no place in the order: it loses nothing and takes nothing from others. Texts of fewer than LENGTH bytes
    lose nothing; very long texts are worked on whole, in a chunk of their own. Other columns, whatever their names, play no
    part. An empty table gives no rows.
    """
    packed = written(chunks(docs, id_col, text_col), "chunks")
    buckets = 1 + (packed.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES
    packed = packed.drop("size")
    sent = packed.mapInArrow(send_hashes(buckets), "bucket long, chunk long, hashes binary")
    shared = sent.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(shared_hashes, "chunk long, bucket long, hashes binary")
    flags = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hashes")).alias("flags"))  # 4 bytes an anchor of the chunk at most
    blocks = packed.join(flags, "chunk", "left").mapInArrow(send_blocks(buckets), "bucket long, chunk long, rows binary, docs binary, first binary")
    answers = blocks.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(answer_blocks, "chunk long, first binary, mask binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("first", "mask")).alias("answers"))  # 8 bytes a block of the chunk at most
    return packed.join(answers, "chunk", "left").mapInArrow(finish, OUT)
