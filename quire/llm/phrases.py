"""Repeated passages of words: a word goes if a window of LENGTH words that covers it also starts earlier.

Earlier means in a document with a smaller id, or further to the front of the same document. Recurring passages are
compiled into Aho-Corasick automata, each for a shard of them, and the texts that may hold them are streamed through.

1. Texts are split once and packed, words joined by one space, into chunks of about CHUNK bytes in the shared folder.
2. Of a window's Q-word phrases the one with the least hash is its anchor; windows in a row with one anchor are a block.
   Chunks send the distinct hashes of anchors to buckets and learn which of them other chunks have as well.
3. Chunks send the blocks of those anchors, equal ones once with their least document, to the anchors' buckets. There
   windows that recur are found by hash, and glued to passages: two neighbouring windows belong to one passage if neither
   occurs without the other. Automata over word numbers confirm the passages and locate each occurrence in the blocks.
4. What starts in a smaller document is told to the chunks. Passages that recur within a text are located there, by the
   same automata over its own blocks. Words that are covered go.

An anchor that very many chunks have would make one group of blocks: its windows are sent one by one, under their own
hash. A bucket holds each distinct block once, and 20 bytes for every chunk that sent it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, gathered, quoted, written
from .repeats import batch_of, bucket_of, distinct_rows, runs

LENGTH = 20
Q = 8
#: Windows of a block at most.
SPAN = LENGTH - Q + 1
CHUNK = 2 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 12 << 20
#: Anchors that more chunks have are sent window by window.
HOT_CHUNKS = 2000
#: Passages of one automaton (some 30 words each, about 2 KB in memory).
PATTERNS = 1500
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NONE = np.iinfo(np.int64).max
PACKED = "chunk long, data binary, sizes binary, ids binary, known binary, size long"


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The words of all texts in packed rows; a text larger than a chunk has one of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        sizes: list[int] = []
        ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            told = press.compress(b" ".join(t for t in texts if t))
            row = (part << 32 | n, told, np.array(sizes, np.int64).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids]).tobytes(), size)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["chunk", "data", "sizes", "ids", "known", "size"])

        for whole in batches:
            for batch in cut(whole, 1, CHUNK):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    own = b" ".join(words)
                    if ids and size + len(own) > CHUNK:
                        yield flush()
                        texts, sizes, ids, size, n = [], [], [], 0, n + 1
                    texts.append(own)
                    sizes.append(len(words))
                    ids.append(i)
                    size += len(own) + 32
        if ids:
            yield flush()

    return docs.select(quoted(id_col).cast("long"), quoted(text_col)).mapInArrow(pack, PACKED)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * K2
    return h ^ (h >> np.uint64(29))


class Words:
    """Words joined by one space: where they begin, and hashes of all runs of Q and of LENGTH of them."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data + b" ", np.uint8)
        self.begins = np.append(0, np.flatnonzero(self.bytes == 32) + 1)[: None if data else 1]
        sizes = np.diff(self.begins)  # with the space behind
        n = len(sizes)
        if not n:
            self.phrase = self.window = np.zeros(0, np.uint64)
            return
        power = np.cumprod(np.append(np.uint64(1), np.full(sizes.max(), K1)))
        own = (self.bytes.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(self.bytes)) - np.repeat(self.begins[:-1], sizes)]
        of = {1: mixed(np.add.reduceat(own, self.begins[:-1]))}
        for k in (1, 2, 4, 8):
            one = of[k]
            of[2 * k] = one[:-k] * np.uint64(pow(int(K1), k, 1 << 64)) + one[k:]
        self.phrase = mixed(of[Q])
        self.window = mixed(of[16][: max(0, n - LENGTH + 1)] * K2 + of[LENGTH - 16][16 : 16 + max(0, n - LENGTH + 1)])

    def numbers(self) -> np.ndarray:
        """A number for every word, equal for equal words."""
        return pa.Array.from_buffers(pa.large_binary(), len(self.begins) - 1, [None, pa.py_buffer(self.begins.astype(np.int64)), pa.py_buffer(self.bytes)]).dictionary_encode().indices.to_numpy() if len(self.begins) > 1 else np.zeros(0, np.int32)


class Chunk(Words):
    """A chunk's words and blocks: first window, number of windows, document and the hash of the anchor."""

    def __init__(self, data: bytes, sizes: bytes, ids: bytes, known: bytes):
        super().__init__(zstandard.ZstdDecompressor().decompress(data))
        self.sizes, self.ids, self.known = np.frombuffer(sizes, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = len(self.window)
        if not n:
            self.first = self.n = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        bits = np.uint64((1 << max(20, len(self.phrase).bit_length())) - 1)
        m = (self.phrase & ~bits) | np.arange(len(self.phrase), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        m = np.minimum(m[: width - SPAN], m[SPAN - width :]) if width < SPAN else m
        at = (m & bits).astype(np.int64)  # anchor of the window that starts here
        whole = text[:n] == text[LENGTH - 1 :]
        opens = whole & (np.append(True, at[1:] != at[:-1]) | np.append(True, ~whole[:-1]))
        closes = whole & np.append(opens[1:] | ~whole[1:], True)
        self.first = np.flatnonzero(opens)
        self.n = np.flatnonzero(closes) - self.first + 1
        self.doc = text[self.first]
        self.hash = self.phrase[at[self.first]]

    def texts(self, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The words of blocks, each followed by a space."""
        data = self.bytes.tobytes()
        return [data[b:e] for b, e in zip(self.begins[first].tolist(), self.begins[first + n + LENGTH - 1].tolist())]

    def merged(self, which: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(blocks in the order of documents and places, their texts, the first equal one of each)."""
        which = which[np.lexsort((self.first[which], self.ids[self.doc[which]]))]
        seen: dict[bytes, int] = {}
        texts = self.texts(self.first[which], self.n[which])
        return which, texts, np.array([seen.setdefault(t, k) for k, t in enumerate(texts)], np.int64)

    def again(self) -> np.ndarray:
        """Blocks of documents with an id whose anchor's hash the chunk has more than once."""
        own = np.flatnonzero(self.known[self.doc])
        _, inverse, count = np.unique(self.hash[own], return_inverse=True, return_counts=True)
        return own[count[inverse] > 1]


def occurrences(numbers: np.ndarray, window: np.ndarray, first: np.ndarray, n: np.ndarray, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, window in it, passage) of all windows that recur among the blocks, or lie in a block that does by itself.

    `numbers` are the words, `window` the hashes of windows by place. Passages are runs of windows none of which occurs
    without its neighbour, so wherever one of their windows stands, all of the passage does. Automata find them.
    """
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none, none
    at, block = gathered(first, n), np.repeat(np.arange(len(first)), n)
    _, kind = np.unique(window[at], return_inverse=True)
    count = np.bincount(kind)
    pick = (count[kind] > 1) | copied[block]
    before = np.flatnonzero(block[1:] == block[:-1])
    _, pair = np.unique(kind[before] * len(count) + kind[before + 1], return_inverse=True)
    both = np.bincount(pair)[pair] if len(pair) else none
    glued = np.zeros(len(at), bool)
    glued[before + 1] = (both == count[kind[before]]) & (both == count[kind[before + 1]])
    head = np.flatnonzero(pick & ~glued)
    if not len(head):
        return none, none, none
    ends = np.append(np.flatnonzero(~glued)[1:], len(at))
    long = ends[np.searchsorted(ends, head, "right")] - head
    _, one, passage = np.unique(kind[head], return_index=True, return_inverse=True)
    turn = np.argsort(one)  # passages in the order of blocks
    place = np.empty(len(one), np.int64)
    place[turn] = np.arange(len(one))
    passage, one = place[passage], one[turn]
    at_block = block[head]
    shard = passage // PATTERNS
    by = np.argsort(shard, kind="stable")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stop = int(numbers.max()) + 1
    for k, part in runs(shard[by]):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p, h in enumerate(one[k * PATTERNS : (k + 1) * PATTERNS].tolist(), k * PATTERNS):
            b = at[head[h]]
            automaton.add_word(tuple(numbers[b : b + long[h] + LENGTH - 1].tolist()), p)
        automaton.make_automaton()
        blocks = np.unique(at_block[by[part]])
        size = n[blocks] + LENGTH - 1
        begin = np.cumsum(size + 1) - size - 1
        stream = np.full(int((size + 1).sum()), stop, np.int64)  # a number that no word has stands between blocks
        stream[gathered(begin, size)] = numbers[gathered(first[blocks], size)]
        hits = np.fromiter((x for hit in automaton.iter(tuple(stream.tolist())) for x in hit), np.int64).reshape(-1, 2)
        which = hits[:, 1]
        windows = long[one[which]]
        own = np.searchsorted(begin, hits[:, 0], "right") - 1
        start = hits[:, 0] - (windows + LENGTH - 2) - begin[own]
        out.append((np.repeat(blocks[own], windows), gathered(start, windows), np.repeat(which, windows)))
    return tuple(np.concatenate(x) for x in zip(*out))


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            yield row[0], Chunk(*row[1:5]), row[5:]


def send_hashes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk, _ in each_chunk(batches):
            own = np.unique(chunk.hash[chunk.known[chunk.doc]])
            home = bucket_of(own, buckets)
            order = np.argsort(home, kind="stable")
            own, home = own[order], home[order]
            got = [(k, own[s].astype(np.uint32).tobytes()) for k, s in runs(home)]
            yield batch_of([[k for k, _ in got], [name] * len(got), [v for _, v in got]], ["bucket", "chunk", "hashes"])

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(row[0], []).append(row[1:])
    for k in sorted(held):
        yield k, held.pop(k)


def shared_hashes(hot_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in by_bucket(batches):
            parts = [np.unique(np.frombuffer(v, np.uint32)) for _, v in rows]
            name, count = np.unique(np.concatenate(parts), return_counts=True)
            many, hot = name[count > 1], name[count > hot_chunks]
            back = [[p[np.isin(p, of, assume_unique=True)].tobytes() for p in parts] for of in (many, hot)]
            yield batch_of([[c for c, _ in rows], [k] * len(rows), *back], ["chunk", "bucket", "hashes", "hot"])

    return run


def send_blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for name, chunk, (flags,) in each_chunk(batches):

            def told(field: str) -> np.ndarray:
                got = [np.frombuffer(f[field], np.uint32).astype(np.uint64) | np.uint64(f["bucket"]) << np.uint64(32) for f in flags or []]
                return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)

            wide = (chunk.hash & np.uint64(0xFFFFFFFF)) | bucket_of(chunk.hash, buckets).astype(np.uint64) << np.uint64(32)
            pick = np.isin(wide, told("hashes")) & chunk.known[chunk.doc]
            pick[chunk.again()] = True
            which, _, same = chunk.merged(np.flatnonzero(pick))
            which = which[same == np.arange(len(same))]
            hot = np.isin(wide[which], told("hot"))
            cool, warm = which[~hot], which[hot]
            single = gathered(chunk.first[warm], chunk.n[warm])
            first, n = np.append(chunk.first[cool], single), np.append(chunk.n[cool], np.ones(len(single), np.int64))
            key = np.append(chunk.hash[cool], chunk.window[single])
            docs = chunk.ids[np.append(chunk.doc[cool], np.repeat(chunk.doc[warm], chunk.n[warm]))]
            home = bucket_of(key, buckets)
            order = np.lexsort((key, home))
            first, n, key, docs, home = (x[order] for x in (first, n, key, docs, home))
            texts = chunk.texts(first, n)
            got = [(k, press.compress(b"\n".join(t[:-1] for t in texts[s])), key[s].tobytes(), docs[s].tobytes(), first[s].astype(np.uint32).tobytes()) for k, s in runs(home)]
            yield batch_of([[g[0] for g in got], [name] * len(got), *([g[i] for g in got] for i in range(1, 5))], ["bucket", "chunk", "texts", "keys", "docs", "first"])

    return run


def answer_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block sent, the windows that a document smaller than its own has."""
    open_ = zstandard.ZstdDecompressor()
    held: dict[int, tuple[dict[bytes, int], list, list]] = {}
    for batch in batches:
        for bucket, chunk, texts, keys, docs, first in zip(*(c.to_pylist() for c in batch.columns)):
            seen, heads, refs = held.setdefault(bucket, ({}, [], []))
            before = len(seen)
            kind = np.array([seen.setdefault(t, len(seen)) for t in open_.decompress(texts).split(b"\n")], np.int64)
            new = np.flatnonzero(kind >= before)
            heads.append(np.frombuffer(keys, np.uint64)[new[np.unique(kind[new], return_index=True)[1]]])
            refs.append((chunk, kind.astype(np.uint32), np.frombuffer(docs, np.int64), np.frombuffer(first, np.uint32)))
    for bucket in sorted(held):
        seen, heads, refs = held.pop(bucket)
        key = np.concatenate(heads)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        texts = list(seen)
        words = Words(b" ".join(texts[i] for i in order.tolist()))
        sizes = np.array([texts[i].count(b" ") + 1 for i in order.tolist()], np.int64)
        del seen, texts
        kinds, docs = place[np.concatenate([r[1] for r in refs])], np.concatenate([r[2] for r in refs])
        least, most = np.full(len(order), NONE), np.full(len(order), -NONE)
        np.minimum.at(least, kinds, docs)
        np.maximum.at(most, kinds, docs)
        block, window, passage = occurrences(words.numbers(), words.window, np.cumsum(sizes) - sizes, sizes - LENGTH + 1, least < most)
        low = np.full((len(order), SPAN), NONE)
        if len(passage):
            of = np.full(passage.max() + 1, NONE)
            np.minimum.at(of, passage, least[block])
            low[block, window] = of[passage]
        back, at = [], 0
        for chunk, kind, _, first in refs:
            kind, own = kinds[at : at + len(kind)], docs[at : at + len(kind)]
            at += len(kind)
            mask = ((low[kind] < own[:, None]) << np.arange(SPAN)).sum(axis=1).astype(np.uint32)
            told = np.flatnonzero(mask)
            if len(told):
                back.append((chunk, first[told].tobytes(), mask[told].tobytes()))
        yield batch_of([[b[i] for b in back] for i in range(3)], ["chunk", "first", "mask"])


def covered(chunk: Chunk, answers: list | None) -> np.ndarray:
    """Which words of the chunk go."""
    gone = np.zeros(len(chunk.window) + LENGTH, bool)  # windows, by their first word
    for a in answers or []:
        first, mask = (np.frombuffer(a[k], np.uint32) for k in ("first", "mask"))
        for k in range(SPAN):
            gone[first[(mask >> np.uint32(k)) & 1 > 0].astype(np.int64) + k] = True
    which, _, same = chunk.merged(chunk.again())  # what was found for the least document's block holds for equal ones
    later = np.flatnonzero(same != np.arange(len(same)))
    own, of = which[later], which[same[later]]
    full = chunk.ids[chunk.doc[own]] > chunk.ids[chunk.doc[of]]
    gone[gathered(chunk.first[own[full]], chunk.n[own[full]])] = True
    own, of = own[~full], of[~full]
    gone[gathered(chunk.first[own], chunk.n[own])] = gone[gathered(chunk.first[of], chunk.n[of])]
    # passages that recur within a text: their first place stays
    _, kind, count = np.unique(np.stack([chunk.doc.astype(np.uint64), chunk.hash]), axis=1, return_inverse=True, return_counts=True) if len(chunk.doc) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    often = np.flatnonzero(count[kind.ravel()] > 1)
    block, window, passage = occurrences(chunk.numbers() if len(often) else np.zeros(0, np.int64), chunk.window, chunk.first[often], chunk.n[often], np.zeros(len(often), bool))
    if len(block):
        doc, place = chunk.doc[often[block]], chunk.first[often[block]] + window
        # windows of one passage follow one another: a window is told apart by the passage and its place behind the passage's head
        head = np.append(True, (block[1:] != block[:-1]) | (passage[1:] != passage[:-1]) | (window[1:] != window[:-1] + 1))
        begin = np.flatnonzero(head)
        long = np.diff(np.append(begin, len(head)))
        by = np.lexsort((place[begin], passage[begin], doc[begin]))
        b = begin[by]
        repeat = np.append(False, (doc[b][1:] == doc[b][:-1]) & (passage[b][1:] == passage[b][:-1]))
        gone[gathered(place[b[repeat]], long[by[repeat]])] = True
    edge = np.zeros(len(gone) + LENGTH, np.int32)
    hit = np.flatnonzero(gone)
    edge[: len(gone)] += gone
    np.add.at(edge, hit + LENGTH, -1)
    return np.cumsum(edge)[: int(chunk.sizes.sum())] > 0


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for _, chunk, (answers,) in each_chunk(batches):
        gone = covered(chunk, answers)
        data, left = chunk.bytes.tobytes(), ~np.repeat(gone, np.diff(chunk.begins)) if len(gone) else np.zeros(0, bool)
        total = np.append(0, np.cumsum(gone))
        stop = np.cumsum(chunk.sizes)
        cols: list[list] = [[] for _ in range(5)]
        for b, e, i, known in zip((stop - chunk.sizes).tolist(), stop.tolist(), chunk.ids.tolist(), chunk.known.tolist()):
            lost, spans, x, y = int(total[e] - total[b]), [], int(chunk.begins[b]), int(chunk.begins[e])
            kept = data[x:y]
            if lost:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone[b:e].astype(np.int8), [0]])))
                spans = [{"start": s, "end": t} for s, t in zip(turn[::2].tolist(), turn[1::2].tolist())]
                kept = chunk.bytes[x:y][left[x:y]].tobytes()
            for c, v in zip(cols, (i if known else None, e - b, lost, hashlib.sha256(kept[:-1]).hexdigest(), spans)):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def remove_phrases(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256, spans (word places that go).

    Null, empty and blank texts have no words. Texts of fewer than LENGTH words lose nothing. Of rows with one id none
    counts as smaller: they keep what only they share, but for what recurs within each. A row with a null id has no place
    in the order: it loses only its own repetitions and takes nothing from others. Very long texts are worked on whole
    (some tens of times their bytes in memory). Columns of other names play no part. An empty table gives no rows.
    """
    packed = written(chunks(docs, id_col, text_col), "chunks")
    buckets = 1 + (packed.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES
    packed = packed.drop("size")
    sent = packed.mapInArrow(send_hashes(buckets), "bucket long, chunk long, hashes binary")
    shared = sent.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(shared_hashes(hot_chunks), "chunk long, bucket long, hashes binary, hot binary")
    flags = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hashes", "hot")).alias("flags"))  # 8 bytes an anchor of the chunk at most
    blocks = packed.join(flags, "chunk", "left").mapInArrow(send_blocks(buckets), "bucket long, chunk long, texts binary, keys binary, docs binary, first binary")
    answers = blocks.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(answer_blocks, "chunk long, first binary, mask binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("first", "mask")).alias("answers"))  # 8 bytes a block or hot window of the chunk at most
    return packed.join(answers, "chunk", "left").mapInArrow(finish, OUT)
