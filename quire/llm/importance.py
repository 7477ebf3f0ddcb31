"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn by Gumbel top-k.

1. Texts are split into words once and packed into chunks: the distinct words of a chunk and, for every occurrence, the
   place of its word among them. Chunks are written to the shared folder; later passes read them there.
2. The integer word dictionary: distinct words of all chunks, of corpus and target, each with an integer id. A chunk gets
   the ids of its own words back.
3. A chunk's n-grams become tuples of ids; it sends each distinct one with its count. Of all tuples the distinct ones are
   spelled out again through the dictionary, and the bytes of each are hashed once. The bucket goes back to the chunks.
4. Bucket counts of corpus and target make the gains, a list as long as there are buckets; chunks add them up by document.

What is shuffled are distinct words and distinct tuples of chunks, so the most frequent word is one row a chunk. Ranks
come from a range partitioning, whose parts are counted; no window runs over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, quoted, written

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10
SEED = 2024
#: Bytes of text in a chunk; a longer text has one of its own.
CHUNK = 16 << 20
#: Rows ranked in one part, about.
RANKED = 1_000_000
#: Bytes of words in the order of their numbers: A-Z become a-z, what is no letter, digit or non-ASCII byte parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PACKED = "chunk long, side int, words array<string>, places binary, sizes binary, ids array<long>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def packed(texts: DataFrame, side: int) -> DataFrame:
    """Chunks of (id, text): distinct words in order of first occurrence, compressed places, words of each text, ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        held: dict[bytes, int] = {}
        places: list[np.ndarray] = []
        sizes: list[int] = []
        ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            told = press.compress(np.concatenate([np.zeros(0, np.uint32), *places]).tobytes())
            columns = [[(part << 32 | n) << 1 | side], [side], [[w.decode() for w in held]], [told], [np.array(sizes, np.int64).tobytes()], [ids]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "side", "words", "places", "sizes", "ids"])

        for whole in batches:
            for batch in cut(whole, 1):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if sizes and size + len(t or "") > CHUNK:
                        yield flush()
                        held, places, sizes, ids, size, n = {}, [], [], [], 0, n + 1
                    own = words_of(t)
                    places.append(np.fromiter((held.setdefault(w, len(held)) for w in own), np.uint32, len(own)))
                    sizes.append(len(own))
                    ids.append(i)
                    size += len(t or "") + 64
        if sizes:
            yield flush()

    return texts.mapInArrow(pack, PACKED)


class Grams:
    """The n-grams of a chunk: distinct tuples of places and, for every occurrence, its tuple and text."""

    def __init__(self, places: bytes, sizes: bytes, longest: int):
        at = np.frombuffer(zstandard.ZstdDecompressor().decompress(places), np.uint32)
        self.sizes = np.frombuffer(sizes, np.int64)
        text = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        begin = int(at.max()) + 1 if len(at) else 0
        self.tuples = [np.arange(begin)[:, None]]  # by length: distinct tuples, one a row; single words are numbered already
        self.which: list[np.ndarray] = [at]
        self.text: list[np.ndarray] = [text]
        code = at  # one number for the tuple that starts here
        for n in range(2, longest + 1):
            if len(code) < 2:
                break
            _, code = np.unique(code[:-1].astype(np.int64) * (int(at.max()) + 1) + at[n - 1 :], return_inverse=True)
            whole = np.flatnonzero(text[: len(code)] == text[n - 1 : n - 1 + len(code)])
            _, first, inverse = np.unique(code[whole], return_index=True, return_inverse=True)
            self.tuples.append(at[whole[first][:, None] + np.arange(n)])
            self.which.append(begin + inverse)
            self.text.append(text[whole])
            begin += len(first)

    def counts(self) -> np.ndarray:
        return sum(np.bincount(w, minlength=sum(map(len, self.tuples))) for w in self.which)


def fields(told: pa.ListScalar, *names: str) -> list[np.ndarray]:
    """The fields of a list of structs as arrays; null is an empty list."""
    return [told.values.field(n).to_numpy() if told.is_valid else np.zeros(0, np.int64) for n in names]


def send_tuples(longest: int):
    """Rows (chunk, side, number, ids, n): the distinct tuples of a chunk as ids of the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, side, places, sizes = (c[i].as_py() for c in batch.columns[:4])
                grams = Grams(places, sizes, longest)
                place, own = fields(batch.column(4)[i], "place", "id")
                ids = np.zeros(len(place), np.int64)
                ids[place] = own
                lists = [ids[t] for t in grams.tuples]
                flat = np.concatenate([x.ravel() for x in lists])
                ends = np.append(0, np.cumsum(np.concatenate([np.full(len(x), x.shape[1]) for x in lists]))).astype(np.int32)
                n = len(ends) - 1
                columns = [pa.array(np.full(n, chunk)), pa.array(np.full(n, side, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(grams.counts().astype(np.int64))]
                whole = pa.RecordBatch.from_arrays(columns, names=["chunk", "side", "number", "tuple", "n"])
                for k in range(0, n, 1 << 16):
                    yield whole.slice(k, 1 << 16)

    return run


def weigh(longest: int, gains: list[int]):
    """Rows (id, n_words, n_features, weight) of a chunk's texts."""
    gain = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, sizes, ids = (c[i].as_py() for c in batch.columns[:3])
                grams = Grams(places, sizes, longest)
                own = np.zeros(len(grams.counts()), np.int64)
                number, bucket = fields(batch.column(3)[i], "number", "bucket")
                own[number] = gain[bucket]
                weight, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                for which, text in zip(grams.which, grams.text):
                    np.add.at(weight, text, own[which])
                    n += np.bincount(text, minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams.sizes), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


def spelled(tuples: DataFrame, dictionary: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(tuple, bucket) of distinct tuples: their words from the dictionary, joined by spaces, hashed."""
    words = []
    for k in range(longest):
        one = dictionary.select(F.col("id").alias(f"_id{k}"), F.col("word").alias(f"_word{k}"))
        tuples = tuples.join(one, F.get("tuple", F.lit(k)) == F.col(f"_id{k}"), "left").drop(f"_id{k}")
        words.append(F.col(f"_word{k}"))
    return tuples.select("tuple", (F.crc32(F.concat_ws(" ", *words).cast("binary")) % buckets).cast("int").alias("bucket"), *(c for c in tuples.columns if c != "tuple" and not c.startswith("_word")))


def gains_of(counts: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """counts: (bucket, in the corpus, in the target). The floor of 1000 times the logarithm of smoothed shares' ratio."""
    s, t = [0] * buckets, [0] * buckets
    for b, x, y in counts:
        s[b], t[b] = x, y
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t)]


def ranked(rows: DataFrame, total: int, share: int) -> DataFrame:
    """Adds rank: 1, 2, 3... by falling score, ties to the smaller id (null last), for the first `share` percent; else null.

    Rows are dealt by ranges of (score, id, a number of their own), so that rows alike in score and id do not share a
    part; each part is sorted and numbered, and parts start where those before them end.
    """
    drawn = share * total // 100
    parts = 1 + total // RANKED
    by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_own").asc()]
    placed = rows.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = written(placed.drop("_own").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a part
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    start = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, starts)] or [(0, 0)], "_part long, _start long")
    rank = F.col("_start") + within + 1
    return placed.join(F.broadcast(start), part == F.col("_part"), "left").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED,
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_features, weight, score, rank (null where it is not drawn).

    Null and empty texts have no words, weight 0, and are never drawn while least_words is above 0. A null id is hashed as
    the empty text and comes last among ties. Repeated rows score alike and are drawn one by one. Very long texts are
    worked on whole, in a chunk of their own. An empty target gives every bucket a count of 0; an empty table gives no
    rows. Other columns, whatever their names, play no part.
    """
    sides = packed(docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")), 0)
    chunks = written(sides.union(packed(target.select(F.lit(None).cast("long").alias("id"), quoted(target_text).alias("text")), 1)), "chunks", codec="zstd")
    own = chunks.select("chunk", F.posexplode("words").alias("place", "word"))
    dictionary = written(own.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary", codec="zstd")
    named = own.join(dictionary, "word").groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("named"))  # the distinct words of a chunk
    sent = chunks.select("chunk", "side", "places", "sizes").join(named, "chunk", "left").mapInArrow(send_tuples(longest), "chunk long, side int, number int, tuple array<long>, n long")
    sent = written(sent, "tuples", codec="zstd")
    sums = sent.groupBy("tuple").agg(*(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(("s", "t"))))
    hashed = written(spelled(sums, dictionary, longest, buckets), "hashed", codec="zstd")
    gains = gains_of([tuple(r) for r in hashed.groupBy("bucket").agg(F.sum("s"), F.sum("t")).collect()], buckets)  # one row a bucket at most
    told = sent.where("side = 0").join(hashed.select("tuple", "bucket"), "tuple").groupBy("chunk").agg(F.collect_list(F.struct("number", "bucket")).alias("told"))  # the distinct tuples of a chunk
    weighed = chunks.where("side = 0").select("chunk", "places", "sizes", "ids").join(told, "chunk", "left").select("places", "sizes", "ids", "told")
    weighed = weighed.mapInArrow(weigh(longest, gains), "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    scored = written(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))), "scored")
    long_enough = F.col("n_words") >= least_words
    drawable = scored.where(long_enough)
    return ranked(drawable, drawable.count(), share).union(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
