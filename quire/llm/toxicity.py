"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the character 3- to 6-grams of the lower-cased text, present or not, hashed into 2**22 buckets; ASCII
characters that are no letters count as blanks, so that an n-gram at the edge of a word is one wherever the word stands.
With p and q the smoothed document counts of a feature in the two classes, r = log((p / |p|) / (q / |q|)), drawn towards 0
by SURE standard errors, scales it; a logistic regression is trained on the scaled features. It is fitted on at most PER_CLASS labelled rows of each class; the weights
(one small table of bounded size) are broadcast and every whole text is scored where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_arrow, cut, fresh, quoted, written
from .learning import labelled_sample, sigmoid

BITS = 22
ORDERS = (3, 4, 5, 6)
#: Bound of the training sample, for each class.
PER_CLASS = 2500
#: Parts of the buckets that are counted apart.
SLICES = 16
#: Standard errors by which a log-count ratio is drawn towards 0; one that would pass it does not count.
SURE = 2.5
BLANKS = {c: " " for c in range(128) if not chr(c).isalpha()}


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts, one after another, and where each begins (with the end last)."""
    own = [(t or "").lower().translate(BLANKS).encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum([0, *(len(x) // 4 for x in own)])
    return np.frombuffer(b"".join(own), np.uint32), ends


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    if len(points) < order:
        return np.zeros(0, np.uint32)
    h = points[: len(points) - order + 1] * np.uint32(0x01000193)
    for k in range(1, order):
        h = (h + points[k : len(points) - order + 1 + k]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1) + np.uint32(order * 0x7F4A7C15 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)


def present(texts: list[str | None], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs, each once, of the n-grams that lie within one text; useful, if given, tells the buckets that count."""
    points, ends = codes(texts)
    pairs = []
    for n in ORDERS:
        b = buckets(points, n)
        at = np.flatnonzero(useful[b]) if useful is not None else np.arange(len(b))
        row = np.searchsorted(ends, at, "right") - 1
        inside = at + n <= ends[row + 1] if len(at) else np.zeros(0, bool)
        pairs.append((row[inside].astype(np.uint64) << np.uint64(BITS)) | b[at[inside]].astype(np.uint64))
    every = np.unique(np.concatenate(pairs))
    return (every >> np.uint64(BITS)).astype(np.int64), (every & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """Scaled weights of the buckets that count, and the intercept."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.feature] = self.weight
        return out


def ratios(p: np.ndarray, q: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-count ratios of features with p rows of label 1 and q of label 0, drawn in; 0 where they tell nothing."""
    ratio = np.log(((p + 1) / (n1 + 2)) / ((q + 1) / (n0 + 2)))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - SURE * np.sqrt(1 / (p + 1) + 1 / (q + 1)))


def fit(rows: list[np.ndarray], y: np.ndarray, feature: np.ndarray, ratio: np.ndarray, prior: dict[int, int], *, rounds: int = 600, ridge: float = 1e-6) -> Model:
    """The classifier from each row's numbers of features. With one class only, every text gets the smoothed share of label 1, without labels a third."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0 or not len(feature):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), math.log((prior[1] + 1) / (prior[0] + 2)))
    odds = math.log((prior[1] + 1) / (prior[0] + 1))
    col, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    length = np.sqrt(np.bincount(row, weights=ratio[col] ** 2, minlength=len(y))).mean() + 1
    x = ratio / length
    w, was, b = np.zeros(len(feature)), np.zeros(len(feature)), 0.0
    for k in range(rounds):
        v = w + k / (k + 3) * (w - was)
        e = sigmoid(b + np.bincount(row, weights=(v * x)[col], minlength=len(y))) - y
        was, w = w, v - (np.bincount(col, weights=e[row], minlength=len(v)) * x / len(y) + ridge * v)
        b -= e.mean()
    return Model(feature, (w * x).astype(np.float32), b + odds - math.log(n1 / n0))


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each label that have each bucket, of a task's rows (_y, text): one row for each of SLICES parts of the buckets."""
    held = np.zeros((2, 1 << BITS), np.uint32)
    for whole in batches:
        for batch in cut(whole, 1, 1 << 20):
            row, b = present(batch.column(1).to_pylist())
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                np.add.at(held[label], b[y[row] == label], 1)
    parts = held.reshape(2, SLICES, -1)
    if held.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), *(pa.array([x.tobytes() for x in parts[label]], pa.binary()) for label in (0, 1))], names=["slice", "zeros", "ones"])


def useful_features(n1: int, n0: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, zeros, ones in zip(*(c.to_pylist() for c in batch.columns)):
                held[k] = held.get(k, 0) + np.stack([np.frombuffer(x, np.uint32) for x in (zeros, ones)]).astype(np.int64)
        for k in sorted(held):
            q, p = held.pop(k)
            r = ratios(p, q, n1, n0)
            at = np.flatnonzero(r)
            yield pa.RecordBatch.from_arrays([pa.array(at + k * len(p)), pa.array(r[at])], names=["bucket", "ratio"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", label: str = "toxic", id_col: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Fits on a sample of at most per_class rows of each class; the driver holds the useful features and which rows have them.

    Null and empty texts are rows without features. Labels repeated for one id count once, the larger wins; null ids and
    labels, and labels without a document, are left out; of ties in the sample's hash the smaller id comes first. Repeated
    documents of a sampled id all count. With one class only, or no labels, the model knows just that class's smoothed share.
    Very long texts give their features whole. Other columns are not read; empty tables give a model without features.
    """
    rows, prior = labelled_sample(docs.select(quoted(id_col), quoted(text_col)), labels, label, per_class, id_col=id_col)
    sample = written(rows.select("_y", quoted(text_col).alias("text"), F.xxhash64(quoted(id_col)).alias("place")).repartition(8, "place"), "labelled")
    n = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    counts = sample.select("_y", "text").mapInArrow(count_features, "slice int, zeros binary, ones binary")
    found = counts.repartition(SLICES, "slice").mapInArrow(useful_features(n.get(1, 0), n.get(0, 0)), "bucket long, ratio double").collect()
    found.sort()
    feature, ratio = np.array([r.bucket for r in found], np.int64), np.array([r.ratio for r in found])
    held = docs.sparkSession.sparkContext.broadcast(feature)  # 2**22 numbers at most, in fact some ten thousand

    def make():
        useful = np.zeros(1 << BITS, bool)
        useful[held.value] = True

        def one(texts: pa.Array) -> pa.Array:
            row, b = present(texts.to_pylist(), useful)
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            at = np.searchsorted(held.value, b).astype("<u4")
            return pa.array([at[ends[i] : ends[i + 1]].tobytes() for i in range(len(texts))], pa.binary())

        return one

    got = append_arrow(sample, ["text"], "_feet", T.BinaryType(), make).select("place", "_y", "_feet").collect()
    got.sort(key=lambda r: (r[0], r[2]))
    return fit([np.frombuffer(r[2], "<u4") for r in got], np.array([r[1] for r in got], np.int64), feature, ratio, prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of scores from 0 to 1 (its name is returned too); null and empty texts get that of no feature.

    Repeated rows score alike; an empty table stays empty; very long texts are scored whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**22 features; in fact those of the bounded sample

    def make():
        table = held.value.table()
        useful = table != 0

        def one(texts: pa.Array) -> pa.Array:
            row, b = present(texts.to_pylist(), useful)
            return pa.array(sigmoid(held.value.bias + np.bincount(row, weights=table[b], minlength=len(texts))), pa.float64())

        return one

    name = fresh("toxicity", docs)
    return append_arrow(docs, [text_col], name, T.DoubleType(), make), name
