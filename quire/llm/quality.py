"""Quality by co-training: a text classifier and a metadata classifier teach each other, then score together.

View A sees the text only: frequencies of hashed character trigrams and a few shares (symbols, digits, capitals, repeated
lines, lengths of words). View B sees the page's metadata only: language, source and the logarithm of the length, hashed
one-hot. Both start from the labelled rows; in each round each labels the unlabelled rows of which it is surest, and the
other is trained on them besides its own. At the end each is calibrated on labelled rows that neither was trained on, and
the calibrated log-odds are added, the prior counted once. Both views are logistic regressions over bounded samples; the
weights, of fixed size, are broadcast and all documents scored where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_arrow, fresh, quoted
from .learning import labelled_sample, logistic, platt, sigmoid

TRIGRAMS = 1024
SHARES = 12
META = 256
#: Bounds of the samples: labelled rows of each class, unlabelled rows.
PER_CLASS, UNLABELLED = 2000, 4000
ROUNDS, SURE = 4, 0.05
KIND = T.StructType([T.StructField("text_score", T.DoubleType()), T.StructField("meta_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def classes() -> np.ndarray:
    """Class of each code point below 256: 0 letter, 1 digit, 2 blank, 3 line end, 4 symbol of junk, 5 capital, 6 other."""
    out = np.full(256, 6, np.uint8)
    for c in range(256):
        s = chr(c)
        out[c] = 5 if s.isupper() else 0 if s.isalpha() else 1 if s.isdigit() else 3 if s == "\n" else 2 if s.isspace() else 4 if s in "#*$%&|<>{}[]=@~^\\_" else 6
    return out


def text_view(texts: list[str | None]) -> np.ndarray:
    """Features of view A: square roots of trigram frequencies, then the shares."""
    own = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    length = np.array([len(x) // 4 for x in own], np.int64)
    points = np.frombuffer(b"".join(own), np.uint32)
    row = np.repeat(np.arange(len(texts)), length)
    n = len(texts)
    out = np.zeros((n, TRIGRAMS + SHARES), np.float32)
    if len(points) > 2:
        h = ((points[:-2] * np.uint32(0x01000193) ^ points[1:-1]) * np.uint32(0x85EBCA6B) ^ points[2:]) * np.uint32(0x9E3779B1)
        inside = row[:-2] == row[2:]
        count = np.bincount(row[:-2][inside] * TRIGRAMS + (h[inside] >> np.uint32(22)).astype(np.int64), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(count / np.maximum(1, count.sum(1, keepdims=True)))
        out[:, TRIGRAMS + 7] = (count > 0).sum(1) / TRIGRAMS
    kind = np.bincount(row * 7 + classes()[np.minimum(points, 255)], minlength=7 * n).reshape(n, 7)
    out[:, TRIGRAMS : TRIGRAMS + 7] = np.sqrt(kind / np.maximum(1, length)[:, None])
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x.strip()]
        words = (t or "").split()
        out[i, TRIGRAMS + 8] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[i, TRIGRAMS + 9] = min(1, len(words) / max(1, length[i]) * 4)
        out[i, TRIGRAMS + 10] = 1 - len(set(words)) / len(words) if words else 0
        out[i, TRIGRAMS + 11] = not words
    return out


def meta_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Features of view B, hashed one-hot; a null is a value of its own."""
    out = np.zeros((len(langs), META), np.float32)
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes)):
        step = -1 if size is None else int(size).bit_length()
        for name in (f"lang {lang}", f"source {source}", f"size {step}", f"both {lang} {source}"):
            out[i, xxhash.xxh32_intdigest(name) % META] = 1
    return out


@dataclass
class Model:
    """Both views' weights, their calibrations and the prior log-odds."""

    text: np.ndarray
    meta: np.ndarray
    text_fit: tuple[float, float]
    meta_fit: tuple[float, float]
    prior: float

    def odds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.text_fit[0] * (a @ self.text[:-1] + self.text[-1]) + self.text_fit[1]
        m = self.meta_fit[0] * (b @ self.meta[:-1] + self.meta[-1]) + self.meta_fit[1]
        return t, m, t + m - self.prior


def surest(z: np.ndarray, open_: np.ndarray, share: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows still open of which the view is surest, k in all, and their labels, in the classes' proportions."""
    k1 = max(1, round(k * share))
    order = np.flatnonzero(open_)[np.argsort(z[open_], kind="stable")]
    low, high = order[: max(1, k - k1)], order[-k1:] if len(order) > k else order[:0]
    return np.concatenate([low, high]), np.concatenate([np.zeros(len(low)), np.ones(len(high))])


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, au: np.ndarray, bu: np.ndarray, prior: dict[int, int], *, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """The co-trained model from labelled (a, b, y) and unlabelled (au, bu) features. With one class only all scores are the prior."""
    odds = float(np.log((prior[1] + 1) / (prior[0] + 1)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(TRIGRAMS + SHARES + 1), np.zeros(META + 1), (0.0, odds), (0.0, odds), odds)
    held = np.arange(len(y)) % 5 == 0
    share = (prior[1] + 1) / (prior[0] + prior[1] + 2)
    extra = {"a": ([], []), "b": ([], [])}
    open_ = np.ones(len(au), bool)
    for k in range(rounds + 1):
        wa, wb = (logistic(np.concatenate([x[~held], xu[np.array(extra[v][0], int)]]), np.concatenate([y[~held], extra[v][1]])) for v, x, xu in (("a", a, au), ("b", b, bu)))
        if k == rounds or not open_.any():
            break
        for w, x, other in ((wa, au, "b"), (wb, bu, "a")):
            rows, said = surest(x @ w[:-1] + w[-1], open_, share, max(2, int(sure * len(x))))
            extra[other][0].extend(rows.tolist())
            extra[other][1].extend(said.tolist())
            open_[rows] = False
    shift = odds - float(np.log((y[held].sum() + 1) / ((1 - y[held]).sum() + 1)))  # from the balanced sample to all labels
    fits = [platt(x[held] @ w[:-1] + w[-1], y[held]) for x, w in ((a, wa), (b, wb))]
    return Model(wa, wb, (fits[0][0], fits[0][1] + shift), (fits[1][0], fits[1][1] + shift), odds)


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", meta: tuple[str, str, str] = ("lang", "source", "n_chars"), label: str = "quality", id_col: str = "doc_id", per_class: int = PER_CLASS, unlabelled: int = UNLABELLED) -> Model:
    """Trains on bounded samples: per_class labelled rows of each class and `unlabelled` others, those with the least hash of the id.

    Null and empty texts, and null metadata, are values like others. Labels repeated for one id count once, the larger wins;
    null ids and labels are left out. Ties in the order of pseudo-labels go to the row that comes first by id and view;
    repeated rows count as often as they stand. Very long texts are viewed whole. Columns besides the text and the three of
    metadata are not read; without labels, or with one class, scores are that class's smoothed share.
    """
    cols = [id_col, text_col, *meta]
    known, prior = labelled_sample(docs.select(*cols), labels, label, per_class, id_col=id_col)
    ids = docs.select(id_col).where(quoted(id_col).isNotNull()).join(labels.select(quoted(id_col).alias("_l")), quoted(id_col) == F.col("_l"), "left_anti")
    chosen = ids.select(quoted(id_col).alias("_u")).orderBy(F.xxhash64("_u"), "_u").limit(unlabelled)
    more = docs.select(*cols).join(F.broadcast(chosen), quoted(id_col) == F.col("_u"), "left_semi").withColumn("_y", F.lit(None).cast("int"))

    def make():
        return lambda texts: pa.array([x.tobytes() for x in text_view(texts.to_pylist())], pa.binary())

    got = append_arrow(known.unionByName(more), [text_col], "_view", T.BinaryType(), make).drop(text_col).collect()
    got.sort(key=lambda r: (r["_y"] is None, r[id_col], r["_view"]))
    a = np.stack([np.frombuffer(r["_view"], np.float32) for r in got]) if got else np.zeros((0, TRIGRAMS + SHARES), np.float32)
    b = meta_view(*([r[c] for r in got] for c in meta))
    n = sum(r["_y"] is not None for r in got)
    return cotrain(a[:n], b[:n], np.array([r["_y"] for r in got[:n]], float), a[n:], b[n:], prior)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", meta: tuple[str, str, str] = ("lang", "source", "n_chars")) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned too): text_score, meta_score and score, from 0 to 1.

    Null texts count as empty, null metadata as a value of its own; repeated rows score alike; an empty table stays empty;
    very long texts are scored whole; columns of any other names pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def make():
        def one(texts: pa.Array, *more: pa.Array) -> pa.Array:
            odds = held.value.odds(text_view(texts.to_pylist()), meta_view(*(m.to_pylist() for m in more)))
            return pa.StructArray.from_arrays([pa.array(sigmoid(z).astype(float)) for z in odds], fields=list(pa.struct([(f.name, pa.float64()) for f in KIND.fields])))

        return one

    name = fresh("quality", docs)
    return append_arrow(docs, [text_col, *meta], name, KIND, make), name
