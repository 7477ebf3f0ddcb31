"""What the classifiers share: bounded samples of labelled rows, folds, and logistic regression on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import quoted

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as the empty text, whose fold is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Rows of docs with a column _y, at most per_class for each of the labels 0 and 1, and the counts of all training labels.

    Rows of the held-out fold never enter. The sample is the rows with the smallest hash of the id, the same on every
    run; its ids are a broadcast of at most 2 * per_class rows. Repeated labels of one id count once, the larger wins;
    null ids and labels are left out.
    """
    own = labels.where(quoted(id_col).isNotNull() & quoted(label).isNotNull() & (fold(quoted(id_col)) != 0))
    own = own.groupBy(quoted(id_col).alias("_sampled")).agg((F.max(quoted(label)) > 0).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}
    parts = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_sampled"), "_sampled").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.join(chosen, quoted(id_col) == F.col("_sampled")).drop("_sampled")
    return rows, {y: counts.get(y, 0) for y in (0, 1)}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """Weights and, last, the bias of a dense logistic regression by accelerated gradient steps."""
    n, d = x.shape
    w, was, bias, bias_was = np.zeros(d), np.zeros(d), 0.0, 0.0
    scale = 0.25 * (np.linalg.norm(x, axis=1) ** 2).mean() * 2 + 0.25 + ridge
    for k in range(rounds):
        m = k / (k + 3)
        v, c = w + m * (w - was), bias + m * (bias - bias_was)
        e = sigmoid(x @ v + c) - y
        was, bias_was = w, bias
        w, bias = v - (x.T @ e / n + ridge * v) / scale, c - e.mean() / scale * 2
    return np.append(w, bias)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that calibrate log-odds on held rows; the targets are smoothed as Platt proposed."""
    if not len(y):
        return 1.0, 0.0
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * score + b)
        q = p * (1 - p) + 1e-9
        g = np.array([((p - t) * score).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(q * score * score).sum() + 1e-3, (q * score).sum()], [(q * score).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b
