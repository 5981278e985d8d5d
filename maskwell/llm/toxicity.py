"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled ones (a sample of the training
rows whose labels are ignored).  A linear model over the distinct words of a text and
their prefixes is fitted in numpy by Adam on the class-prior-corrected risk

    prior * E_P[loss(z)] + max(0, E_U[loss(-z)] - prior * E_P[loss(-z)])

with logistic loss; while the bracket is below zero, a step undoes it instead of
fitting it.  The prior is the share of toxic rows among the labelled training rows.
A soft threshold keeps only features that matter, so long clean texts stay near the
prior.  The sample's bounds are ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, drawn
evenly by a hash of the id; features are made on the executors, the sample's hashed
features go to the driver, and the weights (``DIMENSIONS`` floats) are broadcast.

Defined results: a null or empty text has no features and scores the model's bias; equal
texts score alike; any length; without toxic training rows every score is 0; other
columns are handed on (``score`` is replaced).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow

BITS = 20
DIMENSIONS = 1 << BITS
MAX_POSITIVE, MAX_UNLABELLED = 1500, 4500
PREFIXES = (4, 5, 6)
STEPS, RATE, MIN_ROWS = 150, 0.05, 10
SPARSITY = (2e-3, 5e-4)  # soft thresholds of the fit that selects features and of the one that weighs them
MEMO = 100_000

_words = re.compile(r"\w+").findall


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its prefixes."""
    import xxhash

    names = ["=" + word, *[f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]]
    return [xxhash.xxh3_64_intdigest(x.encode()) & DIMENSIONS - 1 for x in names]


def words(text: str | None) -> set[str]:
    return {*_words(text.lower())} if text else set()


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds array<int> ``features``: those of the distinct words, with repeats."""

    def work():
        import pyarrow as pa

        memo: dict[str, list[int]] = {}

        def of(word: str) -> list[int]:
            if word not in memo:
                memo[word] = word_features(word)
            return memo[word]

        def apply(column):
            if len(memo) > MEMO:
                memo.clear()
            return [pa.array([[f for w in words(t) for f in of(w)] for t in column.to_pylist()], pa.list_(pa.int32()))]

        return apply

    return append_arrow(docs, text_col, [T.StructField("features", T.ArrayType(T.IntegerType()))], work)


class Model:
    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float, prior: float):
        self.index, self.weight, self.bias, self.prior = index, weight, bias, prior


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, sparsity: tuple[float, ...] = SPARSITY) -> Model:
    """The classifier of rows of feature numbers; ``positive`` marks the confirmed ones, all others are unlabelled.

    Each fit after the first sees the features that the one before kept.
    """
    if not positive.any() or positive.all():
        return Model(np.empty(0, np.int64), np.empty(0), -50.0, prior)
    # Row by row and in narrow types: the sample's features are the driver's largest data.
    found = [np.unique(r, return_counts=True) for r in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(u) for u, _ in found])
    col = np.concatenate([u for u, _ in found]).astype(np.int32)
    times = np.concatenate([np.minimum(c, 3).astype(np.uint8) for _, c in found])
    del found
    live = np.flatnonzero(np.bincount(col, minlength=DIMENSIONS) >= max(2, min(MIN_ROWS, positive.sum() // 20)))
    for threshold in sparsity:
        place = np.full(DIMENSIONS, -1, np.int32)
        place[live] = np.arange(len(live))
        use = place[col] >= 0
        row, col, times = row[use], col[use], times[use]
        w, bias = _descend(row.astype(np.intp), place[col].astype(np.intp), times.astype(np.float32), len(live), positive, prior, steps, rate, threshold)
        kept = np.abs(w) > 1e-3
        live, w = live[kept], w[kept]
    return Model(live, w, float(bias), prior)


def _descend(row, col, times, d: int, positive: np.ndarray, prior: float, steps: int, rate: float, threshold: float) -> tuple[np.ndarray, float]:
    """Adam with a soft threshold on the non-negative risk; weights and bias."""
    n = len(positive)
    w, bias = np.zeros(d), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    n_pos, n_un = positive.sum(), (~positive).sum()
    for t in range(1, steps + 1):
        z = np.bincount(row, times * w[col], minlength=n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        soft = np.logaddexp(0, z)  # logistic loss of label 0
        bracket = soft[~positive].mean() - prior * soft[positive].mean()
        slope = np.where(positive, -prior * p / n_pos, p / n_un)  # of the bracket
        slope = -slope if bracket < 0 else slope + np.where(positive, prior * (p - 1) / n_pos, 0)
        g, gb = np.bincount(col, times * slope[row], minlength=d), slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        scale = np.sqrt(v) + 1e-8
        w -= step * m / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * threshold / scale)
        bias -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def _share(wanted: int, have: int):
    """Condition that keeps about ``wanted`` of ``have`` rows, evenly by a hash of the id."""
    part = min(1.0, wanted / max(1, have))
    return F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("doc_id")), 33) <= int(part * 0x7FFFFFFF)


def _packed(features):
    """array<int> as big-endian bytes."""
    return F.unhex(F.array_join(F.transform(features, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on the rows given: the caller leaves held-out rows out of both tables."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("label is not null")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, total = counts.get(1, 0), sum(counts.values())
    if not toxic:
        return fit([], np.zeros(0, bool), 0.5)
    prior = min(0.95, max(1e-4, toxic / total))
    positives = known.filter("label = 1").filter(_share(max_positive, toxic)).select("doc_id").distinct()
    sample = own.join(positives.hint("broadcast"), "doc_id", "left_semi").withColumn("positive", F.lit(True))  # max_positive ids
    n = own.count()
    others = own.filter(_share(max_unlabelled, n)).withColumn("positive", F.lit(False))
    rows, positive = [], []
    got = features(sample.unionByName(others)).select(_packed(F.col("features")).alias("features"), "positive")
    for r in got.toLocalIterator(prefetchPartitions=True):  # about max_positive + max_unlabelled rows, a partition at a time
        rows.append(np.frombuffer(r.features, ">i4").astype(np.int32))
        positive.append(r.positive)
    return fit(rows, np.array(positive, bool), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds double ``score``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    def work():
        import pyarrow as pa

        index, weight, bias = shared.value
        table = dict(zip(index.tolist(), weight.tolist(), strict=True))
        memo: dict[str, float] = {}

        def apply(column):
            if len(memo) > MEMO:
                memo.clear()
            out = []
            for text in column.to_pylist():
                own = words(text)
                for w in own.difference(memo):
                    memo[w] = sum(table.get(f, 0.0) for f in word_features(w))
                out.append(bias + sum(map(memo.__getitem__, sorted(own))))
            return [pa.array(1 / (1 + np.exp(-np.clip(np.array(out), -40, 40))))]

        return apply

    return append_arrow(docs, text_col, [T.StructField("score", T.DoubleType())], work)
