"""Quality classifier: naive Bayes features for a linear support vector machine.

A text is the set of its word n-grams (1 and 2), word-shape n-grams (1 to 3) and n-grams of which
near words are equal, hashed. Each indicator
is scaled by the log ratio of its class counts; a linear model with hinge loss is fitted on
the scaled, length-normalized indicators by dual coordinate descent, and a sigmoid, fitted on labelled rows that
the model didn't see, turns margins into scores.

Only a bounded sample of labelled rows reaches the driver, as hashed features. Scoring reads whole
texts in one Arrow pass with two arrays of ``DIMS`` numbers; nothing is shuffled.

Defined results: null, empty and blank texts have no features and score by the bias alone; without rows of both
classes every score is the share of label 1 (0.5 without labels); conflicting labels drop a document; repeated rows count
once in training and get equal scores; whole texts are read, however long; an empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfacet.llm.common import mix64, sliced, word_hashes

BITS = 18
DIMS = 1 << BITS
LAGS = 4
ODD = np.uint64(0x9E3779B97F4A7C15)
SALTS = [np.uint64(k * int(ODD) % (1 << 64)) for k in (6, 7)]
RUNS = re.compile(rb"(.)\1+", re.S)
_letters = bytes(range(256))
SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else ord("a") if 97 <= c <= 122 or c >= 128 else c for c in range(256)
)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers, under ``DIMS``, of a whole text."""
    if not text:
        return np.empty(0, np.int64)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.int64)
    shapes = RUNS.sub(rb"\1", raw.translate(SHAPE)).split()
    h = word_hashes(words)
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(s, len(known)) for s in shapes), np.int64, len(shapes))
    g = word_hashes(list(known))[number]
    parts = [mix64(h + np.uint64(1)), mix64(h[:-1] * ODD + h[1:] + np.uint64(2)), mix64(g + np.uint64(3))]
    if len(g) > 1:
        two = np.unique(g[:-1] * ODD + g[1:])
        parts.append(mix64(two + np.uint64(4)))
    if len(g) > 2:
        three = np.unique((g[:-2] * ODD + g[1:-1]) * ODD + g[2:])
        parts.append(mix64(three + np.uint64(5)))
    # Which of the next words a word equals: n-grams of these patterns show loops in any vocabulary.
    same = np.zeros(len(h), np.uint64)
    for lag in range(1, 1 + min(LAGS, len(h) - 1)):
        same[:-lag] |= (h[:-lag] == h[lag:]).astype(np.uint64) << np.uint64(lag)
    parts.append(mix64(np.unique(same) + SALTS[0]))
    parts.append(mix64(np.unique(same[:-1] << np.uint64(8) | same[1:]) + SALTS[1]))
    found = np.zeros(DIMS, bool)
    found[(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(found)


@dataclass(frozen=True)
class Model:
    """``weight`` and ``scale2`` (squared log ratio) of each feature, bias and sigmoid."""

    weight: np.ndarray
    scale2: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        if not len(f):
            return self.bias
        return float(self.weight[f].sum() / np.sqrt(max(self.scale2[f].sum(), 1e-12))) + self.bias

    def score(self, f: np.ndarray) -> float:
        z = min(max(self.slope * self.margin(f) + self.shift, -40.0), 40.0)
        return 1.0 / (1.0 + np.exp(-z))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) with p, q the smoothed indicator counts of the classes."""
    p, q = np.full(DIMS, alpha), np.full(DIMS, alpha)
    for f, label in zip(rows, y):
        (p if label else q)[f] += 1
    # Shares of documents: both classes on one scale however many rows each has.
    return np.log(p / (y.sum() + 2 * alpha)) - np.log(q / ((~y).sum() + 2 * alpha))


def dual_coordinate_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 20, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights for x = r on the row's features, scaled to length 1, and bias.

    Each class weighs the same in total.
    """
    sign = np.where(y, 1.0, -1.0)
    share = {1.0: len(y) / (2 * max(1, y.sum())), -1.0: len(y) / (2 * max(1, (~y).sum()))}
    values = [r[f] / max(np.sqrt((r[f] ** 2).sum()), 1e-6) for f in rows]
    w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            f, x, s = rows[i], values[i], sign[i]
            slope = s * (w[f] @ x + bias) - 1.0
            most, old = cost * share[s], alpha[i]
            new = min(max(old - slope / 2.0, 0.0), most)  # |x|^2 + 1 for the bias
            step = new - old
            if step:
                alpha[i] = new
                w[f] += step * s * x
                bias += step * s
                worst = max(worst, abs(step))
        if worst < tolerance:
            break
    return w, bias


def sigmoid_of(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton's method with smoothed targets."""
    hi, lo = (y.sum() + 1.0) / (y.sum() + 2.0), 1.0 / ((~y).sum() + 2.0)
    target, x = np.where(y, hi, lo), np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, **how) -> Model:
    """A model from hashed rows and labels; every fifth row only sets the sigmoid."""
    if len(y) < 10 or y.all() or not y.any():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    train = [f for f, h in zip(rows, held) if not h]
    r = log_ratios(train, y[~held])
    w, bias = dual_coordinate_descent(train, r, y[~held], **how)
    model = Model(w * r, r**2, bias, 1.0, 0.0)
    which = held if held.any() else ~held
    margins = np.array([model.margin(f) for f, h in zip(rows, which) if h])
    slope, shift = sigmoid_of(margins, y[which])
    return Model((w * r).astype(np.float32), (r**2).astype(np.float32), bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the ``sample`` labelled documents of the lowest hash of the id (all of fewer)."""
    agreed = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).filter("lo = hi")
        .select("_id", F.col("lo").alias("_y"), F.xxhash64("_id").alias("_h")).orderBy("_h", "_id").limit(sample)
    )
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches):
        for b in sliced(batches):
            f = [features(t).astype(np.int32).tobytes() for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), b.column("_h"), pa.array(f, pa.binary())], names=["_id", "_y", "_h", "f"])

    # The broadcast side has at most ``sample`` rows.
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(agreed), "_id")
    y_type = agreed.schema["_y"].dataType.simpleString()
    rows = picked.select("_id", "_y", "_h", "_text").mapInArrow(hashed, f"_id {id_type}, _y {y_type}, _h long, f binary").dropDuplicates(["_id"]).collect()
    rows.sort(key=lambda x: (x["_h"], x["_id"]))
    return fit([np.frombuffer(x["f"], np.int32) for x in rows], np.array([x["_y"] == 1 for x in rows], bool))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches):
        own = shared.value
        for b in sliced(batches):
            scores = [own.score(features(t)) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    return docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, schema)
