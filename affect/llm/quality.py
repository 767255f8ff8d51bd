"""Quality classifier: Naive Bayes support vectors.

Features are indicators (a text has the n-gram or not) of character n-grams of
a text's *shape* (runs of letters by case, digits, other characters as they
are) and of its bytes, hashed into ``2**BITS`` columns, with a few indicators
of how often words and lines repeat.  Each column is scaled by the class
log-count ratio ``log((1+p)/|1+p|) - log((1+n)/|1+n|)``; a linear model with
squared-length rows is then fitted under hinge loss by dual coordinate descent
(one dual variable a row, box ``0..C``), and a logistic curve fitted on rows it
has not seen turns its margins into scores.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, the
smallest hashes of the id); every text is scored, whole.

Cases: a null text counts as empty; the empty text has the score that its
indicators (none but the bias) give; labels that are null, ids that are null
and labelled ids without a document are not learned from; several labels of an
id are each a row; with no labelled rows, or one class only, every score is the
share of label 1 (0.5 without rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affect.llm.common import arrow_column, fresh, utf8

SAMPLE = 4000
FOLDS = 5
THRESHOLD = 0.3
BITS = 18
C = 0.5
EPOCHS = 12
#: Lengths of the n-grams of the shape and of the raw bytes.
SHAPE_GRAMS = (1, 2, 3, 4, 5)
BYTE_GRAMS = (3,)

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
SHAPE[128:] = ord("a")
SHAPE[9:14] = 32


def held_out(doc_id: str | Column, folds: int = FOLDS) -> Column:
    """Rows of the fold that is never learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _bucket(x: float, steps: int = 10) -> int:
    return min(steps, int(x * steps))


def indicators(text: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct columns that ``text`` has."""
    size = np.uint64(1 << bits)
    parts = []
    raw = np.frombuffer(text, np.uint8)
    shape = SHAPE[raw]
    if len(shape) > 1:  # a run of letters of one kind counts as two at most
        same = np.concatenate([[False, False], (shape[2:] == shape[1:-1]) & (shape[1:-1] == shape[:-2])])
        shape = shape[~(same & ((shape == 97) | (shape == 65) | (shape == 48)))]
    for kind, codes, lengths in ((1, shape, SHAPE_GRAMS), (2, raw, BYTE_GRAMS)):
        for n in lengths:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, kind * 31 + n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + codes[j:j + m]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            parts.append((h >> np.uint64(32)) % size)
    words = text.split()
    if words:
        lines = [x for x in text.split(b"\n") if x]
        lower = [w.lower() for w in words]
        facts = [
            ("distinct words", _bucket(len(set(lower)) / len(words), 20)),
            ("word repeats the last", _bucket(sum(a == b for a, b in zip(lower, lower[1:])) / len(words), 20)),
            ("distinct lines", _bucket(len(set(lines)) / max(1, len(lines)))),
            ("words of one byte", _bucket(sum(len(w) == 1 for w in words) / len(words))),
            ("words in capitals", _bucket(sum(w.isupper() and len(w) > 1 for w in words) / len(words))),
            ("letters", _bucket(float(np.mean((SHAPE[raw] == 97) | (SHAPE[raw] == 65))), 20)),
            ("length", int(np.log2(len(words)))),
        ]
        seeds = [sum(ord(c) * 131 ** i for i, c in enumerate(f"{k}={v}")) % (1 << 61) for k, v in facts]
        parts.append((np.array(seeds, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % size)
    if not parts:
        return np.zeros(0, np.int32)
    cols = np.concatenate(parts).astype(np.int32)
    seen = np.zeros(1 << bits, bool)
    seen[cols] = True
    return np.flatnonzero(seen).astype(np.int32)


class Model:
    """Weights of the columns with the ratios already in them, bias, and the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float, constant: float | None = None):
        self.weights, self.bias, self.slope, self.shift, self.constant = weights, bias, slope, shift, constant

    def margin(self, cols: np.ndarray) -> float:
        return float(self.weights[cols].sum() / np.sqrt(len(cols) + 1.0) + self.bias)

    def score(self, cols: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(cols) + self.shift, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, bits: int) -> np.ndarray:
    p, n = np.ones(1 << bits), np.ones(1 << bits)
    for cols, label in zip(rows, y):
        (p if label else n)[cols] += 1
    return np.log(p / p.sum()) - np.log(n / n.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = C, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 penalty: for one row at a time the exact minimum over its dual variable.  Classes weigh alike."""
    sign = np.where(y, 1.0, -1.0)
    values = [ratio[cols] / np.sqrt(len(cols) + 1.0) for cols in rows]
    upper = np.where(y, c * len(y) / (2 * max(1, y.sum())), c * len(y) / (2 * max(1, (~y).sum())))
    norm = np.array([v @ v + 1.0 for v in values])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            if step := (new - alpha[i]) * sign[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratio, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood (Newton's method, smoothed targets)."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
    target, a, b = np.where(y, hi, lo), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return max(a, 1e-3), b


def fit(texts: list[bytes], labels: list[int], bits: int = BITS) -> Model:
    """A model of ``labels`` (0 or 1); every fifth row only serves the logistic curve."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(1), 0.0, 1.0, 0.0, float(y.mean()) if len(y) else 0.5)
    rows = [indicators(t, bits) for t in texts]
    part = np.arange(len(y)) % 5 == 4
    if not (y[part].any() and (~y[part]).any() and y[~part].any() and (~y[~part]).any()):
        part = np.zeros(len(y), bool)  # too few rows to spare any
    known = np.flatnonzero(~part)
    ratio = log_count_ratio([rows[i] for i in known], y[known], bits)
    weights, bias = dual_coordinate_descent([rows[i] for i in known], y[known], ratio)
    model = Model(weights.astype(np.float32), bias, 1.0, 0.0)
    curve = np.flatnonzero(part) if part.any() else known
    model.slope, model.shift = logistic(np.array([model.margin(rows[i]) for i in curve]), y[curve])
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold: those
    of the smallest id hashes, whose ids (bounded by ``sample``) are broadcast."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id, folds))
    chosen = known.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = (docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
            .join(F.broadcast(chosen), "id").select("id", "label", "text").collect())
    rows.sort(key=lambda r: (r["id"], r["label"], bytes(r["text"])))
    order = np.random.default_rng(0).permutation(len(rows))
    return fit([bytes(rows[i]["text"]) for i in order], [rows[i]["label"] for i in order])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of every text, 0 to 1, in ``into`` (made longer if taken).  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(indicators(t)) for t in utf8(texts)], pa.float64())

    return docs.withColumn(fresh(into, docs), arrow_column(run, "double", text))
