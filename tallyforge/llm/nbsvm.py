"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

``fit`` draws a bounded sample of labelled documents (``max_train``, chosen by a hash of the id), turns each into the
set of its hashed n-grams, scales every indicator by the log ratio of its frequency in the two classes, and fits a
linear model with the hinge loss by dual coordinate descent. Margins become probabilities by a logistic curve fitted on
margins of documents that the model of the same fold had not seen. ``score`` is one pass over the texts without a shuffle.

Indicators: words and word pairs, runs of a repeated word, shapes of raw tokens (classes of their characters, letters
collapsed) in runs of one to three, and how large a share of words repeats the word before. Id, language, source and
label never enter.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.rolling import Words, mix, pieces, powers, text_buffer

DIM = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3


def _shapes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the shape of every token between white space; runs of one letter or digit class count once."""
    solid = ~_SPACE[buf]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < len(buf)]
    fresh[begins] = solid[begins]
    kind = _KIND[buf]
    keep = solid.copy()
    keep[1:] &= fresh[1:] | (kind[1:] != kind[:-1]) | (kind[1:] > 3)
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = fresh[at]
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - first[np.cumsum(new) - 1]
    terms = (kind[at].astype(np.uint64) + np.uint64(7)) * powers(np.uint64(0x2545F4914F6CDD1D), int(place.max()) + 1)[place]
    return mix(np.add.reduceat(terms, first)), np.searchsorted(offsets, at[first], side="right") - 1


def indicators(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted distinct keys text * DIM + feature of a piece of texts."""
    words = Words(buf, offsets)
    doc, h, n = words.doc(), words.hash, len(offsets) - 1
    parts = [(doc, h)]
    pair, at = words.grams(2)
    parts.append((doc[at], pair + np.uint64(1)))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = same.copy()
    again[1:] &= same[:-1]
    thrice = again.copy()
    thrice[1:] &= again[:-1]
    for k, flag in enumerate((same, again, thrice)):
        d = np.unique(doc[flag])
        parts.append((d, np.full(len(d), 11 + k, np.uint64)))
    share = np.bincount(doc[same], minlength=n) / np.maximum(words.count, 1)
    parts.append((np.arange(n), np.uint64(100) + np.minimum(np.ceil(share * 20), 10).astype(np.uint64)))
    shape, sdoc = _shapes(buf, offsets)
    two = shape.copy()
    for k in (1, 2, 3):
        if k > 1:
            if len(shape) < k:
                break
            m = len(shape) - k + 1
            two = mix(two[:m] * np.uint64(0x9E3779B97F4A7C15) + shape[k - 1:])
            ok = sdoc[:m] == sdoc[k - 1:]
            parts.append((sdoc[:m][ok], two[ok] + np.uint64(20 + k)))
        else:
            parts.append((sdoc, shape + np.uint64(20 + k)))
    keys = np.concatenate([d.astype(np.int64) * DIM + (mix(x) & np.uint64(DIM - 1)).astype(np.int64) for d, x in parts])
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


@dataclass
class Model:
    """Weights per feature (log-count ratio already multiplied in), bias, and the logistic curve of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def to_bytes(self) -> bytes:
        return struct.pack("<3d", self.bias, self.slope, self.shift) + self.weights.astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        return cls(np.frombuffer(raw, "<f4", offset=24), *struct.unpack("<3d", raw[:24]))

    def margins(self, keys: np.ndarray, n: int) -> np.ndarray:
        doc = keys // DIM
        size = np.bincount(doc, minlength=n)
        total = np.bincount(doc, weights=self.weights[keys & (DIM - 1)], minlength=n)
        return total / np.sqrt(np.maximum(size, 1)) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the smoothed share of each feature in class 1 over that in class 0."""
    counts = np.full((2, DIM), alpha)
    for c in (0, 1):
        mine = [r for r, v in zip(rows, y, strict=True) if v == c]
        if mine:
            counts[c] += np.bincount(np.concatenate(mine), minlength=DIM)
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; a row's values are the ratios of its features over the root of their number.

    The rarer class costs as much in all as the other. Returns (weights times ratio, bias).
    """
    sign = np.where(y == 1, 1.0, -1.0)
    ones = max(1, int((y == 1).sum()))
    upper = cost * np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * max(1, len(y) - ones)))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            r, v = rows[i], values[i]
            gradient = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w * ratio, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and shift of the probability by a margin: Newton steps on smoothed targets, halved while they do not help."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - target * z).sum() + ridge * a * a / 2)

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - target) * margin).sum() + ridge * a, (p - target).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(s * margin * margin).sum() + ridge, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step, now = np.linalg.solve(hess, g), loss(a, b)
        while np.abs(step).max() > 1e-9 and loss(a - step[0], b - step[1]) > now:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(rows: list[np.ndarray], y: np.ndarray, folds: int = 3) -> Model:
    """The model of feature rows and labels; with a single class every score is that class's smoothed share."""
    y = np.asarray(y)
    if len(y) == 0 or len(np.unique(y)) < 2:
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.empty(len(y), int)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        fold[at] = np.arange(len(at)) % folds
    margin = np.zeros(len(y))
    for k in range(folds):
        mine = np.flatnonzero(fold != k)
        part = [rows[i] for i in mine]
        ratio = log_ratios(part, y[mine])
        w, bias = descend(part, y[mine], ratio)
        for i in np.flatnonzero(fold == k):
            margin[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias
    a, b = logistic_curve(margin, y)
    w, bias = descend(rows, y, log_ratios(rows, y))
    return Model(w, bias, a, b)


def fit(docs: DataFrame, labels: DataFrame, label: str, max_train: int = 8000) -> Model:
    """Fit on at most ``max_train`` labelled documents, those of the smallest id hash.

    ``labels`` has doc_id and ``label`` (0 or 1; other values and nulls teach nothing). The ids of the sample are broadcast
    (their number is bounded by ``max_train``), so texts are not shuffled; the sample's features go to one task.
    """
    sample = (
        labels.select(F.col("doc_id").alias("train_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("train_id").isNotNull()).dropDuplicates(["train_id"])
        .orderBy(F.xxhash64("train_id"), "train_id").limit(max_train)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("train_id")).select("text", "y", "train_id")

    def features(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            y, ids = batch.column("y"), batch.column("train_id")
            for i, j, part, own in pieces(buf, offsets):
                keys = indicators(part, own)
                cut = np.searchsorted(keys, np.arange(j - i + 1) * DIM)
                rows = [(keys[a:b] & (DIM - 1)).astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), y.slice(i, j - i), ids.slice(i, j - i).cast(pa.int64())], ["features", "y", "train_id"])

    def learn(batches):
        got = [(i, r, y) for b in batches for i, r, y in zip(b.column("train_id").to_pylist(), b.column("features").to_pylist(), b.column("y").to_pylist(), strict=True)]
        got.sort()
        rows = [np.frombuffer(r, "<u4").astype(np.int32) for _, r, _ in got]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, np.array([y for _, _, y in got], int)).to_bytes()], pa.binary())], ["model"])

    rows = picked.mapInArrow(features, "features binary, y int, train_id long")
    raw = rows.repartition(1).mapInArrow(learn, "model binary").first()
    return Model.from_bytes(bytes(raw["model"])) if raw else train([], np.zeros(0, int))


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of class 1 of every whole text; null and empty texts are scored as texts without words.

    A column named ``out`` is replaced. One pass, no shuffle; repeated rows get equal scores.
    """
    docs = docs.drop(out)
    raw = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def add(batches):
        own = Model.from_bytes(raw.value)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            found = [own.probability(own.margins(indicators(part, cut), j - i)) for i, j, part, cut in pieces(buf, offsets)]
            values = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, out])

    return docs.mapInArrow(add, schema)
