"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Wang and Manning (2012): each present n-gram counts with its log-count ratio
r, and a logistic regression is trained on the scaled features. Texts are
lower-cased, runs of whitespace become one space, and each end is padded with
a space, so that n-grams see word edges. N-grams are hashed to ``2**bits``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import MULTIPLIER, bounded_sample, schema_with

#: Bounds of the labelled sample that is fitted on the driver.
FIT_ROWS = 6_000
FIT_CHARS = 16_000_000
ORDERS = (3, 4, 5)
BITS = 20
#: Characters that are hashed at a time; n-grams run across the seams.
PIECE = 1 << 20


def _pieces(text: str) -> Iterator[np.ndarray]:
    padded = f" {' '.join(text.lower().split())} "
    overlap = max(ORDERS) - 1
    for at in range(0, max(len(padded) - overlap, 1), PIECE):
        part = padded[at : at + PIECE + overlap].encode("utf-32-le", "surrogatepass")
        yield np.frombuffer(part, np.uint32).astype(np.uint64)


def buckets(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole text, repeats included, piece by piece."""
    for codes in _pieces(text or ""):
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = codes[: len(codes) - n + 1].copy()
            for k in range(1, n):
                h *= MULTIPLIER
                h += codes[k : len(codes) - n + 1 + k]
            h += np.uint64(n)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            yield (h >> np.uint64(64 - bits)).astype(np.int64)


class Distinct:
    """Distinct values of bucket arrays without sorting: the last writer of a slot stands for it."""

    def __init__(self, bits: int) -> None:
        self.last = np.zeros(1 << bits, np.int32)
        self.seen = np.zeros(1 << bits, bool)

    def of(self, parts: list[np.ndarray]) -> np.ndarray:
        if not parts:
            return np.zeros(0, np.int64)
        if len(parts) > len(ORDERS):  # a long text: mark each piece
            for p in parts:
                self.seen[p] = True
            found = np.flatnonzero(self.seen)
            self.seen[found] = False
            return found
        all_ = np.concatenate(parts)
        at = np.arange(len(all_), dtype=np.int32)
        self.last[all_] = at
        return all_[self.last[all_] == at]


def _text_buckets(text: str | None, distinct: Distinct, bits: int) -> np.ndarray:
    parts: list[np.ndarray] = []
    for p in buckets(text, bits):
        parts.append(p)
        if len(parts) > 2 * len(ORDERS):  # bounded memory for very long texts
            parts = [*parts[len(ORDERS) + 1 :], distinct.of(parts[: len(ORDERS) + 1])]
    return distinct.of(parts)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    bits: int

    def score(self, text: str | None, distinct: Distinct) -> float:
        z = self.bias + float(self.weight[_text_buckets(text, distinct, self.bits)].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))


def fit(rows: list[tuple[str | None, int]], bits: int = BITS, alpha: float = 50.0, epochs: int = 5, l2: float = 3e-2, rate: float = 0.02) -> Model:
    """Train on (text, label) rows; n-grams of too few rows to tell noise from signal get no weight.

    Without rows of both labels the score is the (smoothed) share of label 1.
    """
    size, distinct = 1 << bits, Distinct(bits)
    y = np.array([int(label) for _, label in rows], np.float64)
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(prior / (1.0 - prior)))
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(size, np.float32), bias, bits)
    found = [_text_buckets(text, distinct, bits).astype(np.int32) for text, _ in rows]
    count = np.zeros((2, size))
    for idx, label in zip(found, y, strict=True):
        count[int(label), idx] += 1.0
    total = count.sum(axis=1)
    share = total / total.sum()
    r = np.log((count[1] + alpha * share[1]) / total[1]) - np.log((count[0] + alpha * share[0]) / total[0])
    r[count.sum(axis=0) < max(2, min(20, len(rows) // 130))] = 0.0
    beta, grad2 = np.zeros(size), np.full(size, 1e-2)
    bias2 = 1.0
    weight_of = np.where(y == 1, 0.5 / prior, 0.5 / (1.0 - prior)) ** 0.5
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(found)):
            idx = found[i]
            x = r[idx]
            z = bias + float(x @ beta[idx])
            g = weight_of[i] * (1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))) - y[i])
            step = g * x + l2 * beta[idx]
            grad2[idx] += step * step
            beta[idx] -= rate * step / np.sqrt(grad2[idx])
            bias2 += g * g
            bias -= rate * g / np.sqrt(bias2)
    return Model((r * beta).astype(np.float32), float(bias), bits)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Fit on a bounded, hash-chosen sample of ``labelled`` (rows with a null label are left out).

    One task fits, so the sample's texts and features stay out of the driver,
    which gets the weights. Without labelled rows the model is that of no rows.
    """
    usable = labelled.filter(F.col(label).isNotNull())
    sample = bounded_sample(usable, key, text, rows, chars).select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((tuple(row.values()) for batch in batches for row in batch.to_pylist()), key=lambda x: (x[0], x[1] or "", x[2]))
        model = fit([(t, y) for _, t, y in got])
        yield pa.RecordBatch.from_pydict({"weight": pa.array([model.weight.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64()), "bits": pa.array([model.bits], pa.int32())})

    made = sample.repartition(1).mapInArrow(run, "weight binary, bias double, bits int").first()
    return Model(np.frombuffer(made["weight"], np.float32), made["bias"], made["bits"]) if made else fit([])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``name`` in 0 to 1; null and empty texts are scored as an empty text.

    Every row comes back once, repeated rows included. A column of ``docs``
    that is called ``name`` already is replaced.
    """
    source = docs.drop(name)
    at = source.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        distinct = Distinct(model.bits)
        for batch in batches:
            values = [model.score(t.as_py(), distinct) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return source.mapInArrow(run, schema_with(source, **{name: T.DoubleType()}))
