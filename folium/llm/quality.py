"""Document quality: a byte-level convolutional network written in numpy.

Bytes are embedded, a layer of learned filters runs over every position of
overlapping chunks that cover the whole document (neighbours share
``WIDTH - 1`` bytes, so no position is missed), each filter is max-pooled
within its chunk, a dense layer maps the pooled vector to hidden units, and
the hidden units, averaged over the chunks, give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import bounded_sample, column_bytes, schema_with, slices

#: Bounds of the labelled sample that is fitted on the driver.
FIT_ROWS = 4_000
FIT_CHARS = 8_000_000
WIDTH, DIM, FILTERS, HIDDEN, CHUNK = 7, 8, 24, 16, 512
#: Filler byte before and after a text, so that even one byte fills the filters.
PAD = 0
#: Bytes that go through the filters at a time.
SLAB = 1 << 17


@dataclass
class Model:
    embed: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    dense: np.ndarray
    dense_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_b, self.dense, self.dense_b, self.out, self.out_b]


def initial(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(draw(256, DIM, scale=0.5), draw(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32), draw(FILTERS, HIDDEN, scale=FILTERS**-0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32))


def padded(data: np.ndarray) -> np.ndarray:
    edge = np.full(WIDTH // 2, PAD, np.uint8)
    return np.concatenate((edge, data, edge)) if len(data) else np.full(WIDTH, PAD, np.uint8)


def windows(data: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` embedded bytes for each position."""
    view = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    return embed[view].reshape(len(view), WIDTH * DIM)


def chunk_features(data: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled filter outputs of every chunk of one padded text, and the positions they come from."""
    n = len(data) - WIDTH + 1
    pooled, where = [], []
    for a in range(0, n, SLAB):
        b = min(a + SLAB, n)
        z = windows(data[a : b + WIDTH - 1], m.embed) @ m.conv
        full = (b - a) // CHUNK * CHUNK
        if full:
            blocks = z[:full].reshape(-1, CHUNK, FILTERS)
            at = blocks.argmax(axis=1)
            pooled.append(np.take_along_axis(blocks, at[:, None], 1)[:, 0])
            where.append(at + (a + np.arange(0, full, CHUNK))[:, None])
        if full < b - a:
            at = z[full:].argmax(axis=0)
            pooled.append(z[full:][at, np.arange(FILTERS)][None])
            where.append((at + a + full)[None])
    return np.concatenate(pooled), np.concatenate(where)


def max_pool(data: np.ndarray, m: Model) -> np.ndarray:
    """As ``chunk_features``, without positions: each filter tap adds a row of a byte table."""
    n = len(data) - WIDTH + 1
    taps = [m.embed @ m.conv[k * DIM : (k + 1) * DIM] for k in range(WIDTH)]
    pooled = []
    for a in range(0, n, SLAB):
        b = min(a + SLAB, n)
        z = np.take(taps[0], data[a:b], axis=0)
        for k in range(1, WIDTH):
            z += np.take(taps[k], data[a + k : b + k], axis=0)
        pooled.append(np.maximum.reduceat(z, np.arange(0, b - a, CHUNK), axis=0))
    return np.concatenate(pooled)


def head(pooled: np.ndarray, m: Model) -> np.ndarray:
    return np.maximum(np.maximum(pooled + m.conv_b, 0) @ m.dense + m.dense_b, 0)


def sigmoid(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))


def fit(rows: list[tuple[bytes, int]], epochs: int = 8, batch: int = 16, rate: float = 4e-3) -> Model:
    """Train by Adam; gradients pass the max-pool at its winning positions only.

    Rows of the rarer label weigh more (square root of the ratio). Without rows of both labels the
    output is the share of label 1.
    """
    m = initial()
    y = np.array([label for _, label in rows], np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    m.out_b[0] = np.log(prior / (1 - prior))
    if not 0 < y.sum() < len(y):
        m.out[:] = 0
        return m
    share = np.where(y == 1, prior, 1 - prior)
    row_weight = np.sqrt(0.5 / share)
    texts = [padded(np.frombuffer(t, np.uint8)) for t, _ in rows]
    params = m.arrays()
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, t = np.random.default_rng(3), 0
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            grads = [np.zeros_like(p) for p in params]
            for i in order[at : at + batch]:
                _gradient(texts[i], float(y[i]), float(row_weight[i]) / batch, m, grads)
            t += 1
            step = rate * (1 - 0.9 * t / total)
            for p, g, a, b in zip(params, grads, mean, var, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return m


def _gradient(data: np.ndarray, y: float, weight: float, m: Model, grads: list[np.ndarray]) -> None:
    pooled, where = chunk_features(data, m)
    c = np.maximum(pooled + m.conv_b, 0)
    h = np.maximum(c @ m.dense + m.dense_b, 0)
    g = weight * (sigmoid(float(h.mean(axis=0) @ m.out + m.out_b[0])) - y)
    grads[5] += g * h.mean(axis=0)
    grads[6] += g
    dh = (g / len(h)) * m.out * (h > 0)
    grads[3] += c.T @ dh
    grads[4] += dh.sum(axis=0)
    dc = (dh @ m.dense.T) * (c > 0)
    grads[2] += dc.sum(axis=0)
    rows, filters = np.nonzero(dc)
    if len(rows):
        taps = data[where[rows, filters][:, None] + np.arange(WIDTH)]
        x = m.embed[taps].reshape(len(rows), -1)
        d = dc[rows, filters][:, None]
        np.add.at(grads[1].T, filters, x * d)
        np.add.at(grads[0], taps, (m.conv.T[filters] * d).reshape(len(rows), WIDTH, DIM))


def predict(data: np.ndarray, m: Model) -> float:
    """Probability of label 1 for the bytes of one whole text."""
    return sigmoid(float(head(max_pool(padded(data), m), m).mean(axis=0) @ m.out + m.out_b[0]))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Fit on a bounded, hash-chosen sample of ``labelled`` (rows with a null label are left out)."""
    usable = labelled.filter(F.col(label).isNotNull())
    sample = bounded_sample(usable, key, text, rows, chars).select(text, F.col(label).cast("int"), F.xxhash64(key, text).alias("h"))
    got = sorted(((h, t or "", y) for t, y, h in sample.collect()))
    return fit([(t.encode("utf-8", "surrogatepass"), y) for _, t, y in got])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a double column ``name`` in 0 to 1; null and empty texts are scored as filler bytes alone.

    Every row comes back once, repeated rows included. A column of ``docs``
    that is called ``name`` already is replaced.
    """
    source = docs.drop(name)
    at = source.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            values = np.zeros(len(batch))
            for start, stop in slices(offsets, SLAB):
                values[start:stop] = _scores(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, name])

    return source.mapInArrow(run, schema_with(source, **{name: T.DoubleType()}))


def _scores(data: np.ndarray, offsets: np.ndarray, m: Model) -> list[float]:
    return [predict(data[a:b], m) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
