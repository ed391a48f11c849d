"""Exact nearest vectors by cosine: blocks of queries meet blocks of rows, each pair of blocks in a group of its own."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of rows; a task holds one of each.
QUERY_ROWS, BASE_ROWS = 4_096, 16_384
#: Queries and rows whose products are held at a time, and pairs that are worked out exactly at a time.
TILE_QUERIES, TILE_ROWS, PAIRS = 1_024, 2_048, 1 << 17
# Cosines are rounded to millionths; a product of normalised vectors is nearer to the cosine than the slack.
UNIT, SLACK = 1_000_000, 1e-9
#: Stands for a cosine that isn't a number, which comes before all others.
NO_NUMBER = np.iinfo(np.int64).max


def millionths(x: np.ndarray) -> np.ndarray:
    """Cosines in millionths, halves away from zero by their shortest decimal form, as Spark rounds."""
    y = np.abs(np.nan_to_num(x)) * UNIT
    n = np.floor(y + 0.5).astype(np.int64)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        n[i] = int((Decimal(repr(float(abs(x[i])))) * UNIT).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(x), NO_NUMBER, np.where(x < 0, -n, n))


class Side:
    """The vectors of a block: one array of coordinates each, lengths, and numbers of coordinates (``void`` where one is null)."""

    def __init__(self, vectors: pa.ChunkedArray, void: int) -> None:
        rows = vectors.to_pylist() if vectors.null_count or any(c.flatten().null_count for c in vectors.chunks) else None
        if rows is None:
            sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(np.asarray(c.offsets)) for c in vectors.chunks)]).astype(np.int64)
            flat = np.concatenate([np.zeros(0), *(np.asarray(c.flatten()) for c in vectors.chunks)]).astype(np.float64)
            self.size = sizes
        else:
            self.size = np.array([void if v is None or None in v else len(v) for v in rows], np.int64)
            sizes = np.maximum(self.size, 0)
            flat = np.array([x for v, n in zip(rows, self.size, strict=True) if n > 0 for x in v], np.float64)
        self.width = int(sizes.max(initial=0))
        self.x = np.zeros((self.width, len(sizes)))
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.x[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        with np.errstate(all="ignore"):
            total = np.zeros(len(sizes))
            for c in self.x:
                total += c * c
            self.length = np.sqrt(total)
            #: lengths that a product of normalised vectors is not to be trusted with
            self.odd = ~((self.length > 1e-100) & (self.length < 1e100)) & (self.length != 0) & (self.size >= 0)
            self.unit = np.where(self.odd | (self.length == 0), 0.0, self.x / self.length).T.copy()


def best_pairs(q: Side, b: Side, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and millionths of the best ``k`` rows of each query; rows stand by id, and ``own`` has the range of rows with the query's id.

    Products of normalised vectors leave out pairs that can't be among the
    best; what is left is summed coordinate by coordinate, as Spark would.
    """
    mixed = not (q.size.size and b.size.size and (q.size == q.size[0]).all() and (b.size == q.size[0]).all())
    width = min(q.width, b.width)

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        dot = np.zeros(len(r))
        with np.errstate(all="ignore"):
            for i in range(width):
                dot += q.x[i][r] * b.x[i][c]
            down = q.length[r] * b.length[c]
            out = np.where(down == 0, 0.0, dot / down)
        return np.where(q.size[r] == b.size[c], out, 0.0) if mixed else out

    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for top in range(0, len(q.size), TILE_QUERIES):
        rows = np.arange(top, min(top + TILE_QUERIES, len(q.size)))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # row of the tile, row of the block, millionths
        least = np.full(len(rows), -np.inf)  # the k-th best of each query so far
        for at in range(0, len(b.size), TILE_ROWS):
            stop = min(at + TILE_ROWS, len(b.size))
            near = q.unit[rows, :width] @ b.unit[at:stop, :width].T
            if mixed:
                near[q.size[rows][:, None] != b.size[None, at:stop]] = 0.0
            for i in np.flatnonzero(q.odd[rows]):
                near[i] = np.nan_to_num(exact(np.full(stop - at, rows[i]), np.arange(at, stop)), nan=np.inf)
            for j in np.flatnonzero(b.odd[at:stop]):
                near[:, j] = np.nan_to_num(exact(rows, np.full(len(rows), at + j)), nan=np.inf)
            first, last = own[0][rows], own[1][rows]
            for i in np.flatnonzero((first < stop) & (last > at) & (first < last)):
                near[i, max(first[i], at) - at : min(last[i], stop) - at] = -np.inf
            # a row behind others of the same millionths has the greater id, so it must be better than the k-th
            bound = least + 0.5 / UNIT - SLACK
            short = np.flatnonzero(np.isneginf(least))
            if len(short) and k < stop - at:
                bound[short] = np.partition(near[short], -k, axis=1)[:, -k] - 1.5 / UNIT
            r, c = np.nonzero((near >= bound[:, None]) & (near > -np.inf))
            for a in range(0, len(r), PAIRS):
                x, y = r[a : a + PAIRS], c[a : a + PAIRS] + at
                some = np.isin(best[0], x)
                pool = [np.concatenate(p) for p in zip((v[some] for v in best), (x, y, millionths(exact(rows[x], y))), strict=True)]
                order = np.lexsort((pool[1], -pool[2].astype(np.float64), pool[0]))
                pool = [v[order] for v in pool]
                starts = np.flatnonzero(np.concatenate(([True], pool[0][1:] != pool[0][:-1])))
                sizes = np.diff(np.concatenate((starts, [len(order)])))
                place = np.arange(len(order)) - np.repeat(starts, sizes)
                full = sizes >= k
                kth = pool[2][starts[full] + k - 1]
                least[pool[0][starts[full]]] = np.where(kth == NO_NUMBER, np.inf, kth / UNIT)
                best = tuple(np.concatenate((v[~some], p[place < k])) for v, p in zip(best, pool, strict=True))
        kept.append((rows[best[0]], best[1], best[2]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in kept)]) for i in range(3))


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        n = queries.num_rows
        ids = pa.concat_tables([queries.select(["id"]), base.select(["id"])]).column("id").to_numpy()
        code = np.unique(ids, return_inverse=True)[1]
        order = np.argsort(code[n:], kind="stable")
        sorted_code = code[n:][order]
        own = np.searchsorted(sorted_code, code[:n], "left"), np.searchsorted(sorted_code, code[:n], "right")
        r, c, v = best_pairs(Side(queries.column("v"), -1), Side(base.column("v").take(pa.array(order)), -2), own, k)
        cosine = np.where(v == NO_NUMBER, np.nan, v / UNIT)
        return pa.table([queries.column("id").take(pa.array(r)), base.column("id").take(pa.array(order[c])), pa.array(cosine)], names=["query", "neighbour", "cosine"])

    return run


def nearest_vectors(queries: DataFrame, base: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, neighbour, cosine, rank): exact top ``k`` of every query against all rows, itself excluded; ties go by id.

    Every query meets every row, so the work grows with queries times rows.
    Both sides are dealt by hash to blocks of bounded size; a task multiplies
    two blocks tile by tile and leaves the best ``k`` rows of each query in its
    block, of which the best are taken at last. Cosines are rounded to six
    places; vectors of different length, without length, or with a null have 0.
    """
    side = lambda df: df.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v"))
    q, b = side(queries), side(base)
    shares = -(-q.count() // QUERY_ROWS) or 1, -(-b.count() // BASE_ROWS) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("id", "v", block(shares[0]).alias("i"), every(shares[1]).alias("j"))
    right = b.select("id", "v", every(shares[0]).alias("i"), block(shares[1]).alias("j"))
    kind, other = q.schema["id"].dataType.simpleString(), b.schema["id"].dataType.simpleString()
    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_search(k), f"query {kind}, neighbour {other}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
