"""Pairs of names that stand in a unit together: their number of units and the first few of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.sources.shared import stored

#: Blocks of names at least: a unit goes to each two of them, with its names in them.
BLOCKS = 4
#: Names of a strip, a part of a block, at most: a task counts the pairs of two strips at once, in a table of the square of a strip.
STRIP = 1_536
#: Mentions that a task holds, about; with more there are more blocks.
HELD = 5 << 24
#: Pairs, and rows of the result, that a task makes at once.
PAIRS = 1 << 20
ROWS = 1 << 16
#: Shares in which names are numbered.
SHARES = 64
LAST = np.iinfo(np.int64).max


def numbered(rows: DataFrame, key: str, number: str = "id") -> DataFrame:
    """``rows`` with an int that counts them from 0, in no particular order; ``key`` tells them apart."""
    dealt = rows.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(SHARES)))
    sizes = dealt.groupBy("__s").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("__s", (F.sum("c").over(Window.orderBy("__s")) - F.col("c")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__s").orderBy(key))
    return dealt.withColumn("__r", inside).join(F.broadcast(before), "__s").withColumn(number, (F.col("__before") + F.col("__r") - 1).cast("int")).drop("__s", "__r", "__before")


class Counts:
    """Of each pair of two strips its number of units, and the ``evidence`` least units in order."""

    def __init__(self, strip: int, evidence: int) -> None:
        self.n, self.first = np.zeros(strip * strip, np.int64), np.full((strip * strip, evidence), LAST)

    def add(self, code: np.ndarray, unit: np.ndarray) -> None:
        """Units of pairs; each comes once."""
        self.n += np.bincount(code, minlength=len(self.n))
        early = unit < self.first[code, -1]
        code, unit = code[early], unit[early]
        if not len(code):
            return
        order = np.lexsort((unit, code))
        code, unit = code[order], unit[order]
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        sizes = np.diff(np.append(starts, len(code)))
        place = np.arange(len(code)) - np.repeat(starts, sizes)
        kept = place < self.first.shape[1]
        new = np.full((len(starts), self.first.shape[1]), LAST)
        new[np.repeat(np.arange(len(starts)), sizes)[kept], place[kept]] = unit[kept]
        at = code[starts]
        self.first[at] = np.sort(np.concatenate((self.first[at], new), axis=1), axis=1)[:, : self.first.shape[1]]


class Mentions:
    """(row, name) of a strip, rows in ascending order."""

    def __init__(self) -> None:
        self.row, self.name = [], []

    def add(self, row: np.ndarray, name: np.ndarray) -> None:
        self.row.append(row.astype(np.int32))
        self.name.append(name.astype(np.int16))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.int32), *self.row]), np.concatenate([np.zeros(0, np.int16), *self.name]).astype(np.int64)


def _products(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, x, y) for each name of ``left`` and ``right`` in one row, about ``most`` at once."""
    (x_row, x), y = left, right[1]
    width = np.bincount(right[0], minlength=rows)
    start, times = (np.cumsum(width) - width)[x_row], width[x_row]
    ends = np.cumsum(times)
    at = 0
    while at < len(x):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        t = times[at:stop]
        skip = start[at:stop] - (np.cumsum(t) - t)
        yield np.repeat(x_row[at:stop], t), np.repeat(x[at:stop], t), y[np.arange(t.sum()) + np.repeat(skip, t)]
        at = stop


def _cell(strips: int, strip: int, blocks: int, evidence: int, most: int, slice_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the pairs of one cell, two blocks ``g`` and ``h`` of names or one with itself; at most ``slice_`` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, rows, g, h = [], 0, 0, 0
        held = [[Mentions() for _ in range(strips)] for _ in range(2)]
        for batch in batches:
            if not batch.num_rows:
                continue
            g, h, names = batch.column("g")[0].as_py(), batch.column("h")[0].as_py(), batch.column("names")
            units.append(batch.column("unit").to_numpy().copy())
            row = np.repeat(np.arange(rows, rows + len(names)), names.value_lengths().to_numpy())
            ids = names.flatten().to_numpy().astype(np.int64)
            for side, block in enumerate((g, h) if g != h else (g,)):
                mine = np.flatnonzero(ids % blocks == block)
                r, place = row[mine], ids[mine] // blocks
                for i in range(strips):
                    here = place // strip == i
                    held[side][i].add(r[here], place[here] % strip)
            rows += len(names)
        if not rows:
            return
        unit, right = np.concatenate(units), held[g != h]
        for i in range(strips):
            x_side = held[0][i].whole()
            for j in range(i if g == h else 0, strips):
                counts = Counts(strip, evidence)
                for r, x, y in _products(x_side, right[j].whole(), rows, most):
                    if g == h and i == j:
                        once = x < y
                        r, x, y = r[once], x[once], y[once]
                    counts.add(x * strip + y, unit[r])
                found = np.flatnonzero(counts.n)
                for start in range(0, len(found), slice_):
                    at = found[start : start + slice_]
                    n, first = counts.n[at], counts.first[at]
                    size = np.minimum(n, evidence)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(first[np.arange(evidence) < size[:, None]]))
                    ids = [pa.array(((k * strip + place) * blocks + block).astype(np.int32)) for k, place, block in ((i, at // strip, g), (j, at % strip, h))]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(n), lists], names=["x", "y", "n", "evidence"])

    return run


def _blocks(mentions: int) -> int:
    return max(BLOCKS, -(-2 * mentions // HELD))


def by_cells(lists: DataFrame, names: int, mentions: int, evidence: int) -> DataFrame:
    """``counted_pairs`` without a row for each pair and unit: a unit goes to each cell, two blocks of names, with those of its names that are in them.

    A name goes to as many cells as there are blocks, which is what is shuffled
    for a mention. A task holds its cell's mentions as numbers, and the table of
    two strips.
    """
    blocks = _blocks(mentions)
    last = F.lit(blocks - 1)
    strips = -(-names // (blocks * STRIP)) or 1
    strip = -(-names // (blocks * strips)) or 1
    ids = F.col("names").cast("array<smallint>" if names < 1 << 15 else "array<int>")
    split = lists.select(F.col("unit").cast("bigint").alias("unit"), F.transform(F.sequence(F.lit(0), last), lambda g: F.filter(ids, lambda x: x % blocks == g)).alias("of"))
    pairs = split.withColumn("g", F.explode(F.sequence(F.lit(0), last))).withColumn("h", F.explode(F.sequence(F.col("g"), last)))
    of = lambda g: F.get("of", F.col(g))
    rows = pairs.select("unit", "g", "h", F.when(F.col("g") == F.col("h"), of("g")).otherwise(F.concat(of("g"), of("h"))).alias("names")).filter(F.size("names") > 1)
    cell = (F.col("g") * (2 * blocks - F.col("g") - 1) / 2 + F.col("h")).cast("int")
    counted = rows.repartitionById(blocks * (blocks + 1) // 2, cell).mapInArrow(_cell(strips, strip, blocks, evidence, PAIRS, ROWS), "x int, y int, n bigint, evidence array<bigint>")
    kind = T.ArrayType(lists.schema["unit"].dataType)
    return counted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n", F.col("evidence").cast(kind).alias("evidence"))


def by_rows(lists: DataFrame, evidence: int) -> DataFrame:
    """``counted_pairs`` by a row for each pair and unit."""
    names = lists.select("unit", F.sort_array("names").alias("names"))
    pairs = names.select("unit", F.posexplode("names").alias("i", "a"), "names").select("unit", "a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("unit"))
    refs = pairs.withColumn("r", rank).filter(F.col("r") <= evidence).groupBy("a", "b").agg(F.array_sort(F.collect_list("unit")).alias("evidence"))
    return counts.join(refs, ["a", "b"])


def counted_pairs(mentions: DataFrame, names: int, evidence: int) -> DataFrame:
    """(a, b, n, evidence) of mentions (unit, id), ids from 0 to ``names`` - 1 with ``a`` the lesser: the number of units that hold both, and the first few of them.

    Pairs are rows where there are few for a mention; else they are counted by
    blocks of names. Units that are no whole numbers always make rows.
    """
    lists = stored(mentions.groupBy("unit").agg(F.collect_set("id").alias("names")))
    size = F.size("names").cast("bigint")
    held, pairs = lists.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0.0))).first()
    whole = isinstance(lists.schema["unit"].dataType, T.IntegralType)
    return by_cells(lists, names, held, evidence) if whole and pairs > held * _blocks(held) else by_rows(lists, evidence)
