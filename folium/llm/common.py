"""Small helpers shared by the operators of this subpackage.

The array helpers read an Arrow string column as one flat byte array plus
offsets, so that tokenising costs a few numpy passes over whole batches.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The whitespace of every word contract here: space, and tab to carriage return.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a folder of this machine serves in local mode alone;
    on a cluster that is an error, as executors don't share such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "folium-checkpoints", context.applicationId)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lost executors cost nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut`` for large tables: compressed Parquet in the shared folder, removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def schema_with(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in added.items())])


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't use (compared as Spark resolves names, without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys count as the text ''."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def words_of(text: Column) -> Column:
    """Whitespace-separated words as an array; null and blank text give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and int64 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    spans = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[spans[0] : spans[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, spans - spans[0]


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` each; a longer row makes a range of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it belongs to."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    edge = edge[:-1]
    begin = ~gap
    begin[1:] &= gap[:-1] | edge[1:]
    last = ~gap
    last[:-1] &= gap[1:] | edge[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class SpanHasher:
    """64-bit polynomial hashes of many byte spans, mixed at the end.

    Spans ascend and don't overlap. Prefix sums are made for ``BLOCK`` bytes at
    a time, so memory doesn't grow with the text.
    """

    BLOCK = 1 << 18

    def __init__(self) -> None:
        up, down = np.full(self.BLOCK + 1, MULTIPLIER), np.full(self.BLOCK + 1, INVERSE)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of byte times power, the first byte of each span at power 0."""
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * self.down[starts]

    def _long(self, data: np.ndarray) -> int:
        """The sum of one span of any length."""
        total = 0
        for at in range(0, len(data), self.BLOCK):
            part = data[at : at + self.BLOCK]
            total += int(self._block(part, np.array([0]), np.array([len(part)]))[0]) * pow(int(MULTIPLIER), at, 1 << 64)
        return total % (1 << 64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(starts), np.uint64), 0
        while at < len(starts):
            low = int(starts[at])
            stop = int(np.searchsorted(ends, low + self.BLOCK, "right"))
            if stop == at:
                out[at] = self._long(data[low : ends[at]])
                at += 1
                continue
            out[at:stop] = self._block(data[low : ends[stop - 1]], starts[at:stop] - low, ends[at:stop] - low)
            at = stop
        return mix(out + (ends - starts).astype(np.uint64))


def in_share(hashed: Column, share: float) -> Column:
    """Whether a row's 64-bit hash falls into a share of all; the grid of 2 ** 53 steps stays fine at any table size."""
    return F.pmod(hashed, F.lit(1 << 53)) < F.lit(min(1 << 53, max(1, int(share * (1 << 53)))))


def bounded_sample(labelled: DataFrame, key: str, text: str, rows: int, chars: int) -> DataFrame:
    """About ``rows`` rows and ``chars`` characters at most, chosen by the hash of the key and text.

    The share kept follows from two counts over the whole table, so the bound
    holds (in expectation) for any input, and the same rows come out each time.
    """
    n, total = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return labelled.filter(in_share(F.xxhash64(F.col(key), F.col(text)), min(1.0, rows / max(n, 1), chars / max(total, 1))))


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(key, text, label) of about ``rows`` labelled rows at most, chosen by the hash of the key.

    The choice is made on the labels alone, so what is broadcast is bounded by
    ``rows`` however large the tables are, and texts are never shuffled. Rows
    with a null label are left out.
    """
    usable = labels.select(key, label).filter(F.col(label).isNotNull())
    chosen = usable.filter(in_share(F.xxhash64(key), rows / max(usable.count(), 1)))
    return cut(docs.select(key, text).join(F.broadcast(chosen), key))


def row_key(df: DataFrame) -> Column:
    """128 bits that tell rows apart by all their columns; maps count by their entries."""

    def plain(c: str, kind: T.DataType) -> Column:
        return F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind.simpleString() else F.col(f"`{c}`")

    columns = [plain(f.name, f.dataType) for f in df.schema.fields]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
