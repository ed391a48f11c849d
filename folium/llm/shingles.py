"""All pairs of shingle sets above an exact similarity, by prefix filtering.

A set is the distinct shingles of ``words`` words of the lower-cased text (A-Z
only; a shorter text is one shingle, no words: the empty set). Sets stand in
one global order: shingles seen often in a sample last, then by hash. Two sets
whose Jaccard similarity is ``num / den`` or more share one of their first
``n - ceil(n * num / den) + 1`` shingles whatever the order is, so the sample
only makes lists short and never loses a pair. Of the smaller set the first
``n - ceil(n * 2 num / (num + den)) + 1`` are enough.

Candidates come from lists of the sets that share such a shingle. Positions,
sizes, and some bits of each set (every bit that differs stands for a shingle
that only one set has) discard pairs; what stays is verified by the exact sets,
each set's nearest pair first, so that pairs inside a group need no check.

Every set also has its SimHash fingerprint. Pairs that a search of fingerprints
proposes are verified first; lists are then compared only for what these leave
apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import LOWER, MULTIPLIER, SpanHasher, column_bytes, in_share, mix, schema_with, slices, stored, word_spans

#: Rows whose shingles are counted to find the frequent ones, and how many of those are kept.
SAMPLE_ROWS, FREQUENT = 20_000, 200_000
#: Text bytes hashed at a time.
CHUNK = 1 << 19
#: Lists longer than this are dealt to tiles, each compared with each.
TILE_ROWS = 4_096
#: Bits for each shingle of a set, at least; their number is a power of two.
BITS = 4
#: Rows of a side that may be broadcast; beyond that it is shuffled.
BROADCAST_ROWS = 200_000


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of rows: number of rows, then row (from 0) and hash of every distinct shingle, in that order."""
    data, offsets = column_bytes(column)
    hasher = SpanHasher()
    for a, b in slices(offsets, CHUNK):
        part, bounds = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = word_spans(part, bounds)
        each = hasher(part, starts, ends)
        count = np.bincount(row, minlength=b - a)
        first = np.cumsum(count) - count
        size = np.minimum(count, words)
        last = first + count - size  # the last start of a shingle in each row
        at = np.flatnonzero(np.arange(len(row)) <= last[row]) if len(row) else np.zeros(0, np.int64)
        width, total = size[row[at]] if len(at) else at, np.zeros(len(at), np.uint64)
        for k in range(words):
            more = np.flatnonzero(width > k)
            total[more] = mix(total[more] * MULTIPLIER + each[at[more] + k] + np.uint64(1))
        row = row[at]
        order = np.lexsort((total, row))
        row, total = row[order], total[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
        yield b - a, row[new], total[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.view(np.int64)))


def _frequent(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the shingles that stand in two or more sampled rows."""
    sample = docs.filter(in_share(F.xxhash64(F.col("key.a")), SAMPLE_ROWS / max(docs.count(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h in shingle_sets(batch.column(0), words):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    seen = sample.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = seen.filter("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = np.asarray(found.column("h")).astype(np.int64).view(np.uint64), np.asarray(found.column("n")).astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _majority(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each row's hashes (``row`` ascends, ``n`` hashes a row): bits set in over half of them; no hashes give 0."""
    ones = np.zeros((len(n), 64), np.int32)
    for at in range(0, len(h), 65_536):
        part, of = h[at : at + 65_536], row[at : at + 65_536]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ones[of[starts]] += np.add.reduceat(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)


def _longs_of_bits(n: np.ndarray) -> np.ndarray:
    """Longs for ``BITS`` bits or more a shingle; a power of two, so that halves can be laid over each other."""
    return 2 ** np.ceil(np.log2(np.maximum(n * BITS / 64, 1))).astype(np.int64)


def _differing(x: Column, y: Column) -> Column:
    """Bits that differ; the longer one (of twice the length, as sizes are close) is folded."""
    least = F.least(F.size(x), F.size(y))
    fold = lambda v: F.when(F.size(v) == least, v).otherwise(F.zip_with(F.slice(v, 1, least), F.slice(v, least + 1, least), lambda p, q: p.bitwiseOR(q)))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, d: acc + d)


def _prefixes(docs: DataFrame, doc_id: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """(id, key, set, n, fp, bits, first): the hash of each row's set, its size, its SimHash, its bits and the first shingles in the global order."""
    known, seen = _frequent(docs, text, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for rows, row, h in shingle_sets(batch.column(2), words):
                n = np.bincount(row, minlength=rows).astype(np.int64)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
                ends = np.cumsum(n)
                whole = mix(sums[ends] - sums[ends - n] + n.astype(np.uint64) * MULTIPLIER)
                longs = _longs_of_bits(n)
                place = (h >> np.uint64(32)).astype(np.int64) & (64 * longs[row] - 1)
                bits = np.zeros(64 * longs.sum(), np.uint8)
                bits[64 * (np.cumsum(longs) - longs)[row] + place] = 1
                bits = np.packbits(bits, bitorder="little").view(np.int64)
                prints = _majority(h, row, n)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = np.where(known[at] == h, seen[at], 0)
                    order = np.lexsort((often, row))  # stable: hashes ascend where the counts are equal
                    h = h[order]
                size = np.where(n > 0, n - (n * num + den - 1) // den + 1, 0)
                place = np.arange(len(h)) - np.repeat(ends - n, n)
                short = h[place < np.repeat(size, n)]
                columns = [batch.column(0).slice(done, rows), batch.column(1).slice(done, rows), pa.array(whole.view(np.int64)), pa.array(n), pa.array(prints), _lists(bits, longs), _lists(short, size)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "set", "n", "fp", "bits", "first"])
                done += rows

    source = docs.select(F.col(f"`{doc_id}`").alias("id"), "key", F.col(f"`{text}`").cast("string").alias("t"))
    long = T.LongType()
    return source.mapInArrow(run, schema_with(source.drop("t"), set=long, n=long, fp=long, bits=T.ArrayType(long), first=T.ArrayType(long)))


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(sid, h): all shingles of rows (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for rows, row, h in shingle_sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, rows), _lists(h, np.bincount(row, minlength=rows))], names=["sid", "h"])
                done += rows

    return docs.mapInArrow(run, "sid bigint, h array<bigint>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``parts``: the number of tiles a side that its list is dealt to."""
    hot = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > TILE_ROWS).select(key, F.ceil(F.col("c") / TILE_ROWS).cast("int").alias("parts")))
    count = hot.count()
    if not count:
        return rows.withColumn("parts", F.lit(1))
    return rows.join(_small(hot, count), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


class Search:
    """The distinct sets of a table of documents, and the exact checks of pairs of them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int, num: int, den: int) -> None:
        self.text, self.words, self.num, self.den = text, words, num, den
        self.docs = docs
        self.rows = stored(_prefixes(self.docs, doc_id, text, words, num, den))
        sets = self.rows.groupBy("set").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "fp", "bits", "first")])
        # equal texts and equal sets are one from here on; a small number stands for the hash of the set
        self.sets = stored(sets.withColumn("sid", F.monotonically_increasing_id()))

    def similar(self, x: str, y: str) -> Column:
        """Whether sizes and positions of two entries of a list leave their sets the chance to be similar enough."""
        at = lambda side, c: F.col(f"{side}.{c}")
        both = at(x, "n") + at(y, "n")
        rest = F.least(at(x, "n") - at(x, "pos"), at(y, "n") - at(y, "pos"))  # the shared shingles lie behind the first of them
        less = F.struct(at(x, "n"), at(x, "sid")) < F.struct(at(y, "n"), at(y, "sid"))
        indexed = F.when(less, at(x, "pos") < self.index(at(x, "n"))).otherwise(at(y, "pos") < self.index(at(y, "n")))
        return indexed & (rest * (self.num + self.den) >= both * self.num) & (F.least(at(x, "n"), at(y, "n")) * self.den >= F.greatest(at(x, "n"), at(y, "n")) * self.num)

    def index(self, n: Column) -> Column:
        """How many first shingles of the smaller set of a pair are enough."""
        return n - F.ceil(n * (2 * self.num) / (self.num + self.den)) + 1

    def near(self, pairs: DataFrame) -> DataFrame:
        """(a, b, differ): the distinct pairs whose bits leave them the chance to be similar enough."""
        pairs = stored(pairs.distinct())
        side = lambda name: known.select(F.col("sid").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        known = self.sets.select("sid", "n", "bits").join(_small(wanted, pairs.count() * 2), "sid")
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("differ", _differing(F.col("a_bits"), F.col("b_bits")))
        return stored(both.filter(F.col("differ") * (self.num + self.den) <= (F.col("a_n") + F.col("b_n")) * (self.den - self.num)).select("a", "b", "differ"))

    def one_each(self, near: DataFrame, *order: str) -> DataFrame:
        """The first pair (a, b) of every set in the given order."""
        best = near.select(F.explode(F.array("a", "b")).alias("sid"), F.struct(*order, "a", "b").alias("p")).groupBy("sid").agg(F.min("p").alias("p"))
        return stored(best.select("p.a", "p.b").distinct())

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Those of the (distinct) pairs whose exact similarity reaches the bound."""
        num, den = self.num, self.den
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        keys = stored(self.sets.select("sid", "key").join(_small(wanted, pairs.count() * 2), "sid"))
        chosen = self.docs.select("key", F.col(f"`{self.text}`").cast("string").alias("t")).join(_small(keys, keys.count()), "key")
        # wholly equal rows have one key: one of them is enough
        sets = stored(_full_sets(chosen.groupBy("sid").agg(F.first("t").alias("t")).select("sid", "t"), self.words))
        side = lambda name: sets.select(F.col("sid").alias(name), F.col("h").alias(f"{name}_h"))
        spread = _dealt(pairs, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        copies = spread.select("a", "salt").distinct().join(side("a"), "a")
        full = spread.join(side("b"), "b").join(copies, ["a", "salt"])
        common = F.size(F.array_intersect("a_h", "b_h"))
        return stored(full.filter(common * (num + den) >= (F.size("a_h") + F.size("b_h")) * num).select("a", "b"))


def near_sets(docs: DataFrame, doc_id: str, text: str, words: int, num: int, den: int, fingerprint_links, components) -> tuple[DataFrame, DataFrame]:
    """(id, key, set) of every row, and (set, root) of the sets that exact links of ``num / den`` or more connect; ``docs`` has a ``row_key`` as ``key``.

    ``fingerprint_links`` gives links (a, b) between the distinct fingerprints
    of a table (fp): sets of one fingerprint are paired with the first of them,
    the first ones along the links, and the exact sets decide. The rest is for
    the pairs that fingerprints leave apart.
    Sets that share a first shingle stand in one list. A star round links each
    with the nearest of the sets that lead its lists: the leader of a list has
    the fewest rarer shingles, so of copies with edits it is the one with the
    fewest, to which the others come nearest. A large group gathers at it with
    no more pairs than sets. Then the further pairs whose sets
    are not connected are compared: each set's nearest first, and at last all
    that are still not connected.
    """
    search = Search(docs, doc_id, text, words, num, den)
    entries = search.sets.select("sid", F.col("n").cast("int").alias("n"), F.posexplode("first").alias("pos", "h"))
    shared = entries.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("pos") < search.index(F.col("n"))).alias("i")).filter("c > 1 AND i > 0").select("h")
    hits = stored(entries.join(shared, "h").select("h", F.struct("sid", "n", "pos").alias("e")))

    def pair(df: DataFrame) -> DataFrame:
        return df.filter((F.col("x.sid") != F.col("y.sid")) & search.similar("x", "y")).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))

    def rooted(rows: DataFrame, roots: DataFrame, count: int, sid: Column) -> DataFrame:
        side = roots.select(F.col("node"), F.col("root"))
        return rows.join(_small(side, count), sid == F.col("node"), "left").withColumn("root", F.coalesce("root", sid)).drop("node")

    def connected(*found: DataFrame) -> DataFrame:
        """(node, root) of all pairs; earlier roots come in as pairs, so that a round goes on from them."""
        pairs = [f.select(F.col("node").alias("a"), F.col("root").alias("b")) if "root" in f.columns else f for f in found]
        return stored(components(reduce(DataFrame.unionByName, pairs)))

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        count = roots.count()
        both = rooted(rooted(pairs, roots, count, F.col("a")).withColumnRenamed("root", "a_root"), roots, count, F.col("b"))
        return stored(both.filter("a_root <> root").select("a", "b"))

    def apart_lists(hits: DataFrame, roots: DataFrame) -> DataFrame:
        """The lists whose sets aren't all connected yet, each entry with its root."""
        open_ = rooted(hits, roots, roots.count(), F.col("e.sid"))
        mixed = open_.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h")
        return stored(open_.join(mixed, "h"))

    prints = stored(search.sets.groupBy("fp").agg(F.min("sid").alias("lead")))
    same = search.sets.join(prints, "fp").filter("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    ends = fingerprint_links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    roots = connected(search.exact(stored(same.unionByName(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))))
    hits = apart_lists(hits, roots)
    # of the sets in a list the one with the fewest rarer shingles before is nearest to what they have in common
    leads = hits.groupBy("h").agg(F.min_by(F.struct("e", "root"), F.struct(F.col("e.pos") / F.col("e.n"), "e.n", "e.sid")).alias("y")).select("h", F.col("y.e").alias("y"), F.col("y.root").alias("root_y"))
    roots = connected(roots, search.exact(search.one_each(search.near(pair(hits.withColumnRenamed("e", "x").join(leads, "h").filter("root <> root_y"))), "differ")))
    dealt = _dealt(apart_lists(hits.drop("root"), roots), "h").withColumn("own", F.pmod(F.xxhash64("e.sid"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "e")
    x, y = tiles.withColumnRenamed("e", "x"), tiles.select("h", "i", "j", F.col("own").alias("own_y"), F.col("root").alias("root_y"), F.col("e").alias("y"))
    # in a tile of two parts only pairs across them: those inside a part have a tile of their own
    others = x.join(y, ["h", "i", "j"]).filter((F.col("x.sid") < F.col("y.sid")) & (F.col("root") != F.col("root_y")) & ((F.col("i") == F.col("j")) | (F.col("own") != F.col("own_y"))))
    near = search.near(pair(others))
    first = search.one_each(near, "differ")
    roots = connected(roots, search.exact(first))
    roots = connected(roots, search.exact(apart(near.select("a", "b").join(first, ["a", "b"], "left_anti"), roots)))
    of = roots.join(search.sets.select(F.col("sid").alias("node"), "set"), "node")
    return search.rows.select("id", "key", "set"), of.select("set", "root")
