"""Near-duplicate groups by SimHash fingerprints and pivot distance tables.

Fingerprints: words of the lower-cased text (A-Z only), shingles of ``words``
words joined by one space (a shorter text is one shingle; no words: fingerprint
0), XXH64 with seed 42; a bit is set when it is set in over half the hashes.

Links: two fingerprints link when they differ in at most ``radius`` bits.
Distances to random references concentrate near 32, so a pivot table alone
discards too little to avoid comparing all pairs. Pairs are therefore formed
only inside bands: the 64 bits fall into ``b`` blocks, and two fingerprints
within the radius agree on at least ``b - radius`` whole blocks. Inside a band
the table of Hamming distances to many reference fingerprints discards every
pair with a coordinate that differs by more than the radius (the triangle
inequality), and exact distances verify the survivors. No pair within the
radius is lost at any step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm import shingles
from folium.llm.common import cut, free_name, row_key, schema_with, stored

SEED = 42
#: Bands larger than this are dealt to tiles, each compared with each.
TILE_ROWS = 16_384
#: Runs up to this length are compared in one vectorised sweep.
SHORT_RUN = 256
#: Rows of a side that may be broadcast; beyond that it is shuffled.
BROADCAST_ROWS = 400_000


def pivot_table(count: int, seed: int = 7) -> np.ndarray:
    """``count`` reference fingerprints, the same on every executor."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of one text, as an unsigned 64-bit integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(tokens) - k + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, keep: list[str], words: int, name: str) -> DataFrame:
    """``keep`` columns of every row plus its fingerprint as a signed bigint called ``name``."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = schema_with(source.drop("__text"), **{name: T.LongType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            values = [fingerprint(t.as_py(), words) for t in batch.column(at)]
            column = pa.array(np.array(values, np.uint64).view(np.int64))
            columns = [c for i, c in enumerate(batch.columns) if i != at] + [column]
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for n in batch.schema.names if n != "__text"), name])

    return source.mapInArrow(run, schema)


def band_plan(rows: int, radius: int, bits: int = 64) -> int:
    """Number of blocks with the least expected work for ``rows`` distinct fingerprints."""

    def work(blocks: int) -> float:
        tables, key_bits = comb(blocks, radius), bits * (blocks - radius) // blocks
        return tables * (rows * 50.0 + rows * float(rows) / 2.0**key_bits)

    return min(range(radius + 1, radius + 5), key=work)


def band_columns(blocks: int, radius: int, fp: str):
    """One (table, key) struct for each choice of blocks that may agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(table).alias("table"), F.col(fp).bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*out)


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.setdefault(root, root) != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def _short_runs(fp: np.ndarray, run: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs inside runs; rows come sorted by run and then by the first coordinate."""
    left, right = [], []
    first = table[0]
    at = np.arange(len(fp) - 1)
    lag = 1
    while len(at):
        at = at[at + lag < len(fp)]
        at = at[(run[at] == run[at + lag]) & (first[at + lag] - first[at] <= radius)]
        kept = at
        for coordinate in table[1:]:
            if not len(kept):
                break
            kept = kept[np.abs(coordinate[kept] - coordinate[kept + lag]) <= radius]
        kept = kept[np.bitwise_count(fp[kept] ^ fp[kept + lag]) <= radius]
        left.append(kept)
        right.append(kept + lag)
        lag += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _long_run(fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of one long run; rows come sorted by the first coordinate."""
    label, left, right = np.arange(len(fp)), [], []
    stops = np.searchsorted(table[0], table[0] + radius, "right")
    for i in range(len(fp) - 1):
        at = i + 1 + np.flatnonzero(label[i + 1 : stops[i]] != label[i])
        for coordinate in table[1:]:
            if not len(at):
                break
            at = at[np.abs(coordinate[at] - coordinate[i]) <= radius]
        at = at[np.bitwise_count(fp[at] ^ fp[i]) <= radius]
        if len(at):
            groups, first = np.unique(label[at], return_index=True)
            left += [i] * len(first)
            right += at[first].tolist()
            label[np.isin(label, groups)] = label[i]
    return left, right


def link_runs(fp: np.ndarray, run: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints of the same run (``run`` ascends)."""
    if not len(fp):
        return fp, fp
    table = np.bitwise_count(fp[None, :] ^ pivots[:, None]).astype(np.int16)
    order = np.lexsort((table[0], run))
    fp, run, table = fp[order], run[order], table[:, order]
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(fp)])))
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    where = np.flatnonzero(short)
    a, b = _short_runs(fp[where], run[where], table[:, where], radius)
    pairs = list(zip(where[a].tolist(), where[b].tolist(), strict=True))
    for s, n in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
        x, y = _long_run(fp[s : s + n], table[:, s : s + n], radius)
        pairs += zip([s + i for i in x], [s + i for i in y], strict=True)
    parent: dict[int, int] = {}
    values, kept = fp.tolist(), []
    for i, j in pairs:
        x, y = _find(parent, values[i]), _find(parent, values[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((values[i], values[j]))
    out = np.array(kept, np.uint64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def links(distinct: DataFrame, fp: str, radius: int, pivots: int = 24) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every group within ``radius`` bits.

    Bands of over ``TILE_ROWS`` rows are dealt by hash to g parts, and each
    pair of parts is a tile of its own, so no task holds an unbounded band.
    """
    rows = distinct.count()
    blocks = band_plan(rows, radius)
    banded = distinct.select(F.col(fp).alias("fp"), F.explode(band_columns(blocks, radius, fp)).alias("band")).select("fp", "band.*")
    hot = cut(banded.groupBy("table", "key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > TILE_ROWS).withColumn("parts", F.ceil(F.col("rows") / TILE_ROWS).cast("int")).drop("rows"))
    n_hot = hot.count()
    if n_hot:
        banded = banded.join(small(hot, n_hot), ["table", "key"], "left")
    else:
        banded = banded.withColumn("parts", F.lit(None).cast("int"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    tiles = (
        banded.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    dealt = tiles.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
    references = pivot_table(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_fp = np.zeros((4, 0), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
            fps = np.asarray(batch.column(4)).astype(np.int64).view(np.uint64)
            keys, fps = np.concatenate((held_keys, keys), axis=1), np.concatenate((held_fp, fps))
            if not len(fps):
                continue
            change = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            group = np.cumsum(change)
            done = int(np.searchsorted(group, group[-1]))  # the last run may go on in the next batch
            held_keys, held_fp = keys[:, done:], fps[done:]
            yield from emit(fps[:done], group[:done])
        yield from emit(held_fp, np.zeros(len(held_fp), np.int64))

    def emit(fps: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = link_runs(fps, group, references, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it is connected with.

    Alternates the large-star and small-star steps of Kiveris et al. (2014)
    until the edges stop changing. A node's least neighbour comes from a
    partial aggregate; where there are many edges it is written out, so that
    the join with it has plain exchanges on both sides, which are split at run
    time: a node with very many neighbours never gathers them in one task.
    """

    def least(pairs: DataFrame, rows: int) -> DataFrame:
        m = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return stored(m) if rows > BROADCAST_ROWS else m

    def large_star(now: DataFrame, rows: int) -> DataFrame:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both, 2 * rows)
        return both.filter(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))

    def small_star(now: DataFrame, rows: int) -> DataFrame:
        down = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = least(down, rows)
        return down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = state(now)
    while seen[0]:
        now = stored(small_star(large_star(now, seen[0]).filter("u <> v").distinct(), seen[0]).filter("u <> v").distinct())
        if (new := state(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, pivots: int = 24) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the least ``doc_id`` that links reach, the row's own
    included. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows come back repeated. A null ``doc_id`` keeps its row and is
    never a component id unless its whole group has null ids. An empty table
    gives an empty result; further columns are ignored whatever their names.
    """
    return _grouped(docs, [doc_id], doc_id, text, words, radius, pivots).select(
        F.col(f"`{doc_id}`"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), F.col("__component").alias("component_id")
    )


def _grouped(docs: DataFrame, keep: list[str], doc_id: str, text: str, words: int, radius: int, pivots: int) -> DataFrame:
    table = cut(fingerprints(docs, text, keep, words, "__fp"))
    distinct = cut(table.groupBy("__fp").agg(F.min(F.col(f"`{doc_id}`")).alias("__least")))
    nodes = cut(components(links(distinct.select("__fp"), "__fp", radius, pivots)))
    linked = distinct.join(nodes.withColumnRenamed("node", "__fp"), "__fp")
    least = cut(linked.groupBy("root").agg(F.min("__least").alias("__component")))
    # a large group has one row in ``least``: broadcast, or split at run time beyond the bound
    groups = nodes.join(small(least, least.count()), "root").select(F.col("node").alias("__fp"), "__component")
    classes = distinct.join(groups, "__fp", "left").select("__fp", F.coalesce("__component", "__least").alias("__component"))
    # both sides are plain exchanges, so a fingerprint of very many rows is split at run time
    return table.join(cut(classes), "__fp")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted size allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: tuple[int, int] = (4, 5), radius: int = 4, pivots: int = 24) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns unchanged.

    Rows link when the sets of their ``words``-word shingles have a Jaccard
    similarity of ``similarity`` (a fraction) or more. Candidates are first the
    SimHash fingerprints of the sets within ``radius`` bits (``links``), each
    verified by the exact sets; pairs of that similarity may differ in more
    bits, so those that are still apart are found by their shared shingles
    (see ``shingles``), and no pair is lost. The row with the least ``doc_id`` stays (null ids last; among
    rows that share it, the least hash of all columns; of wholly equal rows,
    one). Null and blank texts have the empty set and are one group. An empty
    table gives an empty result; texts are read whole and never shuffled while
    the rows to drop are few enough to be broadcast.
    """
    name = free_name(docs, "key")
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"), row_key(docs).alias("key"))
    table, nodes = shingles.near_sets(plain, "id", "t", words, *similarity, lambda prints: links(prints, "fp", radius, pivots), components)
    first = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("d"), F.col("key").alias("k")))
    sets = table.groupBy("set").agg(first.alias("w")).join(nodes, "set", "left")
    linked = F.col("root").isNotNull()
    winners = stored(sets.groupBy(linked, F.coalesce("root", "set")).agg(F.min("w").alias("w")).select(F.col("w.k").alias("key")))
    losers = stored(table.select("key").join(winners, "key", "left_anti").distinct())
    again = cut(table.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key").join(winners, "key", "left_semi"))
    keyed = docs.withColumn(name, row_key(docs))
    named = lambda df: small(df.select(F.col("key").alias(name)), df.count())
    out = keyed.join(named(losers), name, "left_anti")
    if again.limit(1).count():  # wholly equal rows that stay: one of each
        out = out.join(named(again), name, "left_anti").unionByName(out.join(named(again), name, "left_semi").dropDuplicates([name]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
