"""Removal of repeated spans of bytes by a multi-document suffix array that is built column by column.

The Burrows-Wheeler transform and the common prefixes of a collection of
strings are built by inserting one symbol of every string each round, from
their ends to their starts (Bauer, Cox and Rosone; common prefixes as Cox,
Garofalo, Rosone and Sciortino extend them). A round reads transform and
prefixes of the round before from front to back and writes them anew. Suffixes
whose common prefix with a neighbour reaches the span's length are repeats.

A collection is worked on by one task, so the corpus is dealt to many of
bounded size, such that equal spans meet in one. The anchor of a span is its
``gram`` bytes of least hash, the first of equal ones, so equal spans have
equal anchors at equal places. Spans that begin side by side and share an
anchor make up a region, of at most ``2 * span - gram`` bytes:

1. Each text gives the hash of every region and of its anchor. Anchors that
   stand once in the corpus can't hold repeats. Regions that are equal in full
   are one region with a count, and all their spans are repeats.
2. The spans of a region fall into two halves by their distance to the anchor;
   those of a half have a core of bytes in common. Halves whose core no other
   region has can't hold repeats. The rest of the regions is gathered, one copy
   of each, dealt by anchor to collections of about ``CELL_BYTES``, and sorted
   as above.
3. What was found goes back to the texts by their hash, and they are cut.

An anchor with more than ``MANY`` different regions would make a collection too
large: its regions are cut into shorter ones that share a longer core (all
bytes that the spans of a class have in common), which is their anchor from
then on, down to single spans. The sequential files of the method are arrays of
the task, as a collection is small by construction.

Two regions count as equal if the 64-bit hashes of both their anchors and all
their bytes are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import INVERSE, MULTIPLIER, column_bytes, mix, schema_with, slices, stored

SPAN, GRAM = 200, 64
#: Bytes of a collection, and the different regions of one anchor that may stand in it.
CELL_BYTES, MANY = 512 << 10, 16_384
#: Spans of a class that share a core, for anchors with too many regions; 1 at last.
WIDTHS = (12, 1)
#: Bytes that are hashed at once; places in them fit into PLACE_BITS.
PLACE_BITS = 18
STEP = (1 << PLACE_BITS) - 1024
UP, DOWN = np.full(1 << PLACE_BITS, MULTIPLIER), np.full(1 << PLACE_BITS, INVERSE)
UP[0] = DOWN[0] = 1
UP, DOWN = np.cumprod(UP), np.cumprod(DOWN)
FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


@dataclass
class Regions:
    """Regions of some texts: the text's row, first span, number of spans, place of the anchor, hashes of the anchor, of the region and of the cores of its far and near spans (0: it has none)."""

    row: np.ndarray
    first: np.ndarray
    spans: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    region: np.ndarray
    far: np.ndarray
    near: np.ndarray


def halves(span: int, gram: int) -> int:
    """Spans that begin fewer bytes than this before their anchor are near ones."""
    return (span - gram + 1) // 2


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def _hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (prefix[stop] - prefix[start]) * DOWN[start]


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * UP[: len(data)], out=out[1:])
    return out


def regions_of(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> Regions:
    """Regions of texts of at most STEP bytes in all, or of one longer text (cut at multiples of STEP of its own)."""
    valid = np.zeros(len(data) + 1, np.int32)
    stops = np.maximum(offsets[1:] - span + 1, offsets[:-1])
    np.add.at(valid, offsets[:-1], 1)
    np.add.at(valid, stops, -1)
    valid = np.cumsum(valid[:-1]) > 0
    parts = []
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + span - 1]
        if len(part) < span:
            continue
        prefix = _prefix(part)
        places = np.arange(len(part) - gram + 1)
        grams = mix(_hash(prefix, places, places + gram))
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = _least(grams & ~low | places.astype(np.uint64), span - gram + 1)
        starts = np.flatnonzero(valid[at : at + min(STEP, len(least))])
        anchor = (least[starts] & low).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(starts) else np.zeros(0, np.int64)
        first, spans = starts[cut], np.diff(np.append(cut, len(starts)))
        stop, anchor = first + spans + span - 1, anchor[cut]
        region = mix(_hash(prefix, first, stop) + (anchor - first).astype(np.uint64) * MULTIPLIER + spans.astype(np.uint64))
        half = halves(span, gram)
        has_far, has_near = anchor - first >= half, anchor - first - spans + 1 < half
        core = lambda has, start, stop, salt, prefix=prefix: np.where(has, mix(_hash(prefix, np.where(has, start, 0), np.where(has, stop, 0)) + np.uint64(salt)) | np.uint64(1), np.uint64(0))
        far, near = core(has_far, anchor - half, anchor + gram, 1), core(has_near, anchor, anchor + span - half + 1, 2)
        parts.append((first + at, spans, anchor + at, grams[anchor], region, far, near))
    if not parts:
        none, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Regions(none, none, none, none, hashes, hashes, hashes, hashes)
    first, spans, anchor, *hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Regions(np.searchsorted(offsets, first, "right") - 1, first, spans, anchor, *hashes)


def repeats(data: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    """For every byte of a collection of strings whether the ``span`` bytes from there on stand in it elsewhere.

    Round k inserts the suffixes of k bytes. Those of one symbol c and a
    suffix of the round before stand in the order of the places where the
    transform has c, so each new place is a rank, and its common prefix is one
    more than the least one between that place and the last c before it.
    """
    m = len(offsets) - 1
    length = np.diff(offsets)
    code = np.zeros(256, np.uint8)
    present = np.flatnonzero(np.bincount(data, minlength=256))
    code[present] = np.arange(1, len(present) + 1)  # 0 marks the front of a string
    coded = code[data]
    symbol = lambda who, k: np.where(k < length[who], coded[np.maximum(offsets[who + 1] - 1 - k, 0)] if len(coded) else 0, 0).astype(np.uint8)
    who, place = np.arange(m), np.arange(m)  # strings that grow, and the place of each one's longest suffix, ascending
    # a row is a symbol of the transform with the common prefix above it, so one pass moves both; an empty row closes the table
    table = np.zeros(m + 1, np.uint16)
    table[:-1] = symbol(who, 0)
    for k in range(1, int(length.max(initial=0)) + 1):
        transform = table[:-1].astype(np.uint8)
        alive = transform[place] > 0
        who, place = who[alive], place[alive]
        order = np.argsort(transform, kind="stable")
        fronts = len(transform) - np.count_nonzero(transform)
        fresh = np.zeros(len(transform), bool)
        fresh[place] = True
        rank = np.flatnonzero(fresh[order])  # by symbol, then place
        old = order[rank]
        owner = who[np.searchsorted(place, old)]
        same = transform[old]
        before = order[np.maximum(rank - 1, 0)]
        after = order[np.minimum(rank + 1, len(order) - 1)]
        has_before = (rank > 0) & (transform[before] == same)
        has_after = (rank + 1 < len(order)) & (transform[after] == same)
        # least common prefixes over (before, old] and (old, after]; falling places make every other pair empty
        start = np.concatenate((before[has_before], old[has_after])) + 1
        stop = np.concatenate((old[has_before], after[has_after])) + 1
        falling = np.argsort(-start, kind="stable")
        pairs = np.empty(2 * len(start), np.int64)
        pairs[::2], pairs[1::2] = start[falling], stop[falling]
        least = np.empty(len(start), np.uint16)
        least[falling] = np.minimum.reduceat(table, pairs)[::2] >> 8 if len(pairs) else 0
        least = np.minimum(least + 1, span).astype(np.uint16) << 8
        new = rank - fronts + m
        kept = np.ones(len(transform) + len(new), bool)
        kept[new] = False
        grown = np.zeros(len(kept) + 1, np.uint16)
        grown[:-1][kept] = table[:-1]
        grown[new] = symbol(owner, k)
        grown[new + 1] &= 255
        n_before = int(has_before.sum())
        for at, value in ((new[has_after] + 1, least[n_before:]), (new[has_before], least[:n_before])):
            grown[at] = grown[at] & 255 | value
        table, who, place = grown, owner, new
    transform, common = table[:-1].astype(np.uint8), table[:-1] >> 8
    equal = common >= span
    equal[:-1] |= equal[1:]
    # walk from the end of every string to its front
    out = np.zeros(len(data), bool)
    order = np.argsort(transform, kind="stable")
    fronts = len(transform) - np.count_nonzero(transform)
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order)) - fronts + m
    who, place = np.arange(m), np.arange(m)
    for k in range(1, int(length.max(initial=0)) + 1):
        alive = length[who] >= k
        who, place = who[alive], to[place[alive]]
        out[offsets[who + 1] - k] = equal[place]
    return out


def classes_of(starts: np.ndarray, anchor: int, width: int, span: int) -> Iterator[tuple[int, int, int, int]]:
    """A region's spans by their distance to the anchor: first and last span of each class, and the first and last byte of its core (ends exclusive)."""
    number = (anchor - starts) // width
    cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        d = int(number[a]) * width
        yield int(starts[a]), int(starts[b - 1]) + 1, anchor - d, anchor - d - width + 1 + span


#: A region that is gathered: hashes of its anchor and of itself, whether it stands more than once, the spans left out before those gathered, the anchor's place, the number of spans, the bytes.
GATHERED = "gram bigint, region bigint, often boolean, skip bigint, anchor bigint, spans bigint, data binary"
#: Spans of a region that are repeats, as ranges of their numbers.
VERDICT = "gram bigint, region bigint, found array<struct<start:bigint,stop:bigint>>"


def _text_regions(table: pa.Table, text: str, span: int, gram: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, Regions]]:
    """Slices of a table with their bytes, offsets and regions."""
    _, spans = column_bytes(table.column(text))
    for a, b in slices(spans, STEP):
        part = table.slice(a, b - a)
        data, offsets = column_bytes(part.column(text))
        yield part, data, offsets, regions_of(data, offsets, span, gram)


def _marks(span: int, gram: int) -> Callable:
    """The regions of each text, by the text's key, with the times that they stand in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, found in _text_regions(pa.Table.from_batches([batch]), "text", span, gram):
                key = part.column("key").to_numpy()[found.row]
                rows = np.stack([key, *(h.view(np.int64) for h in (found.gram, found.region, found.far, found.near))])
                rows = rows[:, np.lexsort(rows[:3])]
                cut = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))) if rows.shape[1] else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:, cut], np.diff(np.append(cut, rows.shape[1])))], ["key", "gram", "region", "far", "near", "times"])

    return run


def _asked(span: int, gram: int) -> Callable:
    """The bytes of the regions that a text was asked for, of their far spans, near spans or all; of neighbouring rows with one text the first answers."""
    half = halves(span, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table.column("key").to_numpy()
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            if len(keys):
                fresh[0], last = keys[0] != last, keys[-1]
            for part, data, _, found in _text_regions(table.filter(pa.array(fresh)), "text", span, gram):
                asked = part.column("asked").to_pylist()
                cuts = np.searchsorted(found.row, np.arange(len(part) + 1))
                out = []
                for i, wanted in enumerate(asked):
                    wanted = {(x["gram"], x["region"]): x for x in wanted}
                    a, b = cuts[i], cuts[i + 1]
                    for j, pair in enumerate(zip(found.gram[a:b].view(np.int64).tolist(), found.region[a:b].view(np.int64).tolist(), strict=True), a):
                        if (x := wanted.pop(pair, None)) is not None:
                            first, n, anchor = int(found.first[j]), int(found.spans[j]), int(found.anchor[j])
                            border = min(max(anchor - half + 1, first), first + n)  # far spans begin before it
                            start, stop = (first if x["far"] else border), (first + n if x["near"] else border)
                            out.append((*pair, x["often"], start - first, anchor - start, stop - start, data[start : stop + span - 1].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield from pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["gram", "region", "often", "skip", "anchor", "spans", "data"]).to_batches()

    return run


def _cell(span: int) -> Callable[[pa.Table], pa.Table]:
    """Repeats among the regions of a collection, of those that stand once; the others are repeats in full."""

    def run(table: pa.Table) -> pa.Table:
        distinct = table.group_by(["gram", "region"], use_threads=False).aggregate([("often", "max"), ("skip", "first"), ("spans", "first"), ("data", "first")])
        data, offsets = _bytes(distinct.column("data_first"))
        equal = repeats(data, offsets, span)
        out = []
        for gram, region, often, skip, n, at in zip(*(distinct.column(c).to_pylist() for c in ("gram", "region", "often_max", "skip_first", "spans_first")), offsets[:-1].tolist(), strict=True):
            if not often and (found := _ranges_of(equal[at : at + n])):
                out.append((gram, region, [{"start": x["start"] + skip, "stop": x["stop"] + skip} for x in found]))
        return _verdicts(out)

    return run


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _ranges_of(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _verdicts(rows: list[tuple]) -> pa.Table:
    found = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({c: pa.array(x, k) for c, x, k in zip(("gram", "region", "found"), columns, (pa.int64(), pa.int64(), found), strict=True)})


def _classes(width: int, span: int) -> Callable:
    """Regions cut into classes, each a region of its own whose anchor is its core; ``home`` tells where its spans belong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], np.uint8)
                prefix = _prefix(data)
                key = lambda a, b, salt, prefix=prefix: int(mix(_hash(prefix, np.array([a]), np.array([b])) + np.uint64(salt))[0].view(np.int64))
                for first, stop, core, core_stop in classes_of(np.arange(row["spans"]), row["anchor"], width, span):
                    end = stop + span - 1
                    out.append((row["gram"], row["region"], row["skip"] + first, key(core, core_stop, 2 * (row["anchor"] - core) + 1), key(first, end, 2 * (row["anchor"] - first)), row["often"], 0, core - first, stop - first, row["data"][first:end]))
            names = ["home_gram", "home_region", "home", "gram", "region", "often", "skip", "anchor", "spans", "data"]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield from pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 10, kinds, strict=True)], names).to_batches()

    return run


def _solved(gathered: DataFrame, span: int, cell_bytes: int, many: int, widths: tuple[int, ...]) -> DataFrame:
    """Repeats inside gathered regions (VERDICT); anchors with too many regions are taken in classes first."""
    spark = gathered.sparkSession
    crowded = gathered.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many).select("gram")
    later = None
    if widths and crowded.limit(1).count():
        crowded = stored(crowded)
        cut = stored(gathered.join(crowded, "gram", "left_semi").mapInArrow(_classes(widths[0], span), "home_gram bigint, home_region bigint, home bigint, " + GATHERED))
        own = ["gram", "region"]
        counted = cut.groupBy(*own).agg((F.max("often") | (F.count(F.lit(1)) > 1)).alias("often"), F.first("skip").alias("skip"), F.first("anchor").alias("anchor"), F.first("spans").alias("spans"), F.first("data").alias("data"))
        counted = stored(counted)
        found = _solved(counted, span, cell_bytes, many, widths[1:]).unionByName(counted.filter("often").select(*own, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("spans").alias("stop"))).alias("found")))
        at_home = cut.select(*own, "home_gram", "home_region", "home").join(found, own).select("home_gram", "home_region", F.explode(F.transform("found", lambda x: F.struct((x["start"] + F.col("home")).alias("start"), (x["stop"] + F.col("home")).alias("stop")))).alias("x"))
        later = at_home.groupBy(F.col("home_gram").alias("gram"), F.col("home_region").alias("region")).agg(F.collect_set("x").alias("found"))
        gathered = gathered.join(crowded, "gram", "left_anti")
    total = gathered.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    cells = max(1, -(-total // cell_bytes))
    solved = gathered.withColumn("cell", F.pmod(F.xxhash64("gram"), F.lit(cells))).repartition(_partitions(spark, cells), "cell").groupBy("cell").applyInArrow(_cell(span), VERDICT)
    return solved if later is None else solved.unionByName(later)


def _partitions(spark, cells: int) -> int:
    return max(1, min(cells, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8))


def _cut(span: int, gram: int, spans: str, kept: str) -> Callable:
    """The texts without the bytes that any repeat covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            _, sizes = column_bytes(whole.column("text"))
            for a, b in slices(sizes, STEP):
                part = whole.slice(a, b - a)
                data, offsets = column_bytes(part.column("text"))
                known = part.column("found").to_pylist()
                edge = np.zeros(len(data) + 1, np.int64)
                if any(known):
                    r = regions_of(data, offsets, span, gram)
                    cuts = np.searchsorted(r.row, np.arange(len(part) + 1))
                    for i, own in enumerate(known):
                        verdict = {(x["gram"], x["region"]): x["found"] for x in own or ()}
                        low, high = cuts[i], cuts[i + 1] if verdict else cuts[i]
                        for j, pair in enumerate(zip(r.gram[low:high].view(np.int64).tolist(), r.region[low:high].view(np.int64).tolist(), strict=True), low):
                            if pair in verdict:
                                for x in verdict[pair] or ({"start": 0, "stop": int(r.spans[j])},):
                                    edge[r.first[j] + x["start"]] += 1
                                    edge[r.first[j] + x["stop"] - 1 + span] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                found, rest = [], []
                for x, y in zip(offsets[:-1], offsets[1:], strict=True):
                    found.append(_ranges_of(gone[x:y]))
                    rest.append(data[x:y][~gone[x:y]].tobytes())
                out = part.drop_columns(["key", "found", "text"])
                out = out.append_column(spans, pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))).append_column(kept, pa.array(rest, pa.binary()))
                yield from out.to_batches()

    return run


def without_repeats(docs: DataFrame, keep: list[str], text: str = "text", span: int = SPAN, gram: int = GRAM, spans: str = "spans", kept: str = "kept", cell_bytes: int = CELL_BYTES, many: int = MANY, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``keep`` columns of every row, the removed ranges of bytes and what is left of the text (binary).

    Texts are UTF-8 bytes. Every byte is removed that a string of ``span``
    bytes covers which also starts elsewhere in the corpus, the same text
    included; all strings are judged on the input. What is left may break
    inside a character, so it is binary. Strings never cross texts.

    Null and empty texts and texts under ``span`` bytes lose nothing; repeated
    rows of ``span`` bytes or more lose all; an empty table gives an empty
    result. ``gram``, ``cell_bytes``, ``many`` and ``widths`` shape the work and
    change no result.
    """
    if not 0 < gram <= span < 256 or widths[-1:] != (1,):
        raise ValueError("a gram is as long as a span at most, a span has under 256 bytes, and the last classes are single spans")
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("key", F.xxhash64("text"))
    own = ["gram", "region"]
    marks = stored(source.select("key", "text").mapInArrow(_marks(span, gram), "key bigint, gram bigint, region bigint, far bigint, near bigint, times bigint"))
    shared = marks.groupBy("gram").agg(F.sum("times").alias("n"), (F.min("region") != F.max("region")).alias("mixed")).filter("n > 1").select("gram", "mixed")
    known = stored(marks.join(shared, "gram"))
    regions = stored(known.filter("mixed").groupBy(*own).agg((F.sum("times") > 1).alias("often"), F.min("key").alias("key"), F.first("far").alias("far"), F.first("near").alias("near")))
    cores = regions.select(F.explode(F.array("far", "near")).alias("core")).filter("core <> 0").groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core", F.lit(True).alias("yes"))
    due = regions
    for side in ("far", "near"):
        due = due.join(cores.select(F.col("core").alias(side), F.col("yes").alias(f"{side}_yes")), side, "left").withColumn(f"{side}_yes", F.coalesce(f"{side}_yes", F.lit(False)))
    asked = due.filter("far_yes OR near_yes").groupBy("key").agg(F.collect_list(F.struct("gram", "region", "often", F.col("far_yes").alias("far"), F.col("near_yes").alias("near"))).alias("asked"))
    rows = source.select("key", "text").join(asked.hint("merge"), "key").sortWithinPartitions("key")
    gathered = stored(rows.mapInArrow(_asked(span, gram), GATHERED))
    parts = _solved(gathered, span, cell_bytes, many, widths).unionByName(regions.filter("often").select(*own, F.lit(None).cast(FOUND).alias("found")))
    found = known.filter("mixed").select("key", *own).join(stored(parts), own).unionByName(known.filter("NOT mixed").select("key", *own, F.lit(None).cast(FOUND).alias("found")))
    by_text = found.groupBy("key").agg(F.collect_set(F.struct(*own, "found")).alias("found"))
    schema = schema_with(source.select(*names), **{spans: FOUND, kept: T.BinaryType()})
    cut = source.join(by_text, "key", "left").select(*names, "key", "text", "found").mapInArrow(_cut(span, gram, spans, kept), schema)
    return cut.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], spans, kept)
