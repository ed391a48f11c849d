"""Benchmark decontamination in DataFrame expressions alone.

Words are runs of letters and digits of the lower-cased text; shingles are
five words (a shorter item is one shingle). An item of k shingles is compared
with the windows of k shingles of a document. At similarity s the two share at
least 2 k s / (1 + s) shingles, so only windows that hold as many positions
with a shingle of the item can reach it; each of them is taken, whatever its
start, and gets a SimHash of its weighted shingles. Item fingerprints stand in
a multi-index of ``BLOCKS`` blocks: a window within the radius must have a
block within radius / BLOCKS bits of the item's block, and the index lists
every such block value, so an equi-join on (length, block, value) finds all
fingerprints within the radius. Exact weighted-shingle similarity (sum of
least counts over sum of greatest) verifies the candidates.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import cut
from folium.llm.rules import once

WIDTH, SIMILARITY = 5, 0.8
#: At similarity 0.8 about 10 of 64 bits differ (deviation 2.9); 23 leaves over four deviations at the index of 20.
RADIUS, BLOCKS = 23, 8
BLOCK_BITS = 64 // BLOCKS
#: Neighbouring windows that are hashed together.
PIECE = 64
#: Rows of an item-side table that may be broadcast; beyond that it is shuffled.
BROADCAST_ROWS = 400_000
LANES = "0x0000000100000001"


def word_list(text: Column) -> Column:
    """Words of the lower-cased text; null and blank text give none."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles(words: str, width: Column) -> Column:
    """Hashes of all runs of ``width`` words; none where there are fewer words."""
    last = F.size(words) - width + 1
    found = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(F.col(words), i, width)))
    return F.when(last >= 1, found).otherwise(F.array().cast("array<bigint>"))


def lanes(hash_: Column, b: Column) -> Column:
    """Bits ``b`` and ``b + 32`` of a hash as two counters of 32 bits, more than an array can fill."""
    return F.call_function("shiftrightunsigned", hash_, b).bitwiseAND(F.lit(int(LANES, 16)))


def majority(sums: Column, n: Column) -> Column:
    """The bits that are set in over half of ``n`` hashes."""

    def bit(acc: Column, x: Column, lane: int) -> Column:
        over = F.shiftrightunsigned(x["a"], 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > n
        return acc.bitwiseOR(F.when(over, F.call_function("shiftleft", F.lit(1).cast("bigint"), x["b"] + 32 * lane)).otherwise(F.lit(0).cast("bigint")))

    pairs = F.transform(sums, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, x: bit(bit(acc, x, 0), x, 1))


def simhashes(hashes: Column, length: Column, count: Column) -> Column:
    """64-bit SimHashes (repeats weigh) of the first ``count`` windows of ``length`` hashes; counters slide from window to window."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), 32)
    first = F.aggregate(F.slice(hashes, 1, length), zero, lambda acc, h: F.transform(acc, lambda a, b: a + lanes(h, b)))
    slide = lambda acc, i: F.transform(F.element_at(acc, -1), lambda a, b: a + lanes(F.element_at(hashes, i + length), b) - lanes(F.element_at(hashes, i), b))
    sums = F.aggregate(F.slice(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), 1, count - 1), F.array(first), lambda acc, i: F.concat(acc, F.array(slide(acc, i))))
    return F.transform(sums, lambda s: majority(s, length))


def simhash(hashes: str) -> Column:
    """64-bit SimHash of a bag of hashes."""
    return F.element_at(simhashes(F.col(hashes), F.size(hashes), F.lit(1)), 1)


def with_bag(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds the bag as a set: each hash with the number of its occurrence. Only hashes that repeat are looked up."""
    df = once(df, "ordered_", F.sort_array(hashes))
    df = once(df, "again_", F.filter("ordered_", lambda x, i: x == F.get("ordered_", i - 1)))
    once_each = F.transform(F.array_distinct("ordered_"), lambda x: F.struct(x.alias("h"), F.lit(1).cast("bigint").alias("k")))
    more = F.transform("again_", lambda x, i: F.struct(x.alias("h"), (i + 3 - F.array_position("again_", x)).cast("bigint").alias("k")))
    return once(df, name, F.concat(once_each, more)).drop("ordered_", "again_")


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def near_masks(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BLOCK_BITS), n)]


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the counted size allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, m words, width, shingle hashes, bag, fingerprint); items without words are left out."""
    items = once(benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("body")), "w", word_list(F.col("body")))
    items = items.filter(F.size("w") > 0).select("item_id", "w", F.size("w").alias("m"), F.least(F.size("w"), F.lit(WIDTH)).alias("width"))
    items = once(items, "hashes", shingles("w", F.col("width")))
    return cut(with_bag(items, "hashes", "bag").select("item_id", "m", "width", "hashes", "bag", simhash("hashes").alias("fp")).distinct())


def window_starts(places: Column, need: Column, length: Column, last: Column) -> Column:
    """Starts, up to ``last``, of the windows of ``length`` shingles with ``need`` or more of the ascending ``places``.

    Each group of ``need`` neighbouring places admits a span of starts; as both
    ends ascend, a span begins behind the one before, so no start is made twice.
    """
    full = F.slice(places, 1, F.greatest(F.size(places) - need + 1, F.lit(0)))  # the first of ``need`` places each
    begin = lambda i: F.greatest(F.get(places, (i + need - 1).cast("int")) - length + 1, F.coalesce(F.get(full, i - 1) + 1, F.lit(0)), F.lit(0))
    spans = F.transform(full, lambda p, i: F.struct(begin(i).alias("a"), F.least(p, last).alias("b")))
    return F.flatten(F.transform(F.filter(spans, lambda s: s["a"] <= s["b"]), lambda s: F.sequence(s["a"], s["b"])))


def pieces_of(starts: Column) -> Column:
    """(start, count): neighbouring ones of ascending starts together, up to ``PIECE`` of them. ``starts`` must be a plain column."""
    lone = lambda step: F.filter(starts, lambda x, i: F.coalesce(F.get(starts, i + step) != x + step, F.lit(True)))
    runs = F.zip_with(lone(-1), lone(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(x["a"], x["b"], F.lit(PIECE)), lambda at: F.struct(at.alias("start"), F.least(F.lit(PIECE), x["b"] - at + 1).alias("count")))))


def find_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document text and item found in it: ``doc_id``, ``doc_key``, ``item_id``, ``item_words``, ``similarity``, ``word_start``.

    The best window is reported (ties: the first). A text shorter than the item
    is one window. ``doc_key`` is a hash of id and text (128 bits), so rows
    that share an id but not a text are told apart, and wholly repeated rows
    come back once. Null and empty texts, and items without words, match
    nothing; empty tables give an empty result; other columns are ignored
    whatever their names.
    """
    items = items_of(benchmark, item_id, item_text)
    seeds = items.select("item_id", "width", F.size("hashes").alias("k"), F.explode(F.array_distinct("hashes")).alias("h"))
    n_seeds = seeds.count()
    widths = [r[0] for r in items.select("width").distinct().collect()]
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    body = body.withColumn("doc_key", F.struct(F.xxhash64("doc_id", "body").alias("a"), F.xxhash64(F.lit(1), "doc_id", "body").alias("b")))
    worded = once(body, "w", word_list(F.col("body"))).select("doc_key", "w", F.explode(F.array(*[F.lit(x) for x in widths or [WIDTH]])).alias("width"))
    place = once(worded, "hashes", shingles("w", F.col("width"))).select("doc_key", "width", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    shared = place.join(small(seeds, n_seeds), ["width", "h"])
    groups = shared.groupBy("doc_key", "item_id", "width", "k", "n").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    length = F.least("k", "n")
    need = F.ceil((F.col("k") + length) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    starts = once(groups.filter(F.size("places") >= need), "starts", window_starts(F.col("places"), need, length, F.greatest(F.col("n") - F.col("k"), F.lit(0))))
    pieces = starts.select("doc_key", "width", "k", F.explode(pieces_of(F.col("starts"))).alias("p"))
    pieces = cut(pieces.distinct().groupBy("doc_key", "width").agg(F.collect_list(F.struct("k", "p.start", "p.count")).alias("pieces")))
    hit = body.join(small(pieces, pieces.count()), "doc_key").dropDuplicates(["doc_key", "width"])
    hit = once(once(hit, "w", word_list(F.col("body"))), "all", shingles("w", F.col("width"))).select("doc_id", "doc_key", "width", "all", F.explode("pieces").alias("p"))
    part = F.slice("all", F.col("p.start") + 1, F.col("p.k") + F.col("p.count") - 1)
    hit = once(hit.select("doc_id", "doc_key", (F.col("p.k") + F.col("width") - 1).alias("m"), F.least("p.k", F.size("all")).alias("length"), "p.start", "p.count", part.alias("part")), "fps", simhashes(F.col("part"), F.col("length"), F.col("count")))
    windows = hit.select("doc_id", "doc_key", "m", "start", "length", "part", F.posexplode("fps").alias("i", "fp"))
    windows = windows.select("doc_id", "doc_key", "m", (F.col("start") + F.col("i")).alias("start"), F.slice("part", F.col("i") + 1, F.col("length")).alias("hashes"), "fp")
    masks = near_masks(RADIUS // BLOCKS)
    index = items.select("item_id", "m", F.col("fp").alias("item_fp"), F.explode(F.array(*[F.struct(F.lit(i).alias("no"), block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)])).alias("b"))
    index = index.select("item_id", "m", "item_fp", F.col("b.no").alias("no"), F.explode(F.array(*[F.col("b.value").bitwiseXOR(F.lit(x)) for x in masks])).alias("value"))
    blocks = F.array(*[F.struct(F.lit(i).alias("no"), block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)])
    probes = windows.select("doc_id", "doc_key", "m", "start", "hashes", "fp", F.explode(blocks).alias("b")).select("doc_id", "doc_key", "m", "start", "hashes", "fp", "b.*")
    near = probes.join(small(index, items.count() * BLOCKS * len(masks)), ["m", "no", "value"])
    distance = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    near = near.filter(distance(F.col("fp"), F.col("item_fp")) <= RADIUS)
    # a pair is kept at its first agreeing block only, so no pair is verified twice
    close = [F.bit_count(block(F.col("fp"), i).bitwiseXOR(block(F.col("item_fp"), i))) <= RADIUS // BLOCKS for i in range(BLOCKS)]
    first = F.coalesce(*[F.when(c, i) for i, c in enumerate(close)])
    near = near.filter(F.col("no") == first).join(small(items.select("item_id", "bag", F.size("hashes").alias("k")), n_seeds), "item_id")
    near = with_bag(near, "hashes", "own")
    common = F.size(F.array_intersect("own", "bag"))
    ratio = common / (F.size("hashes") + F.col("k") - common)
    scored = near.select("doc_id", "doc_key", "item_id", F.col("m").alias("item_words"), F.round(ratio, 6).alias("similarity"), "start").filter(ratio >= similarity)
    best = scored.groupBy("doc_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "doc_id", "item_words")).alias("b"))
    return best.select("b.doc_id", "doc_key", "item_id", "b.item_words", "b.similarity", (-F.col("b.back")).alias("word_start"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark; all others unchanged, repeated rows included.

    Null and empty texts hold none; empty tables drop nothing.
    """
    bad = cut(find_matches(docs, benchmark, doc_id, text).select("doc_key.*").distinct())
    bad = small(bad.select(F.col("a").alias("bad_a"), F.col("b").alias("bad_b")), bad.count())
    columns = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    return docs.join(bad, (F.xxhash64(*columns) == bad["bad_a"]) & (F.xxhash64(F.lit(1), *columns) == bad["bad_b"]), "left_anti")
