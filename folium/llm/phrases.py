"""Collocations from vertical inverted lists of word positions.

Texts are read in blocks of bounded size, and each block's words become an
inverted list: the word, and the ascending positions at which it stands. A
phrase of k words has a list as well, the positions where it begins. A frequent
phrase is extended by merging its list with the lists of words: a word that
stands k positions after the phrase begins makes a phrase of k + 1 words, and
what is left of the list is the list of that phrase. The length of a list is
the phrase's frequency in its block, and the sum over the blocks its exact
frequency in the corpus. Only phrases that are frequent in the whole corpus are
extended, and only to phrases whose last k words are frequent too.

Positions run through the texts of one language in a block, with a step over
each border of a piece, so that neighbours in a list of positions are
neighbours in a piece. What is shuffled by phrase is one count for each block,
so a phrase that stands everywhere brings one row a block. Lists stay by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import LOWER, column_bytes, slices, stored
from folium.llm.lm import packed, unpacked

#: Bytes of text in a block; a longer text makes a block of its own.
BLOCK_BYTES = 10 << 20
#: Bits of a number within a block, and of a block's number within its partition.
PLACE_BITS, BLOCK_BITS = 28, 15
#: Shares of a language that are ranked on their own before their first rows meet.
SHARES = 64

#: Marks that end a piece, and blanks between its words (fixed values of the contract).
MARK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK[list(b" \t")] = True

LISTS = "block bigint, lang string, words array<string>, sizes array<int>, gaps binary"
FOUND = "block bigint, place bigint, head bigint, last bigint, size bigint"


def word_positions(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts in order, and their positions; words of one piece have neighbouring ones."""
    data = LOWER[data]
    gap = MARK[data] | BLANK[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets[:-1]] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | border[1:-1]
    starts = np.flatnonzero(begin)
    letters = np.concatenate(([0], np.cumsum(~gap)))
    cuts = np.append(letters[starts], letters[-1])
    piece = np.cumsum(MARK[data])[starts] + np.searchsorted(offsets, starts, "right")
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[~gap])))
    steps = np.diff(piece, prepend=piece[:1]) > 0
    return words, np.arange(len(starts)) + np.cumsum(steps)


def inverted(words: pa.Array, positions: np.ndarray) -> tuple[pa.Array, np.ndarray, bytes]:
    """The distinct words, the length of each one's list, and the lists: first positions, then gaps."""
    coded = pc.dictionary_encode(words)
    of = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=len(coded.dictionary))
    gaps = positions[order].copy()
    gaps[1:] -= positions[order][:-1]
    firsts = np.cumsum(sizes) - sizes
    gaps[firsts] = positions[order][firsts]
    return coded.dictionary.cast(pa.string()), sizes, packed(gaps.astype(np.uint64))


def opened(sizes: np.ndarray, gaps: bytes) -> np.ndarray:
    """The positions of all lists, list by list."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    steps = unpacked(gaps, int(sizes.sum())).astype(np.int64)
    total = np.cumsum(steps)
    firsts = np.cumsum(sizes) - sizes
    return total - np.repeat(total[firsts] - steps[firsts], sizes)


def block_lists(docs: DataFrame, text: str, lang: str, block_bytes: int) -> DataFrame:
    """One row for each block and language: its words with their lists."""
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def rows(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            whole = pa.concat_tables(parts)
            for name in sorted(pc.unique(whole.column("lang")).to_pylist()):
                words, positions = word_positions(*column_bytes(whole.filter(pc.equal(whole.column("lang"), name)).column("text")))
                if not len(words):
                    continue
                distinct, sizes, gaps = inverted(words, positions)
                if number >> BLOCK_BITS or len(words) >> PLACE_BITS:
                    raise OverflowError("a partition has more blocks, or a block more words, than their numbers hold")
                block = TaskContext.get().partitionId() << BLOCK_BITS | number
                number += 1
                lists = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(sizes, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([name]), *lists, pa.array([gaps])], ["block", "lang", "words", "sizes", "gaps"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            _, spans = column_bytes(table.column("text"))
            for a, b in slices(spans, block_bytes):
                if held and size + spans[b] - spans[a] > block_bytes:
                    yield from rows(held)
                    held, size = [], 0
                held.append(table.slice(a, b - a))
                size += int(spans[b] - spans[a])
        if held:
            yield from rows(held)

    return source.mapInArrow(run, LISTS)


class Lists:
    """The lists of one block at some phrase length: where each occurrence begins (ascending), which phrase it is, and the phrases' numbers in the corpus."""

    def __init__(self, starts: np.ndarray, phrase: np.ndarray, ids: np.ndarray) -> None:
        self.starts, self.phrase, self.ids = starts, phrase, ids

    @classmethod
    def of_words(cls, sizes: np.ndarray, gaps: bytes, places: np.ndarray, ids: np.ndarray) -> Lists:
        """Of the block's frequent words alone, which have these places in its list of words."""
        number = np.full(len(sizes), -1)
        number[places] = np.arange(len(places))
        phrase, starts = np.repeat(number, sizes), opened(sizes, gaps)
        starts, phrase = starts[phrase >= 0], phrase[phrase >= 0]
        order = np.argsort(starts)
        return cls(starts[order], phrase[order], ids)

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether an occurrence begins at each of the ascending places, and its index: a merge of two sorted lists."""
        if not len(self.starts):
            return np.zeros(len(places), bool), np.zeros(len(places), np.int64)
        index = np.minimum(np.searchsorted(self.starts, places), len(self.starts) - 1)
        return self.starts[index] == places, index

    def extended(self, words: Lists, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the phrases of ``length + 1`` words whose first and last ``length`` words are frequent.

        Gives where they begin, and of each the index of its first part here
        and of its last word.
        """
        next_word, index = words.at(self.starts + length)
        next_word &= self.at(self.starts + 1)[0]
        return self.starts[next_word], self.phrase[next_word], words.phrase[index[next_word]]


def extended_lists(lists: dict, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases one word longer than those in ``found`` (places and numbers of frequent phrases, for 1 word, 2 words, ...): first part, last word and frequency in the block."""
    words = Lists.of_words(lists["sizes"], lists["gaps"], *found[0])
    at = words
    for length, frequent in enumerate([*found[1:], None], 1):
        starts, first, last = at.extended(words, length)
        code, phrase, size = np.unique(first * (len(words.ids) + 1) + last, return_inverse=True, return_counts=True)
        if frequent is None:
            return at.ids[code // (len(words.ids) + 1)], words.ids[code % (len(words.ids) + 1)], size
        number = np.full(len(code), -1)
        number[frequent[0]] = np.arange(len(frequent[0]))
        kept = number[phrase] >= 0
        at = Lists(starts[kept], number[phrase][kept], frequent[1])
    raise AssertionError


def _frequent(rows: DataFrame, key: list[str], least: int, carried: list[str]) -> DataFrame:
    """Places of frequent phrases, with the frequency and a number: the first place where the phrase stands. That row alone carries the phrase."""
    place = F.shiftleft("block", PLACE_BITS).bitwiseOR(F.col("place"))
    same = Window.partitionBy(*key)
    counted = rows.withColumn("f", F.sum("size").over(same)).withColumn("id", F.min(place).over(same)).filter(F.col("f") >= least)
    return stored(counted.select("block", "place", "id", "f", *[F.when(F.col("id") == place, F.col(c)).alias(c) for c in carried]))


def _longer(levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Phrases one word longer, of a block's lists and the places of its frequent phrases at each length so far."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("block", "place", "head", "last", "size")})
        level, place, number = (right.column(c).to_numpy() for c in ("level", "place", "id"))
        places = []
        for i in range(levels):
            order = np.argsort(place[level == i])
            places.append((place[level == i][order], number[level == i][order]))
        own = {"sizes": left.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64), "gaps": left.column("gaps")[0].as_py()}
        head, last, size = extended_lists(own, places)
        return pa.table({"block": np.full(len(size), left.column("block")[0].as_py(), np.int64), "place": np.arange(len(size), dtype=np.int64), "head": head.astype(np.int64), "last": last.astype(np.int64), "size": size.astype(np.int64)})

    return run


def frequent_phrases(docs: DataFrame, most: int, least: int, text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of one word, two words and so on up to ``most``, and (lang, n) with the number of words.

    Each table has id, head (id of the phrase without its last word), last (id
    of the last word), f; the first has lang and phrase instead of head, last.
    """
    blocks = stored(block_lists(docs, text, lang, block_bytes))
    total = blocks.groupBy("lang").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "sizes")).alias("place", "w")).select("block", F.col("place").cast("long").alias("place"), "lang", F.col("w.words").alias("phrase"), F.col("w.sizes").cast("long").alias("size"))
    found = [_frequent(words, ["lang", "phrase"], least, ["lang", "phrase"])]
    tables = [found[0].filter("phrase IS NOT NULL").select("id", "lang", "phrase", "f")]
    lists = blocks.select("block", "sizes", "gaps")
    for k in range(2, most + 1):
        alive = [f.select("block", F.lit(i).alias("level"), "place", "id") for i, f in enumerate(found)]
        known = alive[0]
        for more in alive[1:]:
            known = known.unionByName(more)

        longer = lists.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_longer(k - 1), FOUND)
        if k < most:
            found.append(_frequent(longer, ["head", "last"], least, ["head", "last"]))
            tables.append(found[-1].filter("head IS NOT NULL").select("id", "head", "last", "f"))
        else:
            tables.append(longer.groupBy("head", "last").agg(F.sum("size").alias("f")).filter(F.col("f") >= least).select(F.lit(None).cast("long").alias("id"), "head", "last", "f"))
    return tables, total


def collocations(docs: DataFrame, most: int = 3, least: int = 10, inside: int = 50, top: int = 2000, text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score (bigint but for the strings).

    Texts are lower-cased (A to Z), cut at ``.,;:!?`` and line ends into pieces
    and at blanks and tabs into words. A phrase of 2 to ``most`` words of one
    piece with a frequency a of ``least`` or more is a candidate. Cut in two
    with frequencies l and r, it has the score floor(1000000 a a / (l r)); the
    cut with the lowest score counts, the first of equal ones. A candidate
    inside a longer one with ``inside`` percent of its frequency or more is
    left out. Products are decimals of 38 digits, exact for frequencies under
    10 ** 15. Rank follows score, then a (both descending), then the phrase's
    bytes.

    Null and empty texts have no words; a null language counts as ``und``;
    repeated rows count as often as they stand; an empty table gives an empty
    result; other columns aren't read. ``block_bytes`` sets the memory of a
    task and changes no result.
    """
    tables, total = frequent_phrases(docs, most, least, text, lang, block_bytes)
    level = tables[0].select("id", F.lit(None).cast("long").alias("suffix"), "lang", "phrase", "f", F.array("f").alias("heads"), F.array("f").alias("tails"), F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("last"))
    levels, words = [], level
    for k, table in enumerate(tables[1:], 2):
        first = level.select(F.col("id").alias("head"), F.col("suffix").alias("_suffix"), F.col("lang"), F.col("phrase").alias("_phrase"), F.col("heads").alias("_heads"))
        joined = table.join(first, "head").join(words.select(F.col("id").alias("last"), F.col("phrase").alias("_word")), "last")
        if k == 2:
            ends = level.select(F.col("id").alias("last"), F.col("id").alias("suffix"), F.col("tails").alias("_tails"))
            joined = joined.join(ends, "last")
        else:
            ends = level.select(F.col("head").alias("_suffix"), "last", F.col("id").alias("suffix"), F.col("tails").alias("_tails"))
            joined = joined.join(ends, ["_suffix", "last"])
        level = joined.select("id", "suffix", "lang", F.concat_ws(" ", "_phrase", "_word").alias("phrase"), "f", F.concat("_heads", F.array("f")).alias("heads"), F.concat("_tails", F.array("f")).alias("tails"), "head", "last")
        level = stored(level)
        levels.append(level)
    kept = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            longer = levels[k + 1]
            around = longer.select(F.col("head").alias("id"), F.col("f").alias("_f")).unionByName(longer.select(F.col("suffix").alias("id"), F.col("f").alias("_f"))).groupBy("id").agg(F.max("_f").alias("_f"))
            level = level.join(around, "id", "left").filter(F.expr(f"_f IS NULL OR 100 * _f < {int(inside)} * f"))
        cuts = level.select("lang", "phrase", F.col("f").alias("a"), _best_cut(k + 2).alias("_cut"))
        kept = cuts if kept is None else kept.unionByName(cuts)
    scored = kept.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    near = scored.withColumn("_share", share).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*best))).filter(F.col("_rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _best_cut(words: int) -> Column:
    """The lowest score over all cuts of a phrase, with the frequencies of its parts."""
    exact = lambda x: f"cast({x} AS decimal(15, 0))"
    cuts = [
        F.expr(f"named_struct('score', (cast(1000000 AS decimal(7, 0)) * {exact('f')} * {exact('f')}) div ({exact(f'heads[{i - 1}]')} * {exact(f'tails[{words - i - 1}]')}), 'cut', {i}, 'l', heads[{i - 1}], 'r', tails[{words - i - 1}])")
        for i in range(1, words)
    ]
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]
