"""Periodic runs of words by heavy/light lag counting.

A run is a stretch of words that repeats with some least period q, at least
twice and over ``least`` words or more, and that no neighbour extends. A run of
period q needs max(least - q, q) neighbouring positions i with word[i] ==
word[i + q], so the number of such positions is counted for all lags first, as
a sum over words. A word that stands often (heavy) adds the autocorrelation of
its positions, from fast Fourier transforms; a word that stands rarely (light)
adds the differences of its positions pair by pair. With n words in a text and
the border at sqrt(n log n) occurrences, both take about n sqrt(n log n) steps
at most. Only lags with enough matches get a scan for islands of matches.

The counts are exact: transforms of 0/1 sequences are rounded to integers whose
error stays far below one half (2 ** 26 words or fewer), and a lag counts as
having enough from half a match below its bound on, so rounding can't lose one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import column_bytes, free_name, schema_with, slices, word_spans, words_of

LEAST_WORDS = 12
#: Bytes of text that are searched at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Pairs of positions, or probes, held at once.
HELD = 1 << 21
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RUN_ARROW = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of every word in a dictionary, the first word of each text (and the end), and the words."""
    starts, ends, row = word_spans(data, offsets)
    size = ends - starts
    cuts = np.concatenate(([0], np.cumsum(size)))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(letters)))
    ids = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False)
    return ids, np.searchsorted(row, np.arange(len(offsets))), words


def border(n: int) -> int:
    """Words of more occurrences than this are heavy in a text of ``n`` words."""
    return max(16, int((n * max(np.log2(max(n, 2)), 1.0)) ** 0.5))


def heavy_matches(ids: np.ndarray, heavy: np.ndarray, lags: int) -> np.ndarray:
    """Matches at lags 0 to ``lags`` of the given words: their power spectra add up, so one transform goes back."""
    size = 1 << (len(ids) + lags).bit_length()
    power = np.zeros(size // 2 + 1)
    for word in heavy:
        f = np.fft.rfft(ids == word, size)
        power += f.real * f.real + f.imag * f.imag
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def lag_matches(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all texts: matches of lags 0 to half the text's words, end to end, and where each text's begin."""
    n = np.diff(first)
    base = np.concatenate(([0], np.cumsum(n // 2 + 1)))
    found = np.zeros(base[-1], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((ids, row))  # by text and word, positions ascending
    cut = np.ones(len(ids) + 1, bool)
    if len(ids):
        cut[1:-1] = (ids[order][1:] != ids[order][:-1]) | (row[order][1:] != row[order][:-1])
    edges = np.flatnonzero(cut)
    count = np.diff(edges)
    limit = np.array([border(int(x)) for x in n], np.int64)
    is_heavy = count > limit[row[order[edges[:-1]]]] if len(ids) else np.zeros(0, bool)
    for r in np.unique(row[order[edges[:-1][is_heavy]]]):
        own = np.flatnonzero(is_heavy & (row[order[edges[:-1]]] == r))
        found[base[r] : base[r + 1]] += heavy_matches(ids[first[r] : first[r + 1]], ids[order[edges[:-1][own]]], int(n[r] // 2))
    # light words: the d-th next occurrence of the same word, for every d at once as long as any is left
    left = np.repeat(np.where(is_heavy, 0, count), count) - (np.arange(len(ids)) - np.repeat(edges[:-1], count)) - 1
    alive = np.flatnonzero(left > 0)
    d, cells, size = 1, [], 0
    while len(alive):
        for a in range(0, len(alive), HELD):
            part = alive[a : a + HELD]
            lag, r = order[part + d] - order[part], row[order[part]]
            near = lag <= n[r] // 2
            cells.append(base[r[near]] + lag[near])
            size += len(cells[-1])
            left[part[~near]] = 0  # later ones lie further still
            if size > HELD:
                found += np.bincount(np.concatenate(cells), minlength=len(found))
                cells, size = [], 0
        d += 1
        alive = alive[left[alive] >= d]
    if cells:
        found += np.bincount(np.concatenate(cells), minlength=len(found))
    return found, base


def _stretch(ids: np.ndarray, lag: int, at: int, low: int, high: int) -> tuple[int, int]:
    """The island of matches around a match at ``at``: [from, to), within [low, high - lag)."""
    to, step = at + 1, 64
    while to < high - lag:
        stop = min(high - lag, to + step)
        same = ids[to:stop] == ids[to + lag : stop + lag]
        if not same.all():
            to += int(same.argmin())
            break
        to, step = stop, step * 2
    begin, step = at, 64
    while begin > low:
        stop = max(low, begin - step)
        same = (ids[stop:begin] == ids[stop + lag : begin + lag])[::-1]
        if not same.all():
            begin -= int(same.argmin())
            break
        begin, step = stop, step * 2
    return begin, to


def _probes(ids: np.ndarray, low: np.ndarray, high: np.ndarray, lag: np.ndarray, island: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lag numbers and matches that may lie in an island of ``island`` matches.

    An island has a match at a multiple of its least size, and at least three
    more matches (islands have six or more) in a row on one side of it.
    """
    number = np.maximum(0, -(-(high - lag - low) // island))
    ends = np.cumsum(number)
    done = 0
    while done < len(lag):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HELD, "right")))
        size = number[done:stop]
        which = np.repeat(np.arange(done, stop), size)
        at = low[which] + (np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)) * island[which]
        good = ids[at] == ids[at + lag[which]]
        which, at = which[good], at[good]

        def same(step: int, which: np.ndarray = which, at: np.ndarray = at) -> np.ndarray:
            x = at + step
            inside = (x >= low[which]) & (x < high[which] - lag[which])
            x = np.where(inside, x, at)
            return inside & (ids[x] == ids[x + lag[which]])

        near = (same(1) & same(2) & same(3)) | (same(-1) & same(-2) & same(-3))
        yield which[near], at[near]
        done = stop


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start and period.

    An island at lag q of which an island at a lesser lag has the same words
    repeats with that lesser period, so it is no run of its own. Inside a known
    run of period p and of 2 q words or more, an island at a multiple q of p is
    that run again (Fine and Wilf), so it isn't walked.
    """
    if least < 12:
        raise ValueError("runs have 12 words or more")
    found, base = lag_matches(ids, first)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), np.diff(base))
    lag = np.arange(len(found)) - base[text]
    need = np.maximum(least - lag, lag)
    enough = (lag > 0) & (found + 0.5 >= need) & (np.maximum(least, 2 * lag) <= n[text])
    text, lag, need = text[enough], lag[enough], need[enough]
    out: list[list[tuple[int, int, int]]] = [[] for _ in n]
    held: tuple[int, np.ndarray] = (-1, np.zeros((0, 3), np.int64))
    for which, at in _probes(ids, first[text], first[text + 1], lag, need):
        edge = np.concatenate(([True], which[1:] != which[:-1], [True])) if len(which) else np.zeros(0, bool)
        cuts = np.flatnonzero(edge)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r, q, m = int(text[which[a]]), int(lag[which[a]]), int(need[which[a]])
            low, high = int(first[r]), int(first[r + 1])
            if held[0] != r:
                held = (r, np.array([(low + s, size, p) for s, size, p in out[r]], np.int64).reshape(-1, 3))
            known, spots = held[1], at[a:b]
            for s, size, _ in known[(known[:, 1] >= 2 * q) & (q % known[:, 2] == 0)]:
                spots = spots[(spots < s) | (spots >= s + size - q)]
            end, fresh = -1, []
            for x in spots:
                if x < end:
                    continue
                begin, end = _stretch(ids, q, int(x), low, high)
                if end - begin >= m and not ((known[:, 0] == begin) & (known[:, 1] == end - begin + q)).any():
                    fresh.append((begin, end - begin + q, q))
            if fresh:
                out[r] += [(s - low, size, p) for s, size, p in fresh]
                held = (r, np.concatenate([known, np.array(fresh, np.int64)]))
    return [sorted(x, key=lambda y: (y[0], y[2])) for x in out]


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns, plus every run (array of start, length, period) and the collapsed text.

    A run's words after its first period are dropped from the collapsed text;
    the words kept are joined by single spaces. Words are told apart as they
    stand, case included. Null and blank texts have no words, no runs and an
    empty collapsed text; repeated rows stay repeated; an empty table gives an
    empty result. Names that clash with a column are refused.
    """
    if {runs.lower(), collapsed.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError("the names of the results are columns already")
    added = {runs: T.ArrayType(RUN), collapsed: T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            _, spans = column_bytes(table.column(text))
            for a, b in slices(spans, SLICE_BYTES):
                part = table.slice(a, b - a)
                data, offsets = column_bytes(part.column(text))
                ids, first, words = word_ids(data, offsets)
                found = runs_of(ids, first, least)
                kept = np.ones(len(ids), bool)
                for at, own in zip(first, found, strict=False):
                    for start, size, period in own:
                        kept[at + start + period : at + start + size] = False
                counts = np.concatenate(([0], np.cumsum(kept)))[first]
                lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), words.filter(pa.array(kept)).cast(pa.string()))
                rows = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in own] for own in found]
                part = part.append_column(runs, pa.array(rows, pa.list_(RUN_ARROW))).append_column(collapsed, pc.binary_join(lists, " "))
                yield from part.to_batches()

    return docs.mapInArrow(run, schema_with(docs, **added))


def with_planted_period(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with a text that repeats from some word on, where the crc32 of the key says so (one in ten).

    With h = crc32 of the decimal key, g = h div 10 and n words: if h mod 10 is
    0, word i becomes word a + (i - a) mod p from a = g mod n on, where p is
    1 + (n - a) div (3 + g mod 8). A null key counts as the text ''.
    """
    words, h, n, a, p = (free_name(docs, f"_{x}") for x in ("words", "h", "n", "a", "p"))
    g = F.floor(F.col(h) / 10)
    hashed = docs.withColumn(h, F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")))
    due = (F.col(h) % 10 == 0) & (F.length(F.col(text)) > 0)
    cut = hashed.withColumn(words, F.when(due, words_of(F.col(text)))).withColumn(n, F.coalesce(F.size(words), F.lit(0)).cast("long"))
    placed = cut.withColumn(a, F.when(F.col(n) > 0, F.pmod(g, F.col(n)))).withColumn(p, F.expr(f"1 + (`{n}` - `{a}`) div (3 + pmod(`{h}` div 10, 8))"))
    repeated = F.expr(f"array_join(transform(`{words}`, (w, i) -> CASE WHEN i < `{a}` THEN w ELSE `{words}`[int(`{a}` + (i - `{a}`) % `{p}`)] END), ' ')")
    return placed.withColumn(text, F.when(F.col(n) > 0, repeated).otherwise(F.col(text))).select(*docs.columns)
