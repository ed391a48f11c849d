"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980), order two.

p(w | v) = a(b) c(v w) / c(v) + u(b) c(w) / N + o(b) / (V + 1)

where b is the bucket of the context count c(v) on a log scale. Counts come
from all training documents. The weights of each bucket are learned by
expectation-maximisation on held-out counts: a tenth of the training
documents is set aside, the relative frequencies of the rest predict its
bigrams, and the weights that maximise their likelihood are kept; counts of
all training documents then go with them.

Tokens and bigrams are keyed by 64-bit hashes. Documents are dealt to chunks
of bounded size. The counts of all chunks are summed in a tree over the key
range: a unit of level L holds the keys that share their first ``FAN * L``
bits, from ``2 ** (FAN * L)`` chunks at most, so every unit holds about as many
keys as one chunk, at any size of the input, and the number of levels grows
with its logarithm. Totals go back down the same way. Each row that is shuffled
holds the keys that one unit sends another, hundreds as a rule, and a frequent
word or a passage that many documents share costs one entry a unit. Repeated
rows have one chunk; they become one row with their number before a chunk is
read, so a row that stands very often doesn't fill a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import LOWER, SpanHasher, column_bytes, mix, schema_with, stored, word_spans

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 4 << 20
#: Bits of the key that each level of the tree splits by.
FAN = 9
END, BEGIN = np.uint64(0x1D1), np.uint64(0xB0B)
BEGIN_KEY = mix(np.array([BEGIN])) & ~np.uint64(1)
LEVELS = 24
#: Relative frequencies go to EM in steps of a quarter bit; the last cell is frequency 0.
GRID = 4
CELLS = 160
#: Copies of a row that are made from one array.
COPIES = 1 << 16
#: Role of a document: scored only, counted, or held out for the weights. A chunk has documents of one role.
SCORED, COUNTED, HELD = 0, 1, 2


@dataclass
class Tokens:
    """Tokens of some documents: keys of tokens, contexts and bigrams (even: tokens, odd: bigrams), and the row of each."""

    token: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    row: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> Tokens:
    """Words of the lower-cased text, then one end token, for every document."""
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(doc, minlength=rows)
    token = np.empty(len(starts) + rows, np.uint64)
    last = np.cumsum(n + 1) - 1
    is_end = np.zeros(len(token), bool)
    is_end[last] = True
    token[~is_end] = hasher(data, starts, ends)
    token[is_end] = mix(np.array([END]))[0]
    token &= ~np.uint64(1)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[last - n] = BEGIN_KEY
    return Tokens(token, context, mix(context * np.uint64(3) + token) | np.uint64(1), np.repeat(np.arange(rows), n + 1))


def chunk_keys(t: Tokens, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a chunk in ascending order, and their counts; each of a text's copies has one begin mark."""
    kinds = [np.unique(x, return_inverse=True) for x in (t.token, t.pair)]
    weight = copies[t.row]
    keys = np.concatenate([k for k, _ in kinds] + [BEGIN_KEY])
    counts = np.concatenate([np.bincount(at, weight, len(k)).astype(np.int64) for k, at in kinds] + [[copies.sum()]])
    order = np.argsort(keys)
    return keys[order], counts[order]


def log_cell(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.minimum(np.rint(-GRID * np.log2(np.maximum(f, 1e-300))), CELLS - 2), CELLS - 1).astype(np.int64)


def level(count: np.ndarray) -> np.ndarray:
    """Bucket of a context count: 0 for unseen, then one for each power of two."""
    return np.minimum(np.floor(np.log2(np.maximum(count, 0.5) * 2.0)), LEVELS - 1).astype(np.int64)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def learn_weights(cells: np.ndarray, counts: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """EM over (level, cell of c(vw)/c(v), cell of c(w)/N) cells; rows of the result sum to 1.

    Levels without held-out events share the weights of the nearest level
    below that has some. An unseen context has no bigram weight.
    """
    value = np.append(2.0 ** (-np.arange(CELLS - 1) / GRID), 0.0)
    out = np.full((LEVELS, 3), 1 / 3)
    before = np.array([1 / 3, 1 / 3, 1 / 3])
    for b in range(LEVELS):
        at = cells[:, 0] == b
        if at.any():
            p = np.stack([value[cells[at, 1]], value[cells[at, 2]], np.full(at.sum(), 1.0 / (vocabulary + 1))], axis=1)
            w = before.copy() if before.min() > 0 else np.full(3, 1 / 3)
            for _ in range(rounds):
                share = p * w
                share /= share.sum(axis=1, keepdims=True)
                w = (share * counts[at, None]).sum(axis=0) / counts[at].sum()
            before = np.maximum(w, 1e-6)
            before /= before.sum()
        out[b] = before
    out[0, 0] = 0.0
    out[0] /= out[0].sum()
    return out


def probability(w: np.ndarray, v: np.ndarray, vw: np.ndarray, stats: Statistics) -> np.ndarray:
    """The mixture for counts of words, contexts and bigrams."""
    mixture = stats.weights[level(v)]
    return mixture[:, 0] * ratio(vw, v) + mixture[:, 1] * (w / max(stats.tokens, 1)) + mixture[:, 2] / (stats.distinct + 1.0)


@dataclass
class Statistics:
    """Corpus-wide sums: tokens and distinct tokens of all training documents, and of the counted ones."""

    tokens: int
    distinct: int
    counted_tokens: int
    weights: np.ndarray | None = None


@dataclass
class Layout:
    """Chunk numbers: those of a role follow one another, in the order of the roles."""

    first: list[int]
    chunks: int
    fan: int

    @property
    def levels(self) -> int:
        return max(1, -(-(self.chunks - 1).bit_length() // self.fan))


def _with_chunk(docs: DataFrame, text: str, keep: list[str], role: Column, chunk_bytes: int, fan: int) -> tuple[DataFrame, Layout]:
    """Rows dealt to chunks of about ``chunk_bytes`` and of one role; the number of chunks grows with the input."""
    size = F.octet_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    by_role = {r: n for r, n in docs.groupBy(role.cast("int").alias("role")).agg(F.sum(size)).collect()}
    chunks = [max(1, -(-by_role.get(r, 0) // chunk_bytes)) for r in (SCORED, COUNTED, HELD)]
    first = [0, chunks[0], chunks[0] + chunks[1]]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), role.cast("int").alias("role"))
    key = F.xxhash64(*[f"k{i}" for i in range(len(keep))], "text")
    place = lambda r: F.pmod(key, F.lit(chunks[r])) + first[r]
    chunk = F.when(F.col("role") == HELD, place(HELD)).when(F.col("role") == COUNTED, place(COUNTED)).otherwise(place(SCORED))
    dealt = source.withColumn("chunk", chunk.cast("long"))
    # dealt by chunk first: copies are counted where their chunk is read, without a further exchange
    return dealt.repartition("chunk").groupBy(*dealt.columns).agg(F.count(F.lit(1)).alias("copies")), Layout(first, sum(chunks), fan)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first; planes of zeros at the top are left out."""
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T
    wide = (int(values.max(initial=0)).bit_length() + 7) // 8
    return planes[:wide].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if data:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.view(np.uint64).reshape(-1)


REQUEST = "grp bigint, cell bigint, child bigint, size int, gaps binary, counted binary, held binary"
ANSWER = "grp bigint, cell bigint, part bigint, size int, counted binary, held binary, n_tokens bigint, n_distinct bigint, n_counted bigint"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _requests(child: int, lvl: int, fan: int, keys: np.ndarray, counted: np.ndarray, held: np.ndarray) -> list[tuple]:
    """What a unit of level ``lvl - 1`` sends those of level ``lvl``: its keys, cell by cell."""
    shift = np.uint64(64 - fan * lvl)
    cell = keys >> shift
    cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(keys) else [0]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        gaps = keys[a:b].copy()
        gaps[1:] -= keys[a : b - 1]
        gaps[0] -= cell[a] << shift
        out.append((child >> fan, int(cell[a]), child, b - a, packed(gaps), packed(counted[a:b]), packed(held[a:b])))
    return out


class Unit:
    """The requests of one unit: keys row by row, and the distinct keys with their sums."""

    def __init__(self, table: pa.Table, lvl: int, fan: int) -> None:
        self.fan = fan
        rows = table.to_pydict()
        self.cell, self.child, self.size = rows["cell"][0], rows["child"], rows["size"]
        base = np.uint64(self.cell << (64 - fan * lvl))
        read = lambda name: [unpacked(d, n) for d, n in zip(rows[name], self.size, strict=True)]
        keys = np.concatenate([np.cumsum(g) + base for g in read("gaps")])
        self.keys, self.at = np.unique(keys, return_inverse=True)
        total = lambda name: np.bincount(self.at, np.concatenate(read(name)), len(self.keys)).astype(np.uint64)
        self.counted, self.held = total("counted"), total("held")

    def answers(self, counted: np.ndarray, held: np.ndarray, sums: tuple[int, int, int] = (0, 0, 0)) -> list[tuple]:
        """Totals of the distinct keys, dealt back to the rows that asked; ``sums`` go with the first."""
        ends = np.cumsum(self.size)
        rows = [self.at[e - n : e] for e, n in zip(ends, self.size, strict=True)]
        return [(c, self.cell >> self.fan, self.cell, n, packed(counted[r]), packed(held[r]), *(sums if i == 0 else (0, 0, 0))) for i, (c, n, r) in enumerate(zip(self.child, self.size, rows, strict=True))]

    def sums(self) -> tuple[int, int, int]:
        """Tokens of training documents, distinct ones, and tokens of the counted documents."""
        both = self.counted + self.held
        own = (self.keys & np.uint64(1) == 0) & (self.keys != BEGIN_KEY[0]) & (both > 0)
        return int(both[own].sum()), int(own.sum()), int(self.counted[own].sum())


def _read_answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counted and held-out totals of a unit's distinct keys in ascending order."""
    rows = table.sort_by("part").to_pydict()
    read = lambda name: np.concatenate([np.zeros(0, np.uint64)] + [unpacked(d, n) for d, n in zip(rows[name], rows["size"], strict=True)])
    return read("counted"), read("held")


def _totals(requests: DataFrame, lvl: int, layout: Layout) -> tuple[DataFrame, Statistics]:
    """Answers to requests of level ``lvl``, and the sums over all keys."""
    units = lambda df: df.groupBy("grp", "cell")
    fan = layout.fan
    if lvl == layout.levels:

        def top(table: pa.Table) -> pa.Table:
            unit = Unit(table, lvl, fan)
            return _table(ANSWER, unit.answers(unit.counted, unit.held, unit.sums()))

        answers = stored(units(requests).applyInArrow(top, ANSWER))
        sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_distinct", "n_counted")]).first()
        return answers, Statistics(*map(int, sums))

    def up(key: tuple, table: pa.Table) -> pa.Table:
        unit = Unit(table, lvl, fan)
        return _table(REQUEST, _requests(key[0].as_py(), lvl + 1, fan, unit.keys, unit.counted, unit.held))

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table(ANSWER, Unit(left, lvl, fan).answers(*_read_answers(right)))

    requests = stored(requests)
    above, stats = _totals(units(requests).applyInArrow(up, REQUEST), lvl + 1, layout)
    return stored(units(requests).cogroup(units(above)).applyInArrow(down, ANSWER)), stats


def _chunk_requests(chunked: DataFrame, layout: Layout) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        data, offsets = column_bytes(table.column("text"))
        keys, n = chunk_keys(tokens_of(data, offsets, SpanHasher()), table.column("copies").to_numpy())
        chunk, none = key[0].as_py(), np.zeros(len(n), np.int64)
        counted, held = (n if layout.first[COUNTED] <= chunk < layout.first[HELD] else none), (n if chunk >= layout.first[HELD] else none)
        return _table(REQUEST, _requests(chunk, 1, layout.fan, keys, counted, held))

    return chunked.select("chunk", "text", "copies").groupBy("chunk").applyInArrow(run, REQUEST)


class Chunk:
    """Tokens of a chunk's documents with the corpus totals of their keys."""

    def __init__(self, docs: pa.Table, answers: pa.Table) -> None:
        data, offsets = column_bytes(docs.column("text"))
        self.t = tokens_of(data, offsets, SpanHasher())
        self.copies = docs.column("copies").to_numpy()
        self.keys, _ = chunk_keys(self.t, self.copies)
        self.kept, aside = _read_answers(answers)
        self.all = self.kept + aside

    def counts(self, totals: np.ndarray) -> list[np.ndarray]:
        """c(w), c(v) and c(v w) of every token."""
        return [totals[np.searchsorted(self.keys, k)].astype(np.float64) for k in (self.t.token, self.t.context, self.t.pair)]


def score(docs: DataFrame, train: Column, keep: list[str], text: str = "text", held_share: int = 10, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """``keep`` columns of every row, and the scores of its whole text under a model of the ``train`` rows.

    Added: n_tokens, n_known, train_tokens (bigint), base_score (add-one
    unigram) and score (log10 probability under the mixture). Null and empty
    texts hold the end token alone. Repeated rows come back repeated; an empty
    table gives an empty result; without training rows every token is unseen.
    Which training documents are held out follows from the hash of the text.
    ``chunk_bytes`` and ``fan`` set the memory of a task and the shape of the
    tree; they change no result.
    """
    held = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(3)), F.lit(held_share)) == 0
    role = F.when(~F.coalesce(train, F.lit(False)), SCORED).when(held, HELD).otherwise(COUNTED)
    chunked, layout = _with_chunk(docs, text, keep, role, chunk_bytes, fan)
    answers, stats = _totals(_chunk_requests(chunked, layout), 1, layout)
    aside = F.col("grp") >= layout.first[HELD]
    stats.weights = _weights(chunked.filter(F.col("role") == HELD), answers.filter(aside), stats)
    names = [f"k{i}" for i in range(len(keep))]
    kinds = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left, right)
        w, v, vw = c.counts(c.all)
        rows = len(left)
        total = lambda x: np.bincount(c.t.row, x, rows)
        base = np.log10((w + 1.0) / (stats.tokens + stats.distinct + 1.0))
        columns = {n: left.column(n) for n in (*names, "copies")}
        columns |= {"n_tokens": total(np.ones(len(w))).astype(np.int64), "n_known": total(w > 0).astype(np.int64), "train_tokens": np.full(rows, stats.tokens, np.int64), "base_score": total(base), "score": total(np.log10(probability(w, v, vw, stats)))}
        return pa.table(columns)

    schema = schema_with(chunked.select(*names, "copies"), **kinds)
    scored = chunked.drop("role").groupBy("chunk").cogroup(answers.withColumnRenamed("grp", "chunk").groupBy("chunk")).applyInArrow(run, schema)
    scored = scored.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
    scored = scored.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + COPIES, "copies") - 1)))
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *kinds)


def _weights(chunked: DataFrame, answers: DataFrame, stats: Statistics) -> np.ndarray:
    """Held-out events as a histogram of at most LEVELS x CELLS x CELLS cells, then EM."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left, right)
        w, v, vw = c.counts(c.kept)
        cell = (level(v) * CELLS + log_cell(ratio(vw, v))) * CELLS + log_cell(w / max(stats.counted_tokens, 1))
        found, at = np.unique(cell, return_inverse=True)
        return pa.table({"cell": found, "n": np.bincount(at, c.copies[c.t.row], len(found)).astype(np.int64)})

    hist = chunked.select("chunk", "text", "copies").groupBy("chunk").cogroup(answers.withColumnRenamed("grp", "chunk").groupBy("chunk")).applyInArrow(run, "cell bigint, n bigint")
    rows: pd.DataFrame = hist.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell = rows["cell"].to_numpy(np.int64)
    cells = np.stack([cell // CELLS // CELLS, cell // CELLS % CELLS, cell % CELLS], axis=1)
    return learn_weights(cells, rows["n"].to_numpy(np.float64), stats.distinct)
