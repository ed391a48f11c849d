"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
international phone numbers. The field adds spans the patterns miss: phone
numbers without a plus sign or glued to other numbers, cards with other
separators, and the like; what cannot be of its kind (a card number that fails
its check digit) is not added. It is trained on a small labelled table of
short token sequences, by exact gradients of the log-likelihood.

Words without a digit and without ``@`` always carry the label O, in training
and in decoding. A word that is fixed to O separates the chain, so decoding
each run of other words by itself gives exactly the Viterbi path of the whole
text, and only those runs are laid out in padded numpy batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import WHITESPACE, free_name, schema_with

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, split or made possessive so that no run of characters is scanned again from each of its own.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]+")
#: Punctuation around a word that is not part of a span.
OPEN, CLOSE = "\"'([{<|*#$%&", "\"')]}>,.;:!?|*#$%&"

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FORBIDDEN = -1e4


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def is_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@`` outwards."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping runs of four numbers joined by dots: a chain of more numbers is cut into fours."""
    for m in DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") >= 3:
            parts, at = chain.split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(is_byte, four)):
                    yield at, end
                at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, leftmost and non-overlapping within a kind; linear in the text."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text) is None:
        return found
    found += [(a, 1, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def core(word: str) -> tuple[int, int]:
    """Start and end of a word without the punctuation around it; brackets that have a partner inside stay."""
    a, b = 0, len(word)
    closing = word.rfind(")", 0, b - 1) if b else -1
    while a < b and word[a] in OPEN and not (word[a] == "(" and closing > a):
        a += 1
    opening = word.find("(", a)
    while b > a and word[b - 1] in CLOSE and not (word[b - 1] == ")" and 0 <= opening < b):
        b -= 1
    return a, b


def shape(word: str) -> str:
    """Runs of digits become ``d`` and their length, runs of letters ``a`` (or ``A``); the rest stays."""
    out = []
    for m in re.finditer(r"([0-9]+)|([^\W\d_]+)|(.)", word, re.DOTALL):
        if m.group(1):
            out.append(f"d{min(len(m.group(1)), 20)}")
        elif m.group(2):
            out.append("A" if m.group(2)[0].isupper() else "a")
        else:
            out.append(m.group(3))
    return "".join(out)


def features(words: list[str], before: str, after: str) -> list[list[str]]:
    """Word-shape features of each word of a run, with the words around it."""
    around = [before, *words, after]
    cores = [w[slice(*core(w))] for w in around]
    shapes = [shape(c) for c in cores]
    out = []
    for i in range(1, len(around) - 1):
        c = cores[i]
        n = sum(x.isdigit() for x in c)
        kinds = "".join(x for x in "@+().-:/_#=" if x in c)
        letters = "L" if any(x.isalpha() for x in c) else ""
        out.append([
            "bias", f"s={shapes[i]}", f"n={min(n, 21)}{letters}", f"k={kinds}{letters}", f"g={len(DIGITS.findall(c))}{letters}",
            f"p={shapes[i - 1]}", f"q={shapes[i + 1]}", f"ps={shapes[i - 1]}|{shapes[i]}", f"sq={shapes[i]}|{shapes[i + 1]}", f"open={around[i][:1] in '(+'}",
        ])
    return out


@dataclass
class Crf:
    """Weights: a row of label scores for each feature, and label-to-label scores (last row: from the start)."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray


def _allowed() -> np.ndarray:
    """Which label may follow which: I only after B or I of its kind."""
    out = np.ones((len(LABELS) + 1, len(LABELS)), bool)
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            out[:, j] = [k < len(LABELS) and LABELS[k][2:] == label[2:] and LABELS[k] != "O" for k in range(len(LABELS) + 1)]
    return out


def _padded(runs: list[list[list[int]]], emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores (run, position, label) and run lengths."""
    lengths = np.array([len(r) for r in runs])
    scores = np.zeros((len(runs), lengths.max(), len(LABELS)))
    for i, run in enumerate(runs):
        for t, found in enumerate(run):
            scores[i, t] = emit[found].sum(axis=0)
    return scores, lengths


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expected(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and transition expectations by the forward-backward algorithm, all runs at once."""
    n, most, k = scores.shape
    forward, backward = np.zeros((n, most, k)), np.zeros((n, most, k))
    forward[:, 0] = scores[:, 0] + move[-1]
    for t in range(1, most):
        forward[:, t] = _logsum(forward[:, t - 1, :, None] + move[None, :-1], 1) + scores[:, t]
    for t in range(most - 2, -1, -1):
        on = (t + 1 < lengths)[:, None]
        backward[:, t] = np.where(on, _logsum(move[None, :-1] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0.0)
    z = _logsum(forward[np.arange(n), lengths - 1], 1)
    inside = (np.arange(most) < lengths[:, None])[..., None]
    label = np.exp(np.minimum(forward + backward - z[:, None, None], 0.0)) * inside
    pairs = np.zeros_like(move)
    pairs[-1] = label[:, 0].sum(axis=0)
    for t in range(1, most):
        joint = forward[:, t - 1, :, None] + move[None, :-1] + (scores[:, t] + backward[:, t])[:, None, :] - z[:, None, None]
        pairs[:-1] += (np.exp(np.minimum(joint, 0.0)) * (t < lengths)[:, None, None]).sum(axis=0)
    return label, pairs


def fit(table: list[tuple[list[str], list[str]]], rounds: int = 100, rate: float = 0.3, l2: float = 0.02) -> Crf:
    """Train on (words, labels) rows by AdaGrad on the exact gradient, with an L2 penalty."""
    index: dict[str, int] = {}
    runs, golds = [], []
    for words, labels in table:
        for a, b in candidate_runs(words):
            found = features(words[a:b], words[a - 1] if a else "", words[b] if b < len(words) else "")
            runs.append([[index.setdefault(f, len(index)) for f in fs] for fs in found])
            golds.append([LABELS.index(x) for x in labels[a:b]])
    allowed = _allowed()
    emit, move = np.zeros((len(index) + 1, len(LABELS))), np.where(allowed, 0.0, FORBIDDEN)
    seen_emit, seen_move = np.zeros_like(emit), np.zeros_like(move)
    for run, gold in zip(runs, golds, strict=True):
        last = len(LABELS)
        for found, y in zip(run, gold, strict=True):
            seen_emit[found, y] += 1
            seen_move[last, y] += 1
            last = y
    sum_emit, sum_move = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    for _ in range(rounds):
        scores, lengths = _padded(runs, emit)
        label, pairs = _expected(scores, lengths, move)
        g_emit = seen_emit - l2 * emit
        for i, run in enumerate(runs):
            for t, found in enumerate(run):
                g_emit[found] -= label[i, t]
        g_move = np.where(allowed, seen_move - pairs - l2 * move, 0.0)
        sum_emit += g_emit**2
        sum_move += g_move**2
        emit += rate * g_emit / np.sqrt(sum_emit)
        move += np.where(allowed, rate * g_move / np.sqrt(sum_move), 0.0)
    emit[-1] = 0.0  # unknown features
    return Crf(index, emit, move)


def viterbi(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label of every position of every run, as one numpy batch."""
    n, most, _ = scores.shape
    best, back = scores[:, 0] + move[-1], np.zeros(scores.shape, np.int16)
    for t in range(1, most):
        options = best[:, :, None] + move[None, :-1]
        back[:, t] = options.argmax(axis=1)
        new = options.max(axis=1) + scores[:, t]
        best = np.where((t < lengths)[:, None], new, best)
    path = np.zeros((n, most), np.int16)
    at = best.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        path[:, t] = np.where(t < lengths, at, 0)
        at = np.where((t < lengths) & (t > 0), back[np.arange(n), t, at], at)
    return path


def candidate_runs(words: list[str]) -> list[tuple[int, int]]:
    """Maximal runs of words with a digit or ``@``."""
    runs: list[tuple[int, int]] = []
    for i, w in enumerate(words):
        if any(c.isdigit() and c.isascii() or c == "@" for c in w):
            if runs and runs[-1][1] == i:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i, i + 1))
    return runs


GAP = re.compile(r"[\x20\x09-\x0D]")
AFTER = re.compile(r"[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)")


def _runs_of(text: str) -> Iterator[tuple[list[tuple[int, int]], str, str]]:
    """Runs of candidate words of a text, with the words before and after."""
    spans: list[tuple[int, int]] = []
    for m in _candidates(text):
        if spans and text[spans[-1][1] : m[0]].strip(WHITESPACE) == "":
            spans.append(m)
            continue
        if spans:
            yield spans, *_context(text, spans)
        spans = [m]
    if spans:
        yield spans, *_context(text, spans)


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or ``@``; found from that character outwards, so other words cost nothing."""
    done = 0
    for m in re.finditer("[0-9@]", text):
        at = m.start()
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] not in WHITESPACE:
            start -= 1
        gap = GAP.search(text, at)
        done = gap.start() if gap else len(text)
        yield start, done


def _context(text: str, spans: list[tuple[int, int]]) -> tuple[str, str]:
    """The whole words before and after a run; '' at the ends of the text."""
    end = spans[0][0]
    while end > 0 and text[end - 1] in WHITESPACE:
        end -= 1
    start = end
    while start > 0 and text[start - 1] not in WHITESPACE:
        start -= 1
    after = AFTER.match(text, spans[-1][1])
    return text[start:end], after.group(1) if after else ""


#: Runs decoded in one batch, and words of a run in one padded row. Longer runs are decoded alone.
BATCH_RUNS, LONG_RUN = 4_096, 64


class Tagger:
    """Decodes candidate runs of many texts."""

    def __init__(self, crf: Crf) -> None:
        self.crf = crf

    def _scores(self, words: list[str], before: str, after: str) -> np.ndarray:
        """Emission scores of each word of a run."""
        get = lambda f: self.crf.index.get(f, -1)
        return np.stack([self.crf.emit[[get(f) for f in fs]].sum(axis=0) for fs in features(words, before, after)])

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of what the field finds in each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        held: list[tuple[int, list[tuple[int, int]], np.ndarray]] = []
        for i, text in enumerate(texts):
            for run, before, after in _runs_of(text):
                held.append((i, run, self._scores([text[a:b] for a, b in run], before, after)))
                if len(held) >= BATCH_RUNS:
                    self._decode(texts, held, out)
                    held = []
        self._decode(texts, held, out)
        return [sorted(x) for x in out]

    def _decode(self, texts: list[str], held: list, out: list) -> None:
        short = [h for h in held if len(h[1]) <= LONG_RUN]
        for batch in [short, *([h] for h in held if len(h[1]) > LONG_RUN)]:
            if not batch:
                continue
            lengths = np.array([len(h[1]) for h in batch])
            scores = np.zeros((len(batch), lengths.max(), len(LABELS)))
            for k, h in enumerate(batch):
                scores[k, : len(h[2])] = h[2]
            for (i, run, _), path in zip(batch, viterbi(scores, lengths, self.crf.move), strict=True):
                out[i] += _labelled_spans(texts[i], run, path)


def _labelled_spans(text: str, run: list[tuple[int, int]], path: np.ndarray) -> Iterator[tuple[int, int, int]]:
    t = 0
    while t < len(run):
        label = LABELS[path[t]]
        if label == "O":
            t += 1
            continue
        last = t
        while last + 1 < len(run) and LABELS[path[last + 1]] == f"I-{label[2:]}":
            last += 1
        lo, hi = core(text[run[t][0] : run[last][1]])
        a, b = run[t][0] + lo, run[t][0] + hi
        if b > a and plausible(label[2:], text[a:b]):
            yield a, KINDS.index(label[2:]), b
        t = last + 1


def plausible(kind: str, value: str) -> bool:
    """Whether the digits of a found span can be of its kind (check digit, range, length)."""
    digits = "".join(DIGITS.findall(value))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "ip":
        return all(map(is_byte, DIGITS.findall(value)))
    return "@" in value


def merge(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and those of ``more`` that touch none of them."""
    taken = sorted(base)
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    out = list(base)
    for start, kind, end in more:
        before = bisect_left(starts, end)  # base spans that begin before this one ends
        if not before or reach[before - 1] <= start:
            out.append((start, kind, end))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def all_spans(tagger: Tagger, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text the pattern matches, and those plus what the field adds; null counts as empty."""
    texts = [t or "" for t in texts]
    first = [base_spans(t) for t in texts]
    return [(b, merge(b, m)) for b, m in zip(first, tagger.spans(texts), strict=True)]


def find(docs: DataFrame, crf: Crf, text: str = "text", base: str = "pii_base", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with two arrays of (kind, start, end): pattern matches, and those plus what the field adds.

    Offsets are code points, ends exclusive; order is by start, then kind as in
    ``KINDS``. Null and empty texts have empty arrays; time is linear in the
    length of a text. Every row comes back
    once, repeated rows included; columns with the added names are replaced.
    """
    source = docs.drop(base, spans)
    at = source.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    schema = schema_with(source, **{base: SPAN, spans: SPAN})
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    column = lambda rows: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in r] for r in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            found = all_spans(tagger, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, column([x for x, _ in found]), column([x for _, x in found])], names=[*batch.schema.names, base, spans])

    return source.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its kind in brackets for each of the sorted spans; one that begins inside another only widens it."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, crf: Crf, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``find`` replaced by its kind in brackets; texts without spans (and nulls) stay as they are.

    Where spans overlap, the earlier start wins and the rest of the later one
    is covered by it. Time is linear in the length of a text.
    """
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t if t is None else masked(t, spans) for t, (_, spans) in zip(texts, all_spans(tagger, texts), strict=True)]
            yield batch.set_column(at, batch.schema.names[at], pa.array(new, batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)


def labelled_table(spark: SparkSession, rows: int = 450, seed: int = 17) -> DataFrame:
    """The small training table (words, labels), made by rule: contexts, number shapes, and look-alikes labelled O."""
    return spark.createDataFrame(training_rows(rows, seed), "words array<string>, labels array<string>")


def training_rows(rows: int = 450, seed: int = 17) -> list[tuple[list[str], list[str]]]:
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    word = lambda: pick(letters(int(rng.integers(2, 9))), letters(5).capitalize(), letters(4) + pick(",", ".", ";"))
    hexes = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))

    def entity() -> tuple[str, list[str]]:
        kind = pick("phone", "phone", "card", "card", "ip", "email")
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, pick([f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["+1", f"({a})", f"{b}-{c}"], [f"+{digits(2)}", a, b, c], [f"({a}){b}-{c}"], [f"+{digits(12)}"])
        if kind == "card":
            n = pick(14, 15, 16, 16, 16, 16, 17, 18, 19)
            return kind, pick([digits(n)], [digits(n)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))])
        if kind == "ip":
            return kind, [".".join(str(int(x)) for x in rng.integers(0, 256, 4))]
        return kind, [f"{letters(6)}{pick('', '.' + letters(4), digits(2), '.' + digits(2))}@{letters(5)}{pick('', digits(1))}.{pick('com', 'example.com', 'org')}"]

    def decoy() -> list[str]:
        return pick(
            [digits(int(rng.integers(1, 9)))], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}/{digits(2)}/{digits(4)}"], [f"{digits(2)}:{digits(2)}"],
            [f"{digits(1)}.{digits(1)}"], [f"v{digits(1)}.{digits(1)}.{digits(1)}"], [f"${digits(3)}"], [f"{digits(2)}%"], [f"{digits(1)},{digits(3)}"], [f'"{hexes(40)}"'], [hexes(32)], [f"#{digits(5)}"],
            [letters(4) + digits(3)], ["@" + letters(6)], [digits(2), digits(4)], [digits(4)], [f"{digits(3)}-{digits(2)}"], [f"{digits(1)}.{digits(1)}.{digits(1)}"], [digits(int(rng.integers(9, 14)))], [digits(int(rng.integers(20, 40)))], [f"{digits(3)},{digits(3)},{digits(3)}"], [digits(2), digits(2), digits(2)], [f"{digits(1)}.{digits(6)}"],
        )

    out = []
    for _ in range(rows):
        words: list[str] = [word() for _ in range(int(rng.integers(0, 4)))]
        labels = ["O"] * len(words)
        for _ in range(int(rng.integers(1, 3))):
            if rng.random() < 0.5:
                kind, parts = entity()
                tags = [f"B-{kind}", *[f"I-{kind}"] * (len(parts) - 1)]
            else:
                parts = decoy()
                tags = ["O"] * len(parts)
            around = pick(("", ""), ("", ""), ("", ""), ("", ","), ("", "."), ("(", ")"), ('"', '"'), ("", "###"), ("", "!!"))
            parts = [*parts[:-1], parts[-1] + around[1]]
            parts[0] = around[0] + parts[0]
            words += parts
            labels += tags
            more = [word() for _ in range(int(rng.integers(1, 4)))]
            words += more
            labels += ["O"] * len(more)
        out.append((words, labels))
    return out


def train(table: DataFrame) -> Crf:
    """Fit on a labelled table (words, labels); it is small by contract: a few thousand rows."""
    return fit([(r["words"], r["labels"]) for r in table.collect()])
