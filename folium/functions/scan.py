"""Scanners: typography findings (JVM-side), and quotes, name candidates and chunks as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folium.functions.text import ARABIC_BLOCKS, ARABIC_DIGITS, ARABIC_LETTERS, HONORIFICS, NAME_STOPWORDS, PERSIAN_DIGITS, PERSIAN_LETTERS, SPACING_PUNCTUATION, TATWEEL, ZWNJ

FINDING = "array<struct<kind:string,char_index:int,suggestion:string>>"
#: Characters of texts whose results a task holds as Python values at once.
SLICE_CHARS = 1 << 20


def _lists(texts: pa.Array, scan: Callable[[str | None], list], kind: pa.DataType) -> pa.Array:
    """What ``scan`` finds in each text; texts become Python values one at a time, and their results Arrow's every ``SLICE_CHARS``."""
    done, held, size = [], [], 0
    for text in texts:
        value = text.as_py()
        held.append(scan(value))
        size += 64 + len(value or "")
        if size >= SLICE_CHARS:
            done.append(pa.array(held, pa.list_(kind)))
            held, size = [], 0
    return pa.concat_arrays([*done, pa.array(held, pa.list_(kind))])


def _scanned(scan: Callable[[str | None], list], kind: pa.DataType, returns: str) -> Callable[[Column | str], Column]:
    def lists(texts: pa.Array) -> pa.Array:
        return _lists(texts, scan, kind)

    return F.arrow_udf(lists, returns)


def typography(text: Column) -> Column:
    """Findings (kind, char_index, suggestion) of Persian typography, by position; text without any gives an empty array."""
    chars = F.split(text, "")
    at = lambda i: F.get(chars, i)
    blank = lambda c: F.rlike(c, F.lit(r"(?U)^\s$"))
    closing = lambda c: F.rlike(c, F.lit(f"^[{SPACING_PUNCTUATION}]$"))

    def look(c: Column, i: Column) -> Column:
        before, after = at(i - 1), at(i + 1)
        outside = lambda x: x.isNull() | (x == "") | blank(x) | closing(x)
        kind = (
            F.when(c == "", F.lit(None).cast("string"))
            .when(F.contains(F.lit(ARABIC_LETTERS), c), "arabic_letter_variant")
            .when(F.contains(F.lit(ARABIC_DIGITS), c), "arabic_digit_variant")
            .when(c == TATWEEL, "kashida")
            .when((c == ZWNJ) & (before == ZWNJ), "duplicate_zwnj")
            .when((c == ZWNJ) & (outside(before) | outside(after)), "invalid_zwnj")
            .when((c == " ") & (before == " ") & (F.coalesce(at(i - 2), F.lit("")) != " "), "multiple_spaces")
            .when((c == " ") & closing(F.coalesce(after, F.lit(""))), "space_before_punctuation")
            .when((c == " ") & _prefix_before(text, i), "prefix_spacing")
        )
        swap = F.translate(c, ARABIC_LETTERS + ARABIC_DIGITS, PERSIAN_LETTERS + PERSIAN_DIGITS)
        suggestion = F.when(kind.isin("arabic_letter_variant", "arabic_digit_variant"), swap).when(kind == "prefix_spacing", F.lit(ZWNJ)).when(kind == "multiple_spaces", F.lit(" ")).otherwise("")
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), i.cast("int").alias("char_index"), suggestion.alias("suggestion")))

    return F.filter(F.transform(chars, look), lambda x: x.isNotNull()).cast(FINDING)


def _prefix_before(text: Column, i: Column) -> Column:
    """Whether the characters before position ``i`` end in a verb prefix that stands alone."""
    near = F.substring(text, F.greatest(i - 4, F.lit(0)) + 1, F.least(i, F.lit(4)))
    return F.rlike(near, F.lit(r"(?U)(^|\s)(می|نمی)$"))


def _is_name(token: str) -> bool:
    return token[0].isupper() and any(c.isalpha() for c in token[1:])


_EDGE = re.compile(r"^[^\w'’-]+|[^\w'’-]+$")
_WORD = re.compile(r"[\W_]+")


def _candidates(text: str | None) -> list[str]:
    """Runs of up to three capitalised words; a mark after a word ends its run."""
    found, run = [], []

    def close() -> None:
        if run:
            kept = run[1:] if len(run) > 1 and run[0].rstrip(".").lower() in HONORIFICS else run[:]
            name = " ".join(kept)
            if _WORD.sub(" ", name.lower()).strip() not in NAME_STOPWORDS:
                found.append(name)
            run.clear()

    for raw in (text or "").split():
        token = _EDGE.sub("", raw).strip("_")
        if not token:
            continue
        if not _is_name(token):
            close()
            continue
        if len(run) == 3:
            close()
        run.append(token)
        if raw[-1] in '.,!?؟;:"”’':
            close()
    close()
    return found


def name_candidates(text: Column | str) -> Column:
    """Capitalised name candidates of each text, in order, repeats included."""
    return _scanned(_candidates, pa.string(), "array<string>")(text)


# The styles of quotes with their marks, in the order in which spans of one place are kept, and the mark of a line of speech.
QUOTE_MARKS = (("straight_double", '"', '"'), ("curly_double", "“", "”"), ("curly_single", "‘", "’"), ("guillemets", "«", "»"))
SPEECH_DASH = "—"
_PAIRED = tuple((style, re.compile(f"{a}([^{b}]*){b}")) for style, a, b in QUOTE_MARKS)
#: Characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _quotes(text: str | None) -> list[dict]:
    """Spans between marks, and lines that a dash begins and that hold no span between marks; linear in the text."""
    text = text or ""
    spans = {}
    for style, pair in _PAIRED:
        for m in pair.finditer(text):
            spans.setdefault(m.span(1), style)
    if SPEECH_DASH in text:
        paired = sorted(spans)
        least = [end for _, end in paired]  # the least end among the spans from here on
        for i in range(len(least) - 2, -1, -1):
            least[i] = min(least[i], least[i + 1])
        start, k = 0, 0
        for line in text.split("\n"):
            end = start + len(line)
            while k < len(paired) and paired[k][0] < start:
                k += 1
            inner = line.lstrip(WHITE_SPACE)
            if inner.startswith(SPEECH_DASH) and not (k < len(paired) and least[k] <= end):
                said = inner[1:].lstrip(WHITE_SPACE)
                if said:
                    spans.setdefault((end - len(said), end), "leading_dash")
            start = end + 1
    return [{"start": a, "end": b, "style": spans[a, b], "quote": text[a:b]} for a, b in sorted(spans)]


def quotes(text: Column | str) -> Column:
    """Quoted spans (start, end, style, quote) without their marks, in code points, end exclusive, by start.

    An opening mark goes with the next closing one of its style; a line that a
    dash begins is speech from behind the dash on, unless a span between marks
    stands in it. Of several spans at one place the first style counts. Null
    and empty texts have none.
    """
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("style", pa.string()), ("quote", pa.string())])
    return _scanned(_quotes, kind, "array<struct<start:int,end:int,style:string,quote:string>>")(text)


# Marks that end a sentence, and marks that may follow them.
TERMINATORS, CLOSERS = ".!?؟。！？", "\"'”’»)]}"


def _ends_sentence(part: str) -> bool:
    return part.rstrip().rstrip(CLOSERS)[-1:] in tuple(TERMINATORS)


def _cut_at(window: str, size: int) -> int:
    """Where to cut a full window: behind a paragraph break in its last 40 %, at its end if that ends a sentence, behind a sentence in its last 40 %, behind whitespace, else at its end."""
    least = size * 3 // 5
    breaks = [at + len(mark) for mark in ("\r\n\r\n", "\n\n") if (at := window.rfind(mark)) >= 0 and at + len(mark) >= least]
    if breaks:
        return max(breaks)
    if len(window.rstrip()) >= least and _ends_sentence(window):
        return len(window)
    spaces = [i for i in range(len(window) - 1, -1, -1) if window[i].isspace()]
    return next((i + 1 for i in spaces if i >= least and _ends_sentence(window[:i])), spaces[0] + 1 if spaces else len(window))


def _split(text: str | None, size: int) -> list[str]:
    out, text = [], text or ""
    at = 0
    while len(text) - at > size:
        step = _cut_at(text[at : at + size], size)
        out.append(text[at : at + step])
        at += step
    return out + ([text[at:]] if at < len(text) else [])


def passages(text: Column, size: int = 24_000) -> Column:
    """Chunks of at most ``size`` code points whose concatenation is the text; empty and null texts have none."""
    return _scanned(lambda t: _split(t, size), pa.string(), "array<string>")(text)


def persian_letters(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{ARABIC_BLOCKS}]"))
