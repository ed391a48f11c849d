"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Each rule is a rejecting condition on a text and its words. On a bounded
sample the cost (CPU work of the rule alone) and selectivity (share rejected)
of every rule are estimated; the rules then stand in one CASE expression in
the order of rejection per cost, so that most bad texts meet a cheap,
selective rule first and the others are not evaluated for them. Texts that a
condition given beforehand rejects meet no rule. The order never changes a
verdict.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import WHITESPACE, cut, free_name, words_of

#: Rows of the sample that orders the rules; how often a job evaluates a rule on each row, and how often the job runs.
SAMPLE_ROWS, REPEATS, RUNS = 1_000, 8, 3
LOG = logging.getLogger(__name__)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)``: true for texts that the rule turns away; never null."""

    name: str
    rejects: Callable[[Column, Column], Column]


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))


def lines_with_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "")


def duplicate_lines(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


#: The production rules; limits are shares of the words or lines of a text.
RULES = (
    Rule("symbols", lambda t, w: symbols(t) * 10 > F.size(w) * 3),
    Rule("shouting", lambda t, w: F.regexp_count(t, F.lit("!!")) * 10 > F.size(w) * 3),
    Rule("duplicate_lines", lambda t, w: duplicate_lines(lines_with_word(t)) * 10 > F.size(lines_with_word(t)) * 5),
    Rule("word_length", lambda t, w: (F.length(F.concat_ws("", w)) < F.size(w) * 2) | (F.length(F.concat_ws("", w)) > F.size(w) * 20)),
    Rule("no_letters", lambda t, w: ~F.rlike(t, F.lit(r"\p{L}"))),
)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a generator keeps Catalyst from inlining it into lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def measure(docs: DataFrame, text: str, rules: tuple[Rule, ...], rows: int, facts: Callable[[DataFrame], DataFrame]) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule on a random sample of about ``rows`` rows.

    A job evaluates a rule on ``REPEATS`` copies of every row. The first run of
    each job is left out, as code is compiled in it; from the median of the
    others the median of a job without a rule is taken off.
    """
    sample = facts(docs.sample(min(1.0, rows / max(docs.count(), 1)), seed=1))
    t, w, n = (free_name(sample, x) for x in ("body", "word_list", "copy"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sample = cut(sample.withColumns({t: body, w: words_of(body)}))
    copies = sample.withColumn(n, F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    none = ("", lambda t, w: F.lit(False))
    jobs = {name: copies.agg(F.count(n), F.count_if(rejects(F.col(t), F.col(w)))) for name, rejects in (none, *((r.name, r.rejects) for r in rules))}
    took: dict[str, list[float]] = {name: [] for name in jobs}
    share = {}
    for turn in range(RUNS + 1):
        for name, job in jobs.items():
            began = time.perf_counter()
            n, rejected = job.first()
            share[name] = rejected / max(n, 1)
            if turn:
                took[name].append(time.perf_counter() - began)
    idle = median(took[""])
    return [(r.name, max(median(took[r.name]) - idle, 1e-4), share[r.name]) for r in rules]


def ordered(measured: list[tuple[str, float, float]], rules: tuple[Rule, ...]) -> list[Rule]:
    """Rules by rejection per cost, greatest first; equal ones by name."""
    gain = {name: share / max(seconds, 1e-6) for name, seconds, share in measured}
    order = sorted(rules, key=lambda r: (-gain[r.name], r.name))
    LOG.info("order of rules: %s", ", ".join(f"{r.name} ({gain[r.name]:.3g})" for r in order))
    return order


def verdict(order: list[Rule], text: Column, words: Column) -> Column:
    """True unless one of the rules rejects; later rules are not evaluated once one does."""
    out = None
    for rule in order:
        rejects = rule.rejects(text, words)
        out = F.when(rejects, False) if out is None else out.when(rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the number of words covered by windows of five words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only texts with a repeat sort their
    windows; positions of equal neighbours are then covered from left to right.
    """
    h, p, q = (free_name(df, x) for x in ("window_hash", "window_at", "repeat_at"))
    n, none = F.size(words), F.array().cast("array<bigint>")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(words), i, WINDOW)))
    out = once(df, h, F.when(n >= WINDOW, windows).otherwise(none))
    pairs = F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    out = once(out, p, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.coalesce(F.get(F.col(p), j)["h"] == x["h"], F.lit(False))
    repeats = F.filter(F.col(p), lambda x, j: (same(x, j - 1)) | same(x, j + 1))
    out = once(out, q, F.sort_array(F.transform(repeats, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.col(q), start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return out.withColumn(name, covered.cast("long")).drop(h, p, q)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, name: str = "kept", facts: Callable[[DataFrame], DataFrame] = lambda df: df, rejected: Column | None = None) -> DataFrame:
    """``docs`` with a boolean column ``name``: false where ``rejected`` holds already or a rule rejects the text.

    ``facts`` may add columns that the rules (and ``rejected``) use; they stay.
    Null and empty texts have no words and no letters, and are rejected by
    ``no_letters``. Every row comes back once, repeated rows included; an empty
    table gives an empty result; a column called ``name`` is replaced.
    """
    order = ordered(measure(docs, text, rules, sample_rows, facts), rules)
    out = facts(docs.drop(name))
    t, w = free_name(out, "body"), free_name(out, "word_list")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = once(out.withColumn(t, body), w, words_of(body))
    kept = verdict(order, F.col(t), F.col(w))
    return out.withColumn(name, kept if rejected is None else F.when(rejected, False).otherwise(kept)).drop(t, w)


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the word, symbol, line and repeat counts of each whole text (bigint; null text: none)."""
    t, w, ln = (free_name(docs, x) for x in ("body", "word_list", "line_list"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = once(once(docs.withColumn(t, body), w, words_of(body)), ln, lines_with_word(body))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"), "word_chars": F.length(F.concat_ws("", w)).cast("long"),
        "n_symbols": symbols(F.col(t)).cast("long"), "n_dup_lines": duplicate_lines(F.col(ln)).cast("long"), "n_lines": F.size(ln).cast("long"),
    }).drop(ln, t)
    return repeated_words(out, w, "n_repeat_words").drop(w)


def counted_rules(n_words: str = "n_words", word_chars: str = "word_chars", n_symbols: str = "n_symbols", n_dup_lines: str = "n_dup_lines", n_lines: str = "n_lines") -> tuple[Rule, ...]:
    """``RULES`` for rows that have the counts of ``digest`` already: the same verdicts, nothing counted twice."""
    c, n = F.col, F.col(n_words)
    known = {
        "symbols": lambda t, w: c(n_symbols) * 10 > n * 3, "duplicate_lines": lambda t, w: c(n_dup_lines) * 10 > c(n_lines) * 5,
        "word_length": lambda t, w: (c(word_chars) < n * 2) | (c(word_chars) > n * 20),
    }
    return tuple(Rule(r.name, known.get(r.name, r.rejects)) for r in RULES)
