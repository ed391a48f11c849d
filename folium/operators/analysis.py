"""Analysis of manuscripts by a provider: a plan of bounded units, and a run with a cache, retries and failures as rows.

The provider is a function from requests to responses, both DataFrames, so a
model, a service or a table of answers fit. A run asks it for the units that
the cache lacks, and again for those that failed in a way that may pass, as
often as the limit admits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.operators import quality
from folium.sources.shared import stored

# Bounds of a unit, of its neighbours' context, of a book's units, and of the names and terms of a unit.
UNIT_CHARS, CONTEXT_CHARS, MOST_UNITS, MOST_NAMES, MOST_TERMS = 10_000, 800, 2_000, 24, 12
CACHE_ENTRIES, RETRIES, REASONS_SHOWN = 10_000, 2, 3
SCENE = ["book", "chapter_id", "chapter_index", "scene_id", "scene_order"]

RESPONSE = "unit_id string, status string, error string, findings array<struct<category:string,claim:string,confidence:double,evidence:array<string>>>, tokens bigint"


@dataclass(frozen=True)
class Planner:
    """The bounds of a plan."""

    unit_chars: int = UNIT_CHARS
    context_chars: int = CONTEXT_CHARS
    most_units: int = MOST_UNITS
    most_names: int = MOST_NAMES
    most_terms: int = MOST_TERMS

    def fingerprint(self) -> str:
        parts = ("planner", self.unit_chars, self.context_chars, self.most_units, self.most_names, self.most_terms)
        return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def _groups(sizes: Column, limit: int) -> Column:
    """Number of the group that each paragraph of a scene falls into, by the lengths of the paragraphs in order."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("groups"))

    def step(acc: Column, n: Column) -> Column:
        full = (F.size(acc["groups"]) > 0) & (acc["used"] + n > limit)
        at = F.when(full, acc["at"] + 1).otherwise(acc["at"])
        return F.struct(F.when(full, n).otherwise(acc["used"] + n).alias("used"), at.alias("at"), F.array_append(acc["groups"], at).alias("groups"))

    return F.aggregate(sizes, start, step, lambda acc: acc["groups"])


def with_context(scenes: DataFrame, chars: int) -> DataFrame:
    """Scenes (with their paragraphs ``p``) with previous_context and next_context: the beginnings of the scenes around in the chapter, null at its ends."""
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    head = F.when(F.length(whole) > chars, F.concat(F.left(whole, F.lit(chars)), F.lit(" …"))).otherwise(whole)
    along = Window.partitionBy("book", "chapter_id").orderBy("scene_order", "scene_id")
    return scenes.withColumn("head", head).withColumns({"previous_context": F.lag("head").over(along), "next_context": F.lead("head").over(along)}).drop("head")


def present(units: DataFrame, entries: DataFrame, most: int, name: str) -> DataFrame:
    """``units`` with the first ``most`` entries (position, value) that the unit's text holds, case ignored, in their order, as ``name``.

    Entries are a small table that is broadcast, so that texts aren't shuffled
    to meet them; blank ones are left out.
    """
    entry = F.struct("position", "value", F.lower("value").alias("low"))
    listed = entries.filter(F.trim("value") != "").agg(F.array_sort(F.collect_list(entry)).alias("__entries"))
    low = units.withColumn("__low", F.lower("text_content")).join(F.broadcast(listed), F.lit(True))
    hits = F.slice(F.filter("__entries", lambda e: F.contains(F.col("__low"), e["low"])), 1, most)
    return low.withColumn(name, F.transform(hits, lambda e: e["value"])).drop("__low", "__entries")


def plan_units(paragraphs: DataFrame, names: DataFrame, terms: DataFrame, planner: Planner = Planner()) -> DataFrame:
    """Units of neighbouring paragraphs of one scene, none of them split, of at most ``unit_chars`` characters unless one paragraph is longer.

    ``paragraphs``: book, chapter_id, chapter_index, scene_id, scene_order,
    position (from 1 in a scene), paragraph_id, text; ``names`` and ``terms``:
    position, value. A unit's text has each paragraph behind its mark
    (``[para-3]``); its id follows from chapter, scene, number and text. Null
    texts count as empty; an empty table gives no units. Texts are shuffled
    once, by chapter: scenes, the scenes around and units are made there.
    """
    rows = paragraphs.withColumn("text", F.coalesce("text", F.lit(""))).repartition("book", "chapter_id")
    scenes = rows.groupBy(*SCENE).agg(F.array_sort(F.collect_list(F.struct("position", "paragraph_id", "text"))).alias("p"))
    around = with_context(scenes, planner.context_chars).withColumn("groups", _groups(F.transform("p", lambda x: F.length(x["text"])), planner.unit_chars))
    member = lambda k: F.filter("p", lambda x, i: F.get("groups", i) == k)
    parts = around.select(*SCENE, "previous_context", "next_context", F.posexplode(F.transform(F.sequence(F.lit(0), F.array_max("groups")), member)).alias("chunk", "p"))
    mark = lambda x: F.concat(F.lit("[para-"), x["position"].cast("string"), F.lit("] "), x["text"])
    units = parts.select(*SCENE, "chunk", F.array_join(F.transform("p", mark), "\n\n").alias("text_content"), F.transform("p", lambda x: x["paragraph_id"]).alias("paragraph_ids"), F.transform("p", lambda x: F.concat(F.lit("para-"), x["position"].cast("string"))).alias("ordinals"), "previous_context", "next_context")
    units = units.withColumn("text_fingerprint", F.sha2("text_content", 256))
    identity = F.concat_ws("\0", "chapter_id", "scene_id", F.col("chunk").cast("string"), "text_fingerprint")
    out = units.withColumn("unit_id", F.concat(F.lit("unit-"), F.sha2(identity, 256)))
    for entries, most, name in ((names, planner.most_names, "known_names"), (terms, planner.most_terms, "known_terms")):
        out = present(out, entries, most, name)
    return out


def oversize_books(units: DataFrame, most: int = MOST_UNITS) -> DataFrame:
    """(book, units) of the books whose plan has more units than the limit; nothing of them may be sent."""
    return units.groupBy("book").agg(F.count(F.lit(1)).alias("units")).filter(F.col("units") > most)


def cache_key(*parts: Column) -> Column:
    """Key of a cached answer: schema, prompt, provider, model, configuration, canon and unit."""
    if len(parts) != 7:
        raise ValueError("a cache key has seven parts")
    return F.concat(F.lit("cache-"), F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256))


@dataclass
class Run:
    """What a run leaves: outcomes of all units, valid findings, rejected ones by unit, and the cache to keep."""

    outcomes: DataFrame
    findings: DataFrame
    warnings: DataFrame
    cache: DataFrame
    attempts: int = field(default=0)


def run(units: DataFrame, cache: DataFrame, provider: Callable[[DataFrame, int], DataFrame], identity: list[str], categories: list[str], stored_at: Column, retries: int = RETRIES, entries: int | None = CACHE_ENTRIES) -> Run:
    """Asks ``provider(requests, attempt)`` for the units that the cache lacks; it returns rows of RESPONSE.

    ``identity`` has the six parts of the cache key before the unit; ``cache``
    has key, unit_id, findings and stored_at. Answers with status ``retryable``
    are asked for again up to ``retries`` times; what is left then, other
    statuses and units without an answer are failed units. Findings are checked
    against the unit's own paragraph marks before they are kept. The cache
    keeps the newest ``entries`` answers (None: all). ``units`` is read several
    times and should be a stored table; texts are not written again.
    """
    key = cache_key(*[F.lit(x) for x in identity], F.col("unit_id"))
    keyed = units.withColumn("key", key)
    old = cache.groupBy("key").agg(F.max_by(F.struct("findings", "stored_at"), F.col("stored_at")).alias("x")).select("key", "x.findings")
    looked = stored(keyed.select("unit_id", "key").join(old.withColumn("hit", F.lit(True)), "key", "left").select("unit_id", "findings", "hit"))
    known, asked = looked.filter("hit"), looked.filter("hit IS NULL").select("unit_id")
    answers, attempt = None, 0
    while True:
        todo = keyed.join(asked, "unit_id", "left_semi")
        answer = provider(todo, attempt).withColumn("findings", F.when(F.col("status") == "ok", F.col("findings")))
        got = stored(asked.join(answer, "unit_id", "left").select("unit_id", F.coalesce("status", F.lit("missing")).alias("status"), "error", "findings", "tokens", F.lit(attempt + 1).alias("attempts")))
        final = (F.col("status") != "retryable") | F.lit(attempt >= retries)
        answers = got.filter(final) if answers is None else answers.unionByName(got.filter(final))
        again = got.filter(~final)
        attempt += 1
        if attempt > retries or not again.limit(1).count():
            break
        asked = again.select("unit_id")
    fresh = answers.filter("status = 'ok'")
    raw = known.select("unit_id", F.explode("findings").alias("f"), F.lit(True).alias("cached")).unionByName(fresh.select("unit_id", F.explode("findings").alias("f"), F.lit(False).alias("cached")))
    supplied = keyed.select("unit_id", F.col("ordinals").alias("known"))
    checked = stored(quality.validate_findings(raw.select("unit_id", "f.*", "cached"), supplied, categories))
    none = lambda kind: F.lit(None).cast(kind)
    outcome = F.when(F.col("status") == "ok", "succeeded").otherwise("failed")
    outcomes = answers.select("unit_id", outcome.alias("outcome"), "attempts", F.when(F.col("status") != "ok", F.coalesce("error", "status")).alias("error"), F.when(F.col("status") != "ok", F.col("status") == "retryable").alias("retryable"), "tokens")
    outcomes = outcomes.unionByName(known.select("unit_id", F.lit("cached").alias("outcome"), F.lit(0).alias("attempts"), none("string").alias("error"), none("boolean").alias("retryable"), none("bigint").alias("tokens")))
    rejected = checked.filter("reason IS NOT NULL AND NOT cached").groupBy("unit_id").agg(F.count(F.lit(1)).alias("rejected"), F.slice(F.array_sort(F.collect_set("reason")), 1, REASONS_SHOWN).alias("reasons"))
    warnings = rejected.select("unit_id", F.concat(F.lit("unit "), "unit_id", F.lit(": rejected "), F.col("rejected").cast("string"), F.lit(" provider finding(s) ("), F.array_join("reasons", "; "), F.lit(")")).alias("warning"))
    valid = checked.filter("reason IS NULL").select("unit_id", "category", "claim", "confidence", "evidence", "level", "cached")
    kept = valid.filter("NOT cached").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("category", "claim", "confidence", "evidence"))).alias("findings"))
    empty = F.array().cast("array<struct<category:string,claim:string,confidence:double,evidence:array<string>>>")
    new = fresh.select("unit_id").join(kept, "unit_id", "left").select(key.alias("key"), "unit_id", F.coalesce("findings", empty).alias("findings"), stored_at.alias("stored_at"))
    newest = cache.select("key", "unit_id", "findings", "stored_at").unionByName(new)
    if entries is not None:
        newest = newest.orderBy(F.desc("stored_at"), "key").limit(entries)
    return Run(outcomes, valid, warnings, newest, attempt)


def run_summary(result: Run) -> DataFrame:
    """One row: units, succeeded (cached ones too), cached, failed, findings, warnings, tokens."""
    units = result.outcomes.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("outcome") != "failed").alias("succeeded"), F.count_if(F.col("outcome") == "cached").alias("cached"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return units.join(result.findings.agg(F.count(F.lit(1)).alias("findings")), F.lit(True)).join(result.warnings.agg(F.count(F.lit(1)).alias("warnings")), F.lit(True))
