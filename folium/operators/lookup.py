"""Plain lookups by substrings of normalised texts: memory search, glossary entries, characters, relationships and missing terms.

Entries are a stated set, looked for in blocks of ``BLOCK`` that are broadcast,
so a text is scanned once a block, whatever the number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import tokens

BLOCK = 2_000
# Weight of the context, and what one text inside the other adds.
CONTEXT_WEIGHT, INSIDE = 0.35, 0.25


def plain(text: Column) -> Column:
    """Lower-case letters and digits, anything else a blank; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def plain_similarity(a: Column, b: Column) -> Column:
    """Of two ``plain`` texts: 1 if equal, else the share of common words and ``INSIDE`` if one holds the other, 1 at most; empty ones are like nothing."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    common = F.size(F.array_intersect(x, y))
    share = common / (F.size(x) + F.size(y) - common).cast("double")
    inside = F.when(F.contains(a, b) | F.contains(b, a), INSIDE).otherwise(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.least(share + inside, F.lit(1.0)))


def _blocks(entries: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each block of entries, as an array."""
    block = F.floor(F.pmod(F.xxhash64(*columns), F.lit(max(1, -(-entries.count() // BLOCK)))))
    return F.broadcast(entries.groupBy(block.alias("__block")).agg(F.collect_list(F.struct(*columns)).alias("__entries")).select("__entries"))


def held(texts: DataFrame, entries: DataFrame, unit: str, text: str, phrase: str, carried: list[str]) -> DataFrame:
    """(unit, *carried) of the entries whose phrase stands in a text as a substring; empty phrases stand in none."""
    named = entries.select(plain(F.col(phrase)).alias("__key"), *carried).filter("__key <> ''")
    pairs = texts.select(unit, plain(F.col(text)).alias("__t")).join(_blocks(named, ["__key", *carried]), F.lit(True))
    hits = pairs.select(unit, F.explode(F.filter("__entries", lambda e: F.contains(F.col("__t"), e["__key"]))).alias("__e"))
    return hits.select(unit, *[F.col(f"__e.{c}") for c in carried]).distinct()


def search(queries: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, entry_id, score): the best ``limit`` entries (entry_id, source, context) of each query (query_id, query) with a score above 0.

    The score is the similarity of query and source plus ``CONTEXT_WEIGHT``
    times that of query and context, 1 at most; equal ones go by id. Queries
    are a stated set, broadcast in blocks; each task keeps a partial best.
    """
    asked = _blocks(queries.select("query_id", plain(F.col("query")).alias("q")).filter("q <> ''"), ["query_id", "q"])
    known = entries.select("entry_id", plain(F.col("source")).alias("s"), plain(F.col("context")).alias("c"))
    pairs = known.join(asked, F.lit(True)).select("entry_id", "s", "c", F.explode("__entries").alias("e")).select("entry_id", "s", "c", "e.*")
    score = F.least(plain_similarity(F.col("q"), F.col("s")) + plain_similarity(F.col("q"), F.col("c")) * CONTEXT_WEIGHT, F.lit(1.0))
    scored = pairs.select("query_id", "entry_id", F.round(score, 6).alias("score")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "rank", "entry_id", "score")


def characters_in(texts: DataFrame, characters: DataFrame, aliases: DataFrame, unit: str = "unit_id", text: str = "text") -> DataFrame:
    """(unit, name) of the characters whose name or an alias stands in a text; ``aliases`` has name and alias."""
    names = characters.select("name", F.col("name").alias("phrase")).unionByName(aliases.select("name", F.col("alias").alias("phrase")))
    return held(texts, names, unit, text, "phrase", ["name"])


def relationships_among(found: DataFrame, relationships: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, a, b) of the relationships whose two ends are among a unit's characters; names are compared in plain form."""
    names = found.select(unit, plain(F.col("name")).alias("__n")).distinct()
    keyed = relationships.select("a", "b", plain(F.col("a")).alias("__a"), plain(F.col("b")).alias("__b"))
    left, right = names.withColumnRenamed("__n", "__a"), names.withColumnRenamed("__n", "__b")
    return keyed.join(left, "__a").join(right, [unit, "__b"]).select(unit, "a", "b")


def missing_preferred(pairs: DataFrame, glossary: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, source_term, message) of glossary entries whose term a source holds and whose preferred wording the translation (source, output) lacks; blank wordings are never missing."""
    entries = glossary.select("source_term", "preferred_translation")
    hits = held(pairs, entries, unit, "source", "source_term", ["source_term", "preferred_translation"])
    both = hits.join(pairs.select(unit, plain(F.col("output")).alias("__o")), unit)
    wanted = plain(F.col("preferred_translation"))
    message = F.concat(F.lit("Preferred glossary translation '"), "preferred_translation", F.lit("' is missing for source term '"), "source_term", F.lit("'."))
    return both.filter((wanted != "") & ~F.contains("__o", wanted)).select(unit, "source_term", message.alias("message"))


def consistency_score(issues: Column) -> Column:
    """A tenth less for each issue, 0 at least."""
    return F.greatest(F.round(1.0 - issues * 0.1, 6), F.lit(0.0))


def blank_translations(entries: DataFrame, source: str = "source", translation: str = "translation") -> DataFrame:
    """(message): an issue for each entry without a translation."""
    return entries.filter(F.trim(F.coalesce(F.col(translation), F.lit(""))) == "").select(F.concat(F.lit("Missing translation for: "), F.col(source)).alias("message"))
