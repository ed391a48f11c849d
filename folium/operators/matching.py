"""Phrase, name and key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.ids import confidence, stable_id
from folium.functions.text import ngrams, normalize_case_insensitive, tokens
from folium.operators.pairs import counted_pairs, numbered
from folium.sources.shared import stored

#: Term rows that may be broadcast; larger term tables are shuffled on the phrase.
BROADCAST_ROWS = 200_000


def phrase_hits(docs: DataFrame, terms: DataFrame, doc_id: str, text: str, term_id: str, term: str) -> DataFrame:
    """Distinct (doc_id, term_id) where the text holds the term as a whole phrase of words.

    Terms are found by an equi-join on word n-grams of the lengths that terms
    have, not by comparing each text with each term.
    """
    phrases = terms.select(F.col(term_id), normalize_case_insensitive(F.col(term)).alias("phrase")).filter("phrase <> ''")
    phrases = phrases.withColumn("n", F.size(tokens(F.col("phrase"))))
    lengths = [r[0] for r in phrases.select("n").distinct().orderBy("n").collect()]
    rows = phrases.count()
    words = docs.select(F.col(doc_id), tokens(normalize_case_insensitive(F.col(text))).alias("w"))
    grams = words.select(doc_id, F.explode(F.array_distinct(F.concat(*[ngrams(F.col("w"), n) for n in lengths or [1]]))).alias("phrase"))
    side = phrases.select(term_id, "phrase")
    return grams.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, "phrase").select(doc_id, term_id).distinct()


def longest_first(terms: DataFrame, term: str) -> list[Column]:
    """Sort order of terms: more words, then more bytes, then the term itself."""
    t = normalize_case_insensitive(F.col(term))
    return [F.size(tokens(t)).desc(), F.octet_length(t).desc(), F.col(term)]


def alias_index(profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, name, display): normalised names and aliases; a name beats an alias of the same key, then the least name."""
    own = profiles.select(F.col("name"), F.col("name").alias("display"), F.lit(0).alias("rank"))
    more = aliases.select(F.col("canonical_name").alias("name"), F.col("alias").alias("display"), F.lit(1).alias("rank"))
    keyed = own.unionByName(more).withColumn("key", normalize_case_insensitive(F.col("display"))).filter("key <> ''")
    best = F.row_number().over(Window.partitionBy("key").orderBy("rank", "name", "display"))
    return keyed.withColumn("r", best).filter("r = 1").select("key", "name", "display")


def add_aliases(proposed: DataFrame, profiles: DataFrame, aliases: DataFrame, position: str = "position") -> DataFrame:
    """(position, canonical_name, alias, outcome, owner): aliases added in the order of their unique ``position``, each checked against the names and aliases that stand by then.

    outcome: empty_name, empty_alias, unchanged (a character's own name, or
    theirs already), collision (another's name or alias) or inserted. Additions
    of one alias only meet each other, so its first sound one is found by an
    aggregate and no key is worked off in one task.
    """
    norm = lambda c: F.coalesce(normalize_case_insensitive(F.col(c)), F.lit(""))
    rows = proposed.select(F.col(position).alias("position"), "canonical_name", "alias").withColumns({"key": norm("alias"), "who": norm("canonical_name")})
    rows = rows.withColumn("settled", F.when(F.col("who") == "", "empty_name").when(F.col("key") == "", "empty_alias").when(F.col("key") == F.col("who"), "unchanged"))
    first = rows.filter("settled IS NULL").groupBy("key").agg(F.min(F.struct("position", "canonical_name", "who")).alias("f"))
    known = alias_index(profiles, aliases).select("key", F.col("name").alias("known"))
    joined = rows.join(first.join(known, "key", "left"), "key", "left")
    new = F.col("known").isNull() & (F.col("f.position") == F.col("position"))
    theirs = F.coalesce(normalize_case_insensitive(F.col("known")), F.col("f.who")) == F.col("who")
    outcome = F.coalesce("settled", F.when(new, "inserted").when(theirs, "unchanged").otherwise("collision"))
    return joined.withColumn("outcome", outcome).select("position", "canonical_name", "alias", "outcome", F.when(F.col("outcome") == "collision", F.coalesce("known", "f.canonical_name")).alias("owner"))


def known_profiles(docs: DataFrame, profiles: DataFrame, aliases: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (doc_id, name) of the profiles that a text mentions by name or alias."""
    index = alias_index(profiles, aliases)
    return phrase_hits(docs, index, doc_id, text, "name", "display")


def relationships_present(mentions: DataFrame, relationships: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, a, b, ...) of the relationships whose two ends are both mentioned."""
    left, right = mentions.select(doc_id, F.col("name").alias("a")), mentions.select(doc_id, F.col("name").alias("b"))
    return relationships.join(left, "a").join(right, [doc_id, "b"])


def unknown_names(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose normalised name stands in no alias index."""
    return names.withColumn("__key", normalize_case_insensitive(F.col(name))).join(index.select(F.col("key").alias("__key")), "__key", "left_anti").drop("__key")


def merge_short_names(names: DataFrame) -> DataFrame:
    """(name, n, aliases) with one-word names merged into the only longer name that holds them.

    ``names`` has normalised ``name`` and count ``n``. A word that occurs in
    several longer names, or in none, stays a name of its own.
    """
    long_ = names.filter(F.contains("name", F.lit(" "))).select(F.col("name").alias("full"), F.explode(F.array_distinct(F.split("name", " "))).alias("name"))
    # words are counted before the join, so a word of very many names is one row there
    only = long_.groupBy("name").agg(F.count(F.lit(1)).alias("hits"), F.min("full").alias("full")).filter("hits = 1")
    mapped = names.join(only.select("name", "full"), "name", "left")
    root = F.coalesce("full", "name")
    return mapped.groupBy(root.alias("name")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("full").isNotNull(), F.col("name")))).alias("aliases"))


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def co_occurrence(mentions: DataFrame, unit: str, name: str, evidence: int = 8) -> DataFrame:
    """(a, b, n, evidence): pairs of names in the same unit, their number of units and the first few of them.

    Names are numbered and distinct within a unit before they pair.
    """
    rows = stored(mentions.select(F.col(unit).alias("unit"), F.col(name).alias("name")).dropna())
    names = stored(numbered(rows.select("name").distinct(), "name"))
    n = names.count()
    pairs = counted_pairs(rows.join(_small(names, n), "name").select("unit", "id"), n, evidence)
    named = lambda side: _small(names.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name")), n)
    return pairs.join(named("a"), "a").join(named("b"), "b").select(F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b"), "n", "evidence")


def relationship_seeds(paragraphs: DataFrame, seeds: DataFrame, approved: DataFrame, unit: str = "unit", text: str = "text", evidence: int = 8) -> DataFrame:
    """(seed_id, a, b, n, evidence, confidence, approved): pairs of character seeds (seed_id, key, name) that paragraphs hold together.

    A seed is in a paragraph if its name stands there as a whole phrase; a pair
    has the lesser key first. ``approved`` has the canon's pairs (a, b).
    """
    known = stored(numbered(seeds.select("key", "name", "seed_id"), "key"))
    n = known.count()
    hits = phrase_hits(paragraphs, known, unit, text, "id", "name").dropna()
    pairs = counted_pairs(hits.select(F.col(unit).alias("unit"), "id"), n, evidence)
    named = lambda side: _small(known.select(F.col("id").alias(side), F.struct("key", "name", "seed_id").alias(f"{side}_seed")), n)
    norm = lambda c: normalize_case_insensitive(F.col(c))
    canon = stored(approved.select(F.least(norm("a"), norm("b")).alias("a_key"), F.greatest(norm("a"), norm("b")).alias("b_key"), F.lit(True).alias("approved")).distinct())
    rows = pairs.join(named("a"), "a").join(named("b"), "b").select(F.least("a_seed", "b_seed").alias("a"), F.greatest("a_seed", "b_seed").alias("b"), "n", "evidence")
    rows = rows.withColumns({"a_key": F.col("a.key"), "b_key": F.col("b.key")}).join(_small(canon, canon.count()), ["a_key", "b_key"], "left")
    key = stable_id(F.lit("relationship"), F.concat("a.seed_id", F.lit("\x00"), "b.seed_id"))
    return rows.select(key.alias("seed_id"), F.col("a.name").alias("a"), F.col("b.name").alias("b"), "n", "evidence", confidence(F.col("n")).alias("confidence"), F.coalesce("approved", F.lit(False)).alias("approved"))


def missing_and_unknown(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that one side lacks, and keys that come several times in ``actual``."""
    lacking = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unknown"))
    twice = actual.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit("duplicate").alias("problem"))
    return lacking.unionByName(extra).unionByName(twice)


def align_positions(source: DataFrame, target: DataFrame, unit: str, position: str, text: str) -> DataFrame:
    """(unit, position, source, target): paragraphs side by side where both sides have as many, else one row with all of both."""
    numbered = lambda df, name: df.select(F.col(unit).alias("unit"), F.row_number().over(Window.partitionBy(unit).orderBy(position)).alias("position"), F.col(text).alias(name))
    s, t = numbered(source.filter(F.col(text) != "***"), "source"), numbered(target.filter(F.col(text) != "***"), "target")
    sizes = s.groupBy("unit").agg(F.count(F.lit(1)).alias("ns")).join(t.groupBy("unit").agg(F.count(F.lit(1)).alias("nt")), "unit", "full").withColumn("even", F.coalesce(F.col("ns") == F.col("nt"), F.lit(False)))
    even = s.join(t, ["unit", "position"]).join(sizes.filter("even").select("unit"), "unit", "left_semi")
    glue = lambda df, name: df.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", name)))[name], "\n\n").alias(name))
    odd = sizes.filter("NOT even").select("unit").join(glue(s, "source"), "unit", "left").join(glue(t, "target"), "unit", "left").select("unit", F.lit(1).alias("position"), "source", "target")
    return even.unionByName(odd)


def canonical_links(clusters: DataFrame, index: DataFrame) -> DataFrame:
    """(cluster, mention, name) of mentions in clusters that name exactly one known person; the naming mentions are left out.

    ``clusters`` has (cluster, mention, text). Clusters that name none or
    several people link nothing.
    """
    keyed = clusters.withColumn("key", normalize_case_insensitive(F.col("text"))).join(index.select("key", "name"), "key", "left")
    one = keyed.groupBy("cluster").agg(F.min("name").alias("least"), F.max("name").alias("greatest")).filter("least = greatest").select("cluster", F.col("least").alias("canonical"))
    return keyed.filter("name IS NULL").join(one, "cluster").select("cluster", "mention", F.col("canonical").alias("name"))
