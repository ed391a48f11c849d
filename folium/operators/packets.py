"""Initialisation proposals, evidence candidates of chapters, and fingerprints of packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import normalize_case_insensitive, tokens
from folium.sources.shared import stored

# Headings of context texts, bounds of excerpts and terms, and the relevance of each kind of evidence.
SEEDS_HEAD = "MANUSCRIPT SEEDS — inferred evidence only; approved project memory takes precedence:"
MOST_TERMS, SEED_CHARS, EXCERPT_CHARS = 12, 2_000, 900
RELEVANCE = {"chapter-metadata": 1.0, "character-canon": 1.0, "speaker-map": 0.94, "relationship-canon": 1.0, "previous-chapter": 0.82, "next-chapter": 0.74, "reviewed-literary": 1.0, "chapter-map": 0.88, "chapter-seeds": 0.64, "book-observed": 0.72}


def evidence_id(namespace: str, *parts: Column) -> Column:
    """``namespace-`` and the SHA-256 of the namespace and the parts, each behind a unit separator."""
    return F.concat(F.lit(f"{namespace}-"), F.sha2(F.concat_ws("\x1f", F.lit(namespace), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def seed_conflicts(characters: DataFrame, terms: DataFrame, aliases: DataFrame, glossary: DataFrame) -> DataFrame:
    """(seed_id, kind, inferred, approved): seeds that the canon overrules.

    ``characters``: seed_id, name, approved; a seed that isn't approved and has
    a word that is an approved name or alias (``aliases``: alias, canonical)
    conflicts with its character, the first alias in order. ``terms``: seed_id,
    expression, translation; one that the ``glossary`` (source_term,
    preferred_translation) translates otherwise conflicts. The words go through
    an index of aliases, so no seed is compared with all of them.
    """
    index = aliases.select(normalize_case_insensitive(F.col("alias")).alias("key"), "canonical").filter("key <> ''").groupBy("key").agg(F.max("canonical").alias("canonical"))
    words = characters.filter("NOT approved").select("seed_id", F.col("name").alias("inferred"), F.explode(F.array_distinct(tokens(normalize_case_insensitive(F.col("name"))))).alias("key"))
    people = words.join(index, "key").groupBy("seed_id", "inferred").agg(F.min_by("canonical", "key").alias("approved")).select("seed_id", F.lit("character_name").alias("kind"), "inferred", "approved")
    known = glossary.select(normalize_case_insensitive(F.col("source_term")).alias("key"), "preferred_translation").groupBy("key").agg(F.min("preferred_translation").alias("approved"))
    keyed = terms.withColumn("key", normalize_case_insensitive(F.col("expression"))).join(known, "key")
    wording = keyed.filter(~F.col("translation").eqNullSafe(F.col("approved"))).select("seed_id", F.lit("terminology").alias("kind"), F.coalesce("translation", F.lit("")).alias("inferred"), "approved")
    return people.unionByName(wording)


def _within(lines: Column, chars: int) -> Column:
    """``lines`` in their order, joined and cut to ``chars``; those that begin beyond are left out."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"))
    more = lambda at, x: F.struct(F.concat(at["text"], F.when(at["size"] > 0, "\n").otherwise(""), x).alias("text"), (at["size"] + F.length(x) + 1).alias("size"))
    return F.aggregate(lines, start, lambda at, x: F.when(at["size"] < chars, more(at, x)).otherwise(at), lambda at: F.left(at["text"], F.lit(chars)))


def proposal(characters: DataFrame, relationships: DataFrame, terms: DataFrame, conflicts: DataFrame, evidence: DataFrame, chars: int = SEED_CHARS) -> DataFrame:
    """(chapter_id, character_seeds, relationship_seeds, term_seeds, context) of the chapters with evidence.

    ``characters``: seed_id, position, name, level, count, approved;
    ``relationships``: seed_id, position, a, b, count, approved; ``terms``:
    seed_id, position, expression, translation, category; ``evidence``:
    seed_id, chapter_id. The context lists what isn't canon yet: character
    candidates without a conflict, co-occurrences, and the first ``MOST_TERMS``
    terms without a translation that aren't approved names; a chapter without
    any has an empty context. Seeds are numbered by position within their kind.
    """
    clash = conflicts.select("seed_id", F.lit(True).alias("clash")).distinct()
    names = characters.filter("approved").select(normalize_case_insensitive(F.col("name")).alias("key"), F.lit(True).alias("is_name")).distinct()
    level = F.concat(F.upper(F.left("level", F.lit(1))), F.substring("level", 2, 100))
    seed = lambda section, df, listed, line: df.select("seed_id", F.lit(section).alias("section"), F.col("position").cast("bigint").alias("position"), F.coalesce(listed, F.lit(False)).alias("listed"), line.alias("line"))
    people = seed(1, characters.join(clash, "seed_id", "left"), ~F.col("approved") & F.col("clash").isNull(), F.concat(F.lit("- character candidate: "), "name", F.lit(" ("), level, F.lit(", "), F.col("count").cast("string"), F.lit(" occurrences)")))
    pairs = seed(2, relationships, ~F.col("approved"), F.concat(F.lit("- co-occurrence: "), "a", F.lit(" ↔ "), "b", F.lit(" ("), F.col("count").cast("string"), F.lit(" interactions; relationship type unknown)")))
    t = terms.withColumn("key", normalize_case_insensitive(F.col("expression"))).join(names, "key", "left")
    open_ = F.col("translation").isNull() & ~((F.col("category") == "character_name") & F.coalesce("is_name", F.lit(False)))
    found = seed(3, t, open_, F.concat(F.lit("- terminology candidate: "), "expression"))
    # seeds are made once; the evidence meets them and then its chapters, in one shuffle
    seeds = stored(people.unionByName(pairs).unionByName(found))
    row = F.when(F.col("section").isNotNull(), F.struct("section", "position", "seed_id", F.when(F.col("listed"), F.coalesce("line", F.lit(""))).alias("line")))
    by_chapter = evidence.select("seed_id", "chapter_id").join(seeds, "seed_id", "left").groupBy("chapter_id").agg(F.array_sort(F.collect_set(row)).alias("all"))
    of = lambda section: F.filter("all", lambda x: x["section"] == section)
    lines = lambda rows: F.transform(F.array_sort(F.transform(rows, lambda x: F.struct(x["position"].alias("position"), x["line"].alias("line")))), lambda x: x["line"])
    shown = lambda section: F.filter(of(section), lambda x: x["line"].isNotNull())
    body = F.concat(lines(shown(1)), lines(shown(2)), lines(F.slice(shown(3), 1, MOST_TERMS)))
    gathered = by_chapter.withColumn("body", body)
    ids = [F.transform(of(section), lambda x: x["seed_id"]).alias(name) for section, name in ((1, "character_seeds"), (2, "relationship_seeds"), (3, "term_seeds"))]
    context = F.when(F.size("body") > 0, _within(F.concat(F.array(F.lit(SEEDS_HEAD)), "body"), chars)).otherwise("")
    return gathered.select("chapter_id", *ids, context.alias("context"))


def candidate(rows: DataFrame, namespace: str, kind: str, authority: str, text: Column, reason: str, ids: list[Column], evidence: Column | None = None) -> DataFrame:
    """Evidence rows (unit_id, id, kind, authority, text, reason, relevance, evidence_ids); blank texts give none."""
    found = F.array().cast("array<string>") if evidence is None else evidence
    out = rows.select("unit_id", evidence_id(namespace, *ids, text).alias("id"), F.lit(kind).alias("kind"), F.lit(authority).alias("authority"), text.alias("text"), F.lit(reason).alias("reason"), F.lit(RELEVANCE[namespace]).alias("relevance"), found.alias("evidence_ids"))
    return out.filter(F.trim("text") != "")


def chapter_candidates(
    chapters: DataFrame, characters: DataFrame | None = None, relationships: DataFrame | None = None, speakers: DataFrame | None = None, maps: DataFrame | None = None,
    seeds: DataFrame | None = None, profiles: DataFrame | None = None, reviewed: DataFrame | None = None, others: DataFrame | None = None,
) -> DataFrame:
    """The evidence of every chapter as one table of candidates, ready for ``memory.pack_context``.

    ``chapters``: unit_id, book, position, document_title, title, text. The
    others, where given, have unit_id and: characters name and context (canon
    characters present), relationships a, b and context, speakers context,
    maps context and scene_ids, seeds context, profiles (by book) context,
    reviewed position and line; ``others`` are candidates made elsewhere, as
    translation memory. Neighbouring chapters of a book give the end of the one
    before and the beginning of the one after.
    """
    meta = F.concat(F.lit("document_title="), "document_title", F.lit("\nchapter_title="), "title")
    parts = [candidate(chapters, "chapter-metadata", "reference", "deterministic", meta, "document/chapter identity for the current translation unit", [F.col("unit_id")])]
    along = Window.partitionBy("book").orderBy("position")
    near = chapters.select("unit_id", *[f("unit_id").over(along).alias(f"{n}_id") for n, f in (("p", F.lag), ("n", F.lead))], F.lag("title").over(along).alias("p_title"), F.lead("title").over(along).alias("n_title"), F.lag(F.right("text", F.lit(EXCERPT_CHARS))).over(along).alias("tail"), F.lead(F.left("text", F.lit(EXCERPT_CHARS))).over(along).alias("head"))
    before = F.concat(F.lit("PREVIOUS CHAPTER CONTINUITY — source evidence from "), "p_title", F.lit(":\n"), "tail")
    after = F.concat(F.lit("NEXT CHAPTER CONTINUITY — source evidence from "), "n_title", F.lit(":\n"), "head")
    parts.append(candidate(near.filter("trim(tail) <> ''"), "previous-chapter", "local_continuity", "deterministic", before, "bounded tail of the immediately preceding source chapter", [F.col("p_id")], F.array("p_id")))
    parts.append(candidate(near.filter("trim(head) <> ''"), "next-chapter", "local_continuity", "deterministic", after, "bounded head of the immediately following source chapter", [F.col("n_id")], F.array("n_id")))
    own = F.array("unit_id")
    if characters is not None:
        parts.append(candidate(characters, "character-canon", "character", "canonical", F.col("context"), "canonical character is present in the current source unit", [F.col("name")]))
    if relationships is not None:
        parts.append(candidate(relationships, "relationship-canon", "relationship", "canonical", F.col("context"), "both endpoints of a canonical relationship are present in the current unit", [F.col("a"), F.col("b")]))
    if speakers is not None:
        parts.append(candidate(speakers, "speaker-map", "character", "deterministic", F.col("context"), "high-precision explicit quote-speaker evidence; unresolved dialogue is omitted", [F.col("unit_id")], own))
    if maps is not None:
        parts.append(candidate(maps, "chapter-map", "chapter_summary", "deterministic", F.col("context"), "current chapter structural and continuity evidence", [F.col("unit_id")], F.concat(own, "scene_ids")))
    if seeds is not None:
        parts.append(candidate(seeds, "chapter-seeds", "chapter_summary", "inferred", F.col("context"), "deterministic manuscript-analysis proposal; not approved canon", [F.col("unit_id")], own))
    if profiles is not None:
        parts.append(candidate(chapters.select("unit_id", "book").join(profiles, "book"), "book-observed", "book_summary", "deterministic", F.col("context"), "whole-manuscript observed literary profile", [F.col("book")], F.array(F.col("book").cast("string"))))
    if reviewed is not None:
        text = F.concat(F.lit("REVIEWED LITERARY FINDING — human-approved context:\n"), F.trim("line"))
        parts.append(candidate(reviewed.filter("trim(line) <> ''"), "reviewed-literary", "translation_decision", "human_approved", text, "approved or edited literary-review finding scoped to this chapter", [F.col("unit_id"), F.col("position")], own))
    if others is not None:
        parts.append(others.select(*parts[0].columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


def candidates_fingerprint(candidates: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, fingerprint) of each unit's candidates, whatever the order of rows and of their evidence.

    One form of every row: texts trimmed, relevance between 0 and 1 (not a
    number counts as 0) with six digits, evidence sorted; rows by id and kind.
    """
    relevance = F.when(F.col("relevance").isNull() | F.isnan("relevance"), 0.0).otherwise(F.least(F.greatest(F.col("relevance").cast("double"), F.lit(0.0)), F.lit(1.0)))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    line = F.concat_ws("\x1f", F.coalesce("id", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("authority", F.lit("")), blank("text"), blank("reason"), F.format_string("%.6f", relevance), F.array_join(F.array_sort(F.coalesce("evidence_ids", F.array().cast("array<string>"))), ","))
    # rows are hashed before they meet, so a unit gathers one digest for each
    rows = candidates.select(unit, F.struct("id", "kind", F.sha2(line, 256).alias("d")).alias("x"))
    return rows.groupBy(unit).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), "\x1e"), 256).alias("fingerprint"))


def packet_fingerprint(packed: DataFrame, source: DataFrame, canon: str, limits: tuple[int, int, int], unit: str = "unit_id") -> DataFrame:
    """(unit, fingerprint) of packed items (position, id, kind, text, truncated) with the unit's source (unit, source_fp), the canon's fingerprint and the limits of the packing.

    Units without items have one too.
    """
    line = F.concat_ws("\x1f", F.col("position").cast("string"), "id", "kind", "text", F.col("truncated").cast("string"))
    items = packed.groupBy(unit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.sha2(line, 256).alias("d")))), lambda x: x["d"]), "\x1e").alias("items"))
    joined = source.join(items, unit, "left")
    return joined.select(unit, F.sha2(F.concat_ws("\x1f", F.col(unit).cast("string"), "source_fp", F.lit(canon), F.lit(",".join(map(str, limits))), F.coalesce("items", F.lit(""))), 256).alias("fingerprint"))
