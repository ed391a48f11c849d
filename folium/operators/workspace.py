"""Views of a project: its status and next step, review lists, scopes, contexts, provenance and accepted revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import normalize_case_insensitive, normalize_identity

# Filters of review lists; error codes with the hint for each; dimensions that a provider is asked for; bounds of contexts.
STATUS_FILTERS = ("all", "pending", "deferred", "approved-not-applied", "conflicted", "rejected", "applied", "obsolete")
KIND_FILTERS = ("all", "character", "relationship", "terminology", "literary")
HINTS = {
    "project_not_found": "none", "invalid_project": "reimport_source", "unsupported_project_version": "reimport_source", "unsupported_input_format": "reimport_source", "import_failed": "reimport_source",
    "analysis_failed": "run_analysis_first", "advanced_analysis_failed": "run_analysis_first", "provider_not_configured": "configure_provider", "provider_authentication_failed": "configure_provider",
    "review_conflict": "resolve_review_conflict", "review_revision_unavailable": "resolve_review_conflict", "pilot_review_unavailable": "none", "promotion_blocked": "resolve_review_conflict",
    "invalid_translation_config": "none", "translation_already_running": "resume_existing_run", "no_checkpoint": "resume_existing_run", "resume_incompatible": "resume_existing_run", "export_unavailable": "none",
    "project_locked": "unlock_project", "persistence_failure": "none", "internal_error": "none",
}
DIMENSIONS = ("semantic_fidelity", "character_voice", "relationship_register", "persian_naturalness", "dialogue_subtext", "terminology_continuity")
APPROVED_CHARS, COREFERENCE_LINKS, MENTION_CHARS = 12_000, 24, 96


def status_and_action(row: DataFrame) -> DataFrame:
    """``row`` (imported, source_fresh, analysed, pending, deferred, translation state or null, export_exists or null) with status and next_action; nulls count as not so."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    open_ = (F.coalesce("pending", F.lit(0)) > 0) | (F.coalesce("deferred", F.lit(0)) > 0)
    state = F.col("translation")
    both = lambda status, action: F.struct(F.lit(status).alias("status"), F.lit(action).alias("next_action"))
    choice = (
        F.when(~yes("imported"), both("empty", "import_book")).when(~yes("source_fresh"), both("error", "reimport_source")).when(~yes("analysed"), both("imported", "run_analysis")).when(open_, both("needs_review", "review_intelligence"))
        .when(state == "running", both("translating", "resume_translation")).when(state == "paused", both("paused", "resume_translation")).when((state == "completed") & yes("export_exists"), both("exported", "none"))
        .when(state == "completed", both("ready_to_export", "export")).when(state == "failed", both("error", "resume_translation")).otherwise(both("ready_to_translate", "start_translation"))
    )
    return row.withColumn("__c", choice).select("*", "__c.status", "__c.next_action").drop("__c")


def snapshot(projects: DataFrame, items: DataFrame, exports: DataFrame) -> DataFrame:
    """One row for each project with review counts, status, next step and warnings.

    ``projects``: project, imported, stored_fp, present_fp, analysed, translation,
    canon_fp, translated_canon_fp; ``items``: project, status, availability;
    ``exports``: project, export_exists. A source is fresh if its fingerprint is
    the stored one; a translation begun under another canon is a warning.
    """
    active = F.col("availability") == "active"
    counts = items.groupBy("project").agg(F.count_if((F.col("status") == "pending") & active).alias("pending"), F.count_if((F.col("status") == "deferred") & active).alias("deferred"), F.count(F.lit(1)).alias("items"))
    rows = projects.join(counts, "project", "left").join(exports, "project", "left").withColumn("source_fresh", F.coalesce(F.col("stored_fp") == F.col("present_fp"), F.lit(False)))
    stale = F.col("translation").isNotNull() & ~F.col("canon_fp").eqNullSafe(F.col("translated_canon_fp"))
    changed = F.coalesce("imported", F.lit(False)) & ~F.col("source_fresh")
    warnings = F.array_compact(F.array(F.when(changed, "source changed since it was imported"), F.when(stale, "canon changed since this translation run started; context is stale")))
    out = status_and_action(rows).withColumn("warnings", warnings)
    return out.select("project", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("deferred", F.lit(0)).alias("deferred"), "status", "next_action", "warnings")


def listed(items: DataFrame, status: str = "all", kind: str = "all", conflicts: DataFrame | None = None) -> DataFrame:
    """Items that a status and a kind filter admit; an unknown filter is an error. ``conflicts`` has the item_ids that conflict."""
    if status.replace("_", "-") not in STATUS_FILTERS or kind not in KIND_FILTERS:
        raise ValueError(f"unsupported review filter {status!r} or {kind!r}")
    return items.join(with_filters(items, conflicts).filter((F.col("filter") == status.replace("_", "-")) & ((F.col("kind") == kind) | F.lit(kind == "all"))).select("item_id"), "item_id", "left_semi")


def with_filters(items: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(item_id, kind, filter): every status filter that admits an item (item_id, kind, status, availability)."""
    active = F.col("availability") == "active"
    rows = items.withColumn("__conflicted", F.lit(False)) if conflicts is None else items.join(conflicts.select("item_id", F.lit(True).alias("__conflicted")).distinct(), "item_id", "left")
    rules = {
        "all": F.lit(True), "pending": (F.col("status") == "pending") & active, "deferred": (F.col("status") == "deferred") & active, "approved-not-applied": F.col("status").isin("approved", "edited") & active,
        "conflicted": F.coalesce("__conflicted", F.lit(False)), "rejected": F.col("status") == "rejected", "applied": F.col("status") == "applied", "obsolete": F.col("availability") == "obsolete",
    }
    return rows.select("item_id", "kind", F.explode(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in rules.items()]))).alias("filter"))


def item_summaries(items: DataFrame) -> DataFrame:
    """(item_id, kind, status, availability, revision, subject, confidence, evidence_count) of review items; a relationship's subject names both ends."""
    subject = F.when(F.lower("kind") == "relationship", F.concat("subject", F.lit(" / "), "partner")).otherwise(F.col("subject"))
    return items.select("item_id", F.lower("kind").alias("kind"), F.lower("status").alias("status"), F.lower("availability").alias("availability"), "revision", subject.alias("subject"), F.lower("confidence").alias("confidence"), F.size(F.coalesce("evidence", F.array().cast("array<string>"))).alias("evidence_count"))


def scope_key(scope: DataFrame) -> DataFrame:
    """``scope`` (kind global, chapter, scene, range, character or relationship; chapter_id, chapter_index, scene_id, last_index, a, b) with key, label and chapter_ids."""
    a, b = normalize_identity(F.col("a")), normalize_identity(F.col("b"))
    k = F.col("kind")
    number = lambda c: (F.col(c) + 1).cast("string")
    key = (
        F.when(k == "global", "global").when(k == "chapter", F.concat(F.lit("chapter:"), "chapter_id")).when(k == "scene", F.concat_ws(":", F.lit("scene"), "chapter_id", "scene_id"))
        .when(k == "range", F.concat(F.lit("range:"), F.col("chapter_index").cast("string"), F.lit("-"), F.col("last_index").cast("string"))).when(k == "character", F.concat(F.lit("character:"), a))
        .when(k == "relationship", F.concat_ws(":", F.lit("relationship"), F.least(a, b), F.greatest(a, b)))
    )
    label = (
        F.when(k == "global", "global").when(k == "chapter", F.concat(F.lit("chapter "), number("chapter_index"), F.lit(" ["), "chapter_id", F.lit("]"))).when(k == "scene", F.concat(F.lit("scene "), "scene_id", F.lit(" ["), "chapter_id", F.lit("]")))
        .when(k == "range", F.concat(F.lit("chapters "), number("chapter_index"), F.lit("–"), number("last_index"))).when(k == "character", F.concat(F.lit("character "), "a")).when(k == "relationship", F.concat(F.lit("relationship "), "a", F.lit(" / "), "b"))
    )
    ids = F.when(k.isin("chapter", "scene"), F.array("chapter_id")).otherwise(F.array().cast("array<string>"))
    return scope.withColumns({"key": key, "label": label, "chapter_ids": ids})


def recovery_hint(code: Column) -> Column:
    """The hint for an error code; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in HINTS.items() for x in p]), code)


def character_context(name: Column, voice: Column, personality: Column) -> Column:
    """A character's canon in lines; blank notes are left out."""
    note = lambda head, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{head}: "), F.trim(c)))
    return F.concat_ws("\n", F.concat(F.lit("Character: "), name), note("Voice", voice), note("Personality", personality))


def relationship_context(a: Column, b: Column, dynamic: Column, address: Column, boundaries: Column) -> Column:
    """A relationship's canon in lines; blank notes are left out."""
    note = lambda head, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{head}: "), F.trim(c)))
    return F.concat_ws("\n", F.concat(F.lit("Relationship: "), a, F.lit(" ↔ "), b), note("Dynamic", dynamic), note("Forms of address", address), note("Continuity constraints", boundaries))


def reviewed_lines(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """(chapter_id, position, line) of approved or edited literary findings in the chapters of their evidence.

    ``items``: item_id, kind, status, category, subject, scope, claim;
    ``evidence``: item_id, chapter_id. A finding stands once in a chapter.
    """
    ready = items.filter((F.col("kind") == "literary") & F.col("status").isin("approved", "edited"))
    line = F.concat(F.lit("["), "category", F.lit("] "), "subject", F.lit(" ("), "scope", F.lit(") — "), "claim")
    return ready.join(evidence.select("item_id", "chapter_id").distinct(), "item_id").select("chapter_id", F.col("item_id").alias("position"), line.alias("line"))


def leading(rows: DataFrame, by: str, chars: int, line: Column) -> DataFrame:
    """Those of ``rows`` (``by``, position) whose ``line`` begins within the first ``chars`` characters of the lines of its group, by position and line; blank lines are left out.

    Lines have one character or more, so of a group at most ``chars`` rows are
    needed; the first of them are picked before rows are shuffled.
    """
    along = Window.partitionBy(by).orderBy("position", "__line")
    first = rows.withColumn("__line", line).filter(F.trim("__line") != "").withColumn("__r", F.row_number().over(along)).filter(F.col("__r") <= chars)
    end = F.sum(F.length("__line")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("__end", end).filter(F.col("__end") - F.length("__line") < chars).drop("__line", "__r", "__end")


def approved_context(chapters: DataFrame, characters: DataFrame, glossary: DataFrame, lines: DataFrame, chars: int = APPROVED_CHARS) -> DataFrame:
    """(chapter_id, context): what is approved for a chapter, in three sections parted by blank lines, cut to ``chars``.

    ``characters``: chapter_id, position, context; ``glossary``: chapter_id,
    position, source_term, preferred_translation, context (entries whose term
    the chapter holds); ``lines`` as ``reviewed_lines`` gives them. Chapters
    without any have an empty context; lines that begin beyond the bound are
    not gathered.
    """
    note = F.when(F.trim(F.coalesce("context", F.lit(""))) != "", F.concat(F.lit(" ("), "context", F.lit(")"))).otherwise(F.lit(""))
    people = characters.select("chapter_id", F.lit(0).alias("section"), F.col("position").cast("bigint").alias("position"), F.col("context").alias("line")).filter("trim(line) <> ''")
    terms = glossary.select("chapter_id", F.lit(1).alias("section"), F.col("position").cast("bigint").alias("position"), F.concat(F.lit("Glossary: "), "source_term", F.lit(" => "), "preferred_translation", note).alias("line"))
    found = lines.select("chapter_id", F.lit(2).alias("section"), F.col("position").cast("bigint").alias("position"), F.concat(F.lit("Reviewed literary canon "), "line").alias("line"))
    rows = people.unionByName(terms).unionByName(found)
    along = Window.partitionBy("chapter_id").orderBy("section", "position", "line")
    gap = F.when(F.col("section") == F.lag("section").over(along), F.when(F.col("section") == 0, "\n\n").otherwise("\n")).when(F.lag("section").over(along).isNotNull(), "\n\n").otherwise("")
    pieces = rows.withColumn("piece", F.concat(gap, "line")).withColumn("end", F.sum(F.length("piece")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    kept = pieces.filter(F.col("end") - F.length("piece") < chars)
    joined = kept.groupBy("chapter_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end", "piece"))), lambda x: x["piece"]), ""), F.lit(chars)).alias("context"))
    return chapters.select("chapter_id").join(joined, "chapter_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def coreference_context(links: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, context): the first links (unit, model, cluster, mention_order, text, name) of each unit by cluster and mention, under a heading."""
    rank = F.row_number().over(Window.partitionBy(unit).orderBy("cluster", "mention_order"))
    text = F.trim("text")
    short = F.when(F.length(text) > MENTION_CHARS, F.concat(F.left(text, F.lit(MENTION_CHARS)), F.lit("…"))).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(short, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("- "), quoted, F.lit(" → "), "name", F.lit(" (cluster="), F.col("cluster").cast("string"), F.lit(")"))
    first = links.withColumn("r", rank).filter(F.col("r") <= COREFERENCE_LINKS).withColumn("line", line)
    head = F.concat(F.lit("COREFERENCE MAP — optional model evidence ("), F.trim(F.min("model")), F.lit(") mapped only through explicit canonical anchors; never canon:"))
    return first.groupBy(unit).agg(F.concat_ws("\n", head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")).alias("context"))


def without_provenance(source: DataFrame, translated: DataFrame, chapters: DataFrame) -> DataFrame:
    """(chapter_id, reason) of translated chapters of packages that can't be put back into them.

    ``chapters``: chapter_id, format, block_id (of the title, or null),
    title_block_id, translated_title; ``source`` and ``translated``:
    chapter_id, paragraph_id, block_id. Only EPUB chapters need it: the title's
    block, as many paragraphs, and for each source paragraph with a block one
    of the same id and block.
    """
    epub = chapters.filter(F.col("format") == "epub")
    title = F.col("block_id").isNotNull() & (~F.col("title_block_id").eqNullSafe(F.col("block_id")) | (F.trim(F.coalesce("translated_title", F.lit(""))) == ""))
    sizes = lambda df, name: df.groupBy("chapter_id").agg(F.count(F.lit(1)).alias(name))
    same = translated.select("chapter_id", "paragraph_id", "block_id").distinct().withColumn("hit", F.lit(True))
    lost = source.join(same, ["chapter_id", "paragraph_id", "block_id"], "left").groupBy("chapter_id").agg(F.bool_or(F.col("hit").isNull()).alias("lost"))
    rows = epub.join(sizes(source, "n"), "chapter_id", "left").join(sizes(translated, "m"), "chapter_id", "left").join(lost, "chapter_id", "left")
    uneven = F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))
    reason = F.when(title, "title").when(uneven, "count").when(F.coalesce("lost", F.lit(False)), "block")
    return rows.select("chapter_id", reason.alias("reason")).filter("reason IS NOT NULL")


def proposals_of(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings (finding_id, category, subject, claim, scope, level, unit_id) as review proposals with their evidence (finding_id, paragraph_id) counted and listed; findings are never canonical."""
    lists = evidence.groupBy("finding_id").agg(F.array_sort(F.collect_set("paragraph_id")).alias("evidence"))
    out = findings.join(lists, "finding_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return out.select(F.col("finding_id").alias("proposal_id"), F.lit("literary").alias("kind"), "category", "subject", "claim", F.col("scope").alias("scope_label"), F.col("level").alias("confidence"), F.size("evidence").alias("supporting_evidence"), "evidence", F.col("unit_id").alias("analysis_unit_id"), F.lit(False).alias("already_canonical"))


def reviewed_defaults(proposals: DataFrame) -> DataFrame:
    """``proposals`` (proposal_id, kind, subject, partner, aliases, voice, personality, label, address, translation, category, approved) with already_canonical and the value that an approval takes as it is (subject, partner, aliases, notes)."""
    k = F.col("kind")
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")
    blank = lambda c: F.coalesce(c, F.lit(""))
    notes = (
        F.when(k == "character", F.array(joined("voice"), joined("personality"))).when(k == "relationship", F.array(blank("label"), joined("address"), F.lit("")))
        .when(k == "terminology", F.array(blank("translation"), F.concat(F.lit("reviewed "), "category", F.lit(" manuscript terminology"))))
    )
    canonical = F.when(k == "terminology", F.col("translation").isNotNull()).when(k == "literary", F.lit(False)).otherwise(F.coalesce("approved", F.lit(False)))
    return proposals.select("proposal_id", "kind", canonical.alias("already_canonical"), "subject", F.when(k == "relationship", F.col("partner")).alias("partner"), F.when(k == "character", F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"), notes.alias("notes"))


def provider_dimensions(style: Column) -> Column:
    """Dimensions that a provider's review is asked for; the adult style has one more."""
    base = F.array(*map(F.lit, DIMENSIONS))
    return F.when(style == "adult-intimacy", F.concat(base, F.array(F.lit("intimacy_fidelity")))).otherwise(base)


def paragraph_segments(text: Column) -> Column:
    """Trimmed blocks between blank lines that aren't empty."""
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(F.split(text, "\n\n"), trim), lambda x: x != "")


def revision_decisions(findings: DataFrame, paragraphs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(finding_id, chapter_id, reason, position, text): proposed revisions, accepted (reason null) or why not.

    ``findings``: finding_id, chapter_id, proposed, suggested, target_indices,
    critical (whether the suggestion fails the structural review);
    ``paragraphs``: chapter_id, position (from 0), translated; ``chapters``:
    chapter_id, stale. A suggestion replaces the one paragraph that it names,
    where each paragraph is one segment of the text.
    """
    n = F.size(paragraph_segments(F.col("translated")))
    whole = paragraphs.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("segments"))
    at = F.get("target_indices", F.lit(0))
    rows = findings.join(chapters.select("chapter_id", "stale"), "chapter_id", "left").join(whole, "chapter_id", "left")
    reason = (
        F.when(F.col("stale").isNull(), "no_review").when(F.col("stale"), "stale_review").when(~F.coalesce("proposed", F.lit(False)), "no_proposal").when(F.trim(F.coalesce("suggested", F.lit(""))) == "", "no_text")
        .when(F.size(F.coalesce("target_indices", F.array().cast("array<int>"))) != 1, "not_one_target").when(F.coalesce(F.col("segments") != F.col("n"), F.lit(True)), "not_one_to_one").when((at < 0) | (at >= F.col("n")), "outside")
        .when(F.coalesce("critical", F.lit(False)), "structure")
    )
    return rows.select("finding_id", "chapter_id", reason.alias("reason"), F.when(reason.isNull(), at).alias("position"), F.when(reason.isNull(), F.trim("suggested")).alias("text"))


def with_revisions(paragraphs: DataFrame, decisions: DataFrame, reviewer: str) -> DataFrame:
    """``paragraphs`` (chapter_id, position, translated, ...) with the accepted texts, origin and reviewer; of several for one paragraph the last finding counts."""
    last = decisions.filter("reason IS NULL").groupBy("chapter_id", "position").agg(F.max_by("text", "finding_id").alias("__text"))
    out = paragraphs.join(last, ["chapter_id", "position"], "left")
    changed = F.col("__text").isNotNull()
    return out.withColumns({"previous": F.when(changed, F.col("translated")), "translated": F.coalesce("__text", "translated"), "origin": F.when(changed, "manual").otherwise("machine"), "reviewer": F.when(changed, F.lit(reviewer))}).drop("__text")


def inspected(chapters: DataFrame) -> DataFrame:
    """(doc_id, chapters, paragraphs, bytes, lines) of books of chapter rows (doc_id, chapter, title, n_paragraphs, n_bytes): what an inspection prints for each."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.col("n_bytes").cast("string"), F.lit(" bytes"))
    return chapters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n_paragraphs").alias("paragraphs"), F.sum("n_bytes").alias("bytes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def code_switching(chapters: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(*by, chapters, scenes_per_chapter, code_switching): whole-book facts of paragraph rows (doc_id, chapter, scene, text): a book switches scripts if it has Latin letters and others."""
    marks = chapters.withColumns({"__latin": F.rlike(F.col(text), F.lit(r"\p{IsLatin}")), "__other": F.rlike(F.col(text), F.lit(r"[\p{IsAlphabetic}&&[^\p{IsLatin}]]"))})
    scenes = marks.groupBy(*by, "doc_id", "chapter").agg(F.count_distinct("scene").alias("s"), F.bool_or("__latin").alias("l"), F.bool_or("__other").alias("o"))
    return scenes.groupBy(*by).agg(F.count(F.lit(1)).alias("chapters"), F.round(F.avg("s"), 6).alias("scenes_per_chapter"), (F.bool_or("l") & F.bool_or("o")).alias("code_switching"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, rows): keys that name several rows once they are normalised."""
    return rows.groupBy(normalize_case_insensitive(F.col(key)).alias("key")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
