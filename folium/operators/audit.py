"""Audits of translated books: issues from many sources in one table, roll-ups, review targets and the state of their reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.operators.mining import middle_rows

# Reasons to review a chapter with their priorities, in the order in which they are listed; most targets of a book.
REASONS = {
    "early_book": 20, "middle_book": 30, "late_book": 40, "long_chapter": 50, "dialogue_heavy": 60, "manual_revision": 90, "literary_review_stale": 95, "literary_review_attention": 100, "translation_quality_stale": 85,
}
MOST_TARGETS = 12
RESOLVED = ("clear", "accepted_as_is")


@dataclass
class Audit:
    """Issue rows, one row of counts and states for each project, and review targets."""

    issues: DataFrame
    summary: DataFrame
    targets: DataFrame


def _samples(chapters: DataFrame) -> DataFrame:
    """(project, chapter_index, reason, paragraph) of chapters chosen by position and content."""
    by = chapters.groupBy("project")
    ends = by.agg(
        F.min("chapter_index").alias("early_book"), F.max("chapter_index").alias("late_book"), F.max(F.struct("n_chars", "chapter_index")).alias("long"),
        F.max(F.when(F.col("dialogue_score") > 0, F.struct("dialogue_score", (-F.col("chapter_index")).alias("i")))).alias("talk"),
    )
    parts = ends.select("project", F.explode(F.array(
        F.struct(F.lit("early_book").alias("reason"), F.col("early_book").alias("chapter_index")), F.struct(F.lit("late_book").alias("reason"), F.col("late_book").alias("chapter_index")),
        F.struct(F.lit("long_chapter").alias("reason"), F.col("long.chapter_index").alias("chapter_index")), F.struct(F.lit("dialogue_heavy").alias("reason"), (-F.col("talk.i")).alias("chapter_index")),
    )).alias("x")).select("project", "x.*").filter("chapter_index IS NOT NULL")
    middle = middle_rows(chapters, "project", "chapter_index").select("project", F.lit("middle_book").alias("reason"), "chapter_index")
    return parts.unionByName(middle)


def pilot_audit(projects: DataFrame, chapters: DataFrame, translated: DataFrame, reviews: DataFrame, most: int = MOST_TARGETS) -> Audit:
    """Whether books are translated, exportable and reviewed, with the chapters to look at.

    ``projects``: project, source_fp, and of the progress (null: none) state,
    completed_chapters, completed_paragraphs, plan_fp, progress_source_fp.
    ``chapters``: project, chapter_index, chapter_id, content_fp, n_chars,
    n_paragraphs, first_paragraph, longest_paragraph, dialogue_paragraph,
    dialogue_score. ``translated``: project, chapter_index, translated_id,
    source_fp, plan_fp, quality_stale, manual_paragraph (null: no revision).
    ``reviews``: project, chapter_index, stale, attention. Books without
    chapters or progress have rows too; an empty table gives empty results.
    """
    plan = F.nullif(F.trim(F.col("plan_fp")), F.lit(""))
    totals = chapters.groupBy("project").agg(F.count(F.lit(1)).alias("total_chapters"), F.sum("n_paragraphs").alias("total_paragraphs"))
    books = projects.join(totals, "project", "left").withColumns({"total_chapters": F.coalesce("total_chapters", F.lit(0)), "total_paragraphs": F.coalesce("total_paragraphs", F.lit(0)), "current_plan": plan})
    complete = F.coalesce((F.col("state") == "completed") & (F.col("completed_chapters") == F.col("total_chapters")) & (F.col("completed_paragraphs") == F.col("total_paragraphs")), F.lit(False))
    books = books.withColumn("translation_complete", complete)
    done = translated.select("project", "chapter_index", "translated_id", F.col("source_fp").alias("t_source"), F.col("plan_fp").alias("t_plan"), "quality_stale", "manual_paragraph", F.lit(True).alias("translated"))
    seen = reviews.select("project", "chapter_index", "stale", "attention", F.lit(True).alias("reviewed"))
    rows = chapters.join(books.select("project", "current_plan"), "project").join(done, ["project", "chapter_index"], "left").join(seen, ["project", "chapter_index"], "left")
    yes = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    rows = rows.withColumns({"is_done": yes("translated"), "source_ok": yes((F.col("translated_id") == F.col("chapter_id")) & (F.col("t_source") == F.col("content_fp"))), "plan_ok": yes(F.col("t_plan") == F.col("current_plan")), "manual": F.col("manual_paragraph").isNotNull()})
    rows = rows.withColumns({"eligible": F.col("is_done") & F.col("source_ok") & F.col("plan_ok"), "late": yes("stale") & F.col("is_done"), "ask": yes("attention") & ~yes("stale") & F.col("is_done"), "old": yes("quality_stale") & F.col("is_done")})
    issue = lambda code, when, blocking: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(blocking).alias("blocking")))
    by_chapter = F.array_compact(F.array(
        issue("chapter_source_mismatch", F.col("is_done") & ~F.col("source_ok"), True), issue("chapter_plan_mismatch", F.col("is_done") & ~F.col("plan_ok"), True), issue("manual_revision_present", F.col("is_done") & F.col("manual"), False),
        issue("translation_quality_stale", F.col("old"), False), issue("literary_review_stale", F.col("late"), False), issue("literary_review_attention", F.col("ask"), False),
        issue("literary_review_missing", F.col("is_done") & ~yes("reviewed"), False), issue("chapter_missing_translation", ~F.col("is_done"), True),
    ))
    begun = F.col("state").isNotNull()
    by_book = F.array_compact(F.array(
        issue("translation_not_complete", ~F.col("translation_complete"), True), issue("legacy_or_missing_plan_identity", begun & F.col("current_plan").isNull(), True),
        issue("progress_source_mismatch", begun & ~yes(F.col("progress_source_fp") == F.col("source_fp")), True),
    ))
    issues = rows.select("project", "chapter_index", "chapter_id", F.explode(by_chapter).alias("i")).select("project", "i.code", "chapter_index", "chapter_id", "i.blocking")
    issues = issues.unionByName(books.select("project", F.lit(None).cast("bigint").alias("chapter_index"), F.lit(None).cast("string").alias("chapter_id"), F.explode(by_book).alias("i")).select("project", "i.code", "chapter_index", "chapter_id", "i.blocking"))
    flagged = issues.groupBy("project").agg(F.bool_or("blocking").alias("blocked"), F.bool_or(F.col("code").isin("literary_review_missing", "translation_quality_stale")).alias("unclear"))
    counts = rows.groupBy("project").agg(
        F.count_if("is_done").alias("translated_chapters"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("n_paragraphs"))), F.lit(0)).alias("completed_source_paragraphs"), F.count_if(yes("reviewed") & F.col("is_done")).alias("reviewed_chapters"),
        F.count_if("late").alias("stale_reviews"), F.count_if("ask").alias("attention_reviews"), F.count_if(F.col("is_done") & F.col("manual")).alias("manual_chapters"),
    )
    zero = ["translated_chapters", "completed_source_paragraphs", "reviewed_chapters", "stale_reviews", "attention_reviews", "manual_chapters"]
    all_ = books.join(counts, "project", "left").join(flagged, "project", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    ready = F.col("translation_complete") & ~yes("blocked")
    clear = ready & (F.col("reviewed_chapters") == F.col("total_chapters")) & (F.col("stale_reviews") == 0) & (F.col("attention_reviews") == 0) & ~yes("unclear")
    summary = all_.select("project", "current_plan", "total_chapters", "total_paragraphs", *zero, "translation_complete", ready.alias("export_ready"), clear.alias("review_clear"))
    # a chapter's paragraph is that of the first reason that names one
    flags = rows.select("project", "chapter_index", F.explode(F.array_compact(F.array(F.when(F.col("is_done") & F.col("manual"), "manual_revision"), F.when(F.col("old"), "translation_quality_stale"), F.when(F.col("late"), "literary_review_stale"), F.when(F.col("ask"), "literary_review_attention")))).alias("reason"))
    reasons = flags.unionByName(_samples(rows.filter("eligible")).select("project", "chapter_index", "reason"))
    listed = list(REASONS)
    order = lambda c: F.array_position(F.array(*map(F.lit, listed)), c)
    priority = F.element_at(F.create_map(*[F.lit(x) for p in REASONS.items() for x in p]), F.col("reason"))
    sets = reasons.groupBy("project", "chapter_index").agg(F.collect_set("reason").alias("reasons"), F.max(priority).alias("priority"))
    has = lambda *names: F.arrays_overlap("reasons", F.array(*map(F.lit, names)))
    first = has("translation_quality_stale", "literary_review_stale", "literary_review_attention", "early_book", "middle_book", "late_book")
    paragraph = F.coalesce(F.when(has("manual_revision"), F.col("manual_paragraph")), F.when(first, F.col("first_paragraph")), F.when(has("long_chapter"), F.col("longest_paragraph")), F.when(has("dialogue_heavy"), F.col("dialogue_paragraph")), F.col("first_paragraph"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("priority"), "chapter_index"))
    best = sets.withColumn("r", rank).filter(F.col("r") <= min(most, MOST_TARGETS)).drop("r")
    named = F.transform(F.array_sort(F.transform("reasons", lambda x: F.struct(order(x).alias("o"), x.alias("reason")))), lambda x: x["reason"])
    targets = best.join(rows.select("project", "chapter_index", "chapter_id", "manual_paragraph", "first_paragraph", "longest_paragraph", "dialogue_paragraph"), ["project", "chapter_index"])
    return Audit(issues, summary, targets.select("project", "chapter_index", "chapter_id", paragraph.alias("paragraph_id"), "priority", named.alias("reasons")))


def target_id(project: Column, chapter_id: Column, paragraph_id: Column) -> Column:
    """Stable identity of a review target; a chapter as a whole has no paragraph."""
    return F.concat(F.lit("pilot-target-"), F.sha2(F.concat_ws("\0", F.lit("phase29-target-v1"), project.cast("string"), chapter_id, F.coalesce(paragraph_id, F.lit("chapter"))), 256))


def segments_fingerprint(segments: Column) -> Column:
    """SHA-256 over texts, each behind its length in bytes (64 bits, lowest byte first), so that no two lists of texts have one input; nulls count as empty."""
    text = lambda s: F.encode(F.coalesce(s, F.lit("")), "UTF-8")
    size = lambda s: F.octet_length(text(s)).cast("bigint")
    octet = lambda n, i: F.lpad(F.hex(F.shiftright(n, i).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0")
    framed = F.transform(segments, lambda s: F.concat(*[octet(size(s), 8 * i) for i in range(8)], F.hex(text(s))))
    head = F.hex(F.encode(F.lit("phase29-chapter-fingerprint-v1\0"), "UTF-8"))
    return F.concat(F.lit("sha256-"), F.sha2(F.unhex(F.concat(head, F.array_join(framed, ""))), 256))


def review_state(targets: DataFrame, records: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets with their current record, one row of counts for each project).

    ``targets``: project, target_id and the fingerprints source, translation,
    context, plan; ``records``: project, target_id, the same fingerprints,
    seq, outcome; ``ready``: project, export_ready. A record is current if all
    its fingerprints are the target's; the last current one counts. Records of
    other targets are orphaned.
    """
    prints = ["source", "translation", "context", "plan"]
    own = records.select("project", "target_id", *[F.col(p).alias(f"r_{p}") for p in prints], "seq", "outcome")
    pairs = targets.join(own, ["project", "target_id"], "left")
    current = F.lit(True)
    for p in prints:
        current = current & F.col(p).eqNullSafe(F.col(f"r_{p}"))
    current = current & F.col("seq").isNotNull()
    states = pairs.groupBy("project", "target_id").agg(F.max_by("outcome", F.when(current, F.col("seq"))).alias("last"), F.count_if(current).alias("n"), F.count_if(~current & F.col("seq").isNotNull()).alias("stale_records"))
    states = states.select("project", "target_id", F.when(F.col("n") > 0, F.col("last")).alias("outcome"), "stale_records")
    lost = records.join(targets.select("project", "target_id"), ["project", "target_id"], "left_anti").groupBy("project").agg(F.count(F.lit(1)).alias("orphaned"))
    sums = states.groupBy("project").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("outcome").isNotNull()).alias("reviewed"), F.count_if(F.col("outcome").isin(*RESOLVED)).alias("resolved"),
        F.count_if(F.col("outcome").isNotNull() & ~F.col("outcome").isin(*RESOLVED)).alias("needs_revision"), F.count_if(F.col("outcome").isNull()).alias("missing"), F.sum("stale_records").alias("stale_records"),
    )
    joined = ready.select("project", "export_ready").join(sums, "project", "left").join(lost, "project", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("targets", "reviewed", "resolved", "needs_revision", "missing", "stale_records", "orphaned")}
    joined = joined.withColumns(n)
    whole = (F.col("targets") > 0) & F.col("export_ready") & (F.col("resolved") == F.col("targets"))
    return states, joined.select("project", *n, whole.alias("complete"))
