"""Translation in runs that can stop: checkpoints by chapter, and the progress of every project.

A checkpoint holds a chapter's fingerprints of source, context and plan; a run
that resumes takes over the chapters whose latest checkpoint has all three, and
does the others again. Within a project chapters are taken in order, so the
first one that fails, or that is beyond the run's limit, ends the project's run;
projects go side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.operators.ledger import latest
from folium.sources.shared import stored

# Warnings of a run.
LEGACY = "legacy checkpoints have no translation-plan fingerprint; they will be regenerated"
CHANGED = "translation plan changed; checkpoints from the previous provider/model/target/style plan will be regenerated"
UNSTRUCTURED = "lacks a matching structured artifact or required provenance; translating again"

PRINTS = ["source_fp", "context_fp", "plan_fp"]


def run(chapters: DataFrame, checkpoints: DataFrame, runs: DataFrame, translate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(new checkpoints, progress) of one run of every project in ``runs``.

    ``chapters``: project, position, title, stem, source_fp, context_fp,
    paragraphs. ``checkpoints``: project, stem, source_fp, context_fp, plan_fp,
    structured, seq (the greatest is the latest). ``runs``: project, seq,
    source_fp, plan_fp, resume, paused, most_chapters (null: all), and of the
    progress so far previous_plan and previous_source (null: none).
    ``translate`` gets project, position, stem, plan_fp of the chapters to do
    and returns project, position, error (null: it passed the gate).

    Progress: project, state (completed, paused, failed, or refused:
    resume_incompatible, already_running), completed_chapters,
    completed_paragraphs, reused, total_chapters, percent, current, last
    checkpoint, warnings and error. Projects without chapters are complete.
    """
    begun = F.col("previous_source").isNotNull()
    refusal = F.when(F.col("resume") & begun & (F.col("previous_source") != F.col("source_fp")), "resume_incompatible").when(~F.col("resume") & begun, "already_running")
    asked = runs.withColumn("refusal", refusal)
    open_ = asked.filter("refusal IS NULL").select("project", "seq", "plan_fp", "resume", "paused", "most_chapters")
    last = latest(checkpoints, ["project", "stem"], ["seq"]).select("project", "stem", *[F.col(c).alias(f"old_{c}") for c in PRINTS], "structured")
    rows = chapters.join(open_, "project").join(last, ["project", "stem"], "left")
    same = F.col("resume") & F.coalesce((F.col("old_source_fp") == F.col("source_fp")) & (F.col("old_context_fp") == F.col("context_fp")) & (F.col("old_plan_fp") == F.col("plan_fp")), F.lit(False))
    rows = rows.withColumn("same", same).withColumn("reused", F.col("same") & F.coalesce("structured", F.lit(False)))
    along = Window.partitionBy("project").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turn", F.sum((~F.col("reused")).cast("int")).over(along))
    within = ~F.col("paused") & (F.col("most_chapters").isNull() | (F.col("turn") <= F.col("most_chapters")))
    rows = stored(rows.withColumn("within", within))
    due = rows.filter("within AND NOT reused")
    answers = stored(due.select("project", "position").join(translate(due.select("project", "position", "stem", "plan_fp")).select("project", "position", "error", F.lit(True).alias("answered")), ["project", "position"], "left"))
    bad = answers.withColumn("error", F.when(F.col("answered").isNull(), "no answer").otherwise(F.col("error"))).filter("error IS NOT NULL").groupBy("project").agg(F.min("position").alias("stop"), F.min_by("error", "position").alias("error"))
    ended = rows.join(bad, "project", "left").withColumn("visited", F.col("within") & (F.col("stop").isNull() | (F.col("position") < F.col("stop"))))
    new = ended.filter("visited AND NOT reused").select("project", "stem", *PRINTS, F.lit(True).alias("structured"), "seq")
    started = F.col("within") & ~F.col("reused") & (F.col("stop").isNull() | (F.col("position") <= F.col("stop")))
    seen = F.col("within") & (F.col("stop").isNull() | (F.col("position") <= F.col("stop")))
    note = F.when(seen & F.col("same") & ~F.col("reused"), F.concat(F.lit("checkpoint for "), "title", F.lit(f" {UNSTRUCTURED}")))
    counts = ended.groupBy("project").agg(
        F.count_if("visited").alias("done"), F.coalesce(F.sum(F.when(F.col("visited"), F.col("paragraphs"))), F.lit(0)).alias("paragraphs"), F.count_if(F.col("visited") & F.col("reused")).alias("reused"),
        F.count(F.lit(1)).alias("total"), F.max(F.when(started, F.col("position"))).alias("current"), F.max_by("stem", F.when(F.col("visited"), F.col("position"))).alias("stem"), F.count_if("visited").alias("any"),
        F.array_sort(F.collect_set(note)).alias("notes"), F.first("error").alias("error"),
    )
    plan = F.when(F.col("resume") & F.col("previous_plan").isNotNull() & (F.col("previous_plan") != F.col("plan_fp")), F.when(F.col("previous_plan") == "", LEGACY).otherwise(CHANGED))
    both = asked.join(counts, "project", "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    state = F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("error").isNotNull(), "failed").when(F.col("paused"), "paused").when(done >= total, "completed").otherwise("paused")
    progress = both.select(
        "project", "seq", state.alias("state"), done.alias("completed_chapters"), F.coalesce("paragraphs", F.lit(0)).alias("completed_paragraphs"), F.coalesce("reused", F.lit(0)).alias("reused"), total.alias("total_chapters"),
        F.when(F.col("refusal").isNull(), F.when(total == 0, 1.0).otherwise(F.round(done / total, 6))).alias("percent"), "current", F.when(F.col("any") > 0, F.concat("stem", F.lit(".txt"))).alias("last_checkpoint"),
        F.array_compact(F.concat(F.array(F.when(F.col("refusal").isNull(), plan)), F.coalesce("notes", F.array().cast("array<string>")))).alias("warnings"), "error",
    )
    return new, progress
