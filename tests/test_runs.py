"""Plans, runs with a cache and retries, and translation progress: cases beside the SQL of the queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folium.operators import analysis, progress

PAR = "book string, chapter_id string, chapter_index int, scene_id string, scene_order int, position int, paragraph_id string, text string"
ENTRY = "position int, value string"


def paragraphs(spark, scenes):
    rows = [("b", f"c{c}", c, f"s{s}", s, i + 1, f"c{c}s{s}p{i}", t) for c, s, texts in scenes for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAR)


def entries(spark, values):
    return spark.createDataFrame(list(enumerate(values)), ENTRY)


def test_groups_contexts_and_entries(spark):
    rows = paragraphs(spark, [(1, 1, ["Mina said." * 3, "x" * 20, "y" * 45, None, "z"]), (1, 2, ["short"]), (1, 3, ["w" * 30, "v" * 30]), (2, 1, ["alone"])])
    planner = analysis.Planner(unit_chars=50, context_chars=31, most_names=2)
    units = analysis.plan_units(rows, entries(spark, ["mina", " ", "SHORT", "said", "x"]), entries(spark, ["y"]), planner).orderBy("chapter_index", "scene_order", "chunk").collect()
    assert [(u["scene_id"], u["chunk"], [p[-2:] for p in u["paragraph_ids"]]) for u in units] == [("s1", 0, ["p0", "p1"]), ("s1", 1, ["p2", "p3", "p4"]), ("s2", 0, ["p0"]), ("s3", 0, ["p0"]), ("s3", 1, ["p1"]), ("s1", 0, ["p0"])]
    assert units[1]["text_content"] == "[para-3] " + "y" * 45 + "\n\n[para-4] \n\n[para-5] z" and units[1]["ordinals"] == ["para-3", "para-4", "para-5"]
    assert units[0]["known_names"] == ["mina", "said"] and units[2]["known_names"] == ["SHORT"] and units[1]["known_terms"] == ["y"]
    assert units[2]["previous_context"] == "Mina said." * 3 + "\n …" and units[2]["next_context"] == "w" * 30 + "\n …"
    assert units[0]["previous_context"] is None and units[5]["previous_context"] is units[5]["next_context"] is None
    assert analysis.oversize_books(analysis.plan_units(rows, entries(spark, []), entries(spark, []), planner), 5).collect() == [("b", 6)]
    assert analysis.plan_units(rows.limit(0), entries(spark, ["a"]), entries(spark, []), planner).count() == 0
    assert len({analysis.Planner().fingerprint(), planner.fingerprint(), analysis.Planner(unit_chars=50).fingerprint()}) == 3


CACHE = "key string, unit_id string, findings array<struct<category:string,claim:string,confidence:double,evidence:array<string>>>, stored_at int"


def test_run_asks_again_only_for_what_may_pass(spark):
    units = spark.createDataFrame([(u, [f"para-{i}" for i in (1, 2)]) for u in ("ok", "late", "never", "bad", "silent")], "unit_id string, ordinals array<string>")
    asked = []

    def provider(requests, attempt):
        asked.append(sorted(r["unit_id"] for r in requests.select("unit_id").collect()))
        status = F.when(F.col("unit_id") == "bad", "permanent").when((F.col("unit_id") == "never") | ((F.col("unit_id") == "late") & F.lit(attempt < 1)), "retryable").otherwise("ok")
        good = F.struct(F.lit("tone").alias("category"), F.lit("c").alias("claim"), F.lit(0.9).alias("confidence"), F.array(F.lit("para-1"), F.lit("para-2")).alias("evidence"))
        odd = F.struct(F.lit("other").alias("category"), F.lit("c").alias("claim"), F.lit(0.9).alias("confidence"), F.array(F.lit("para-7")).alias("evidence"))
        return requests.filter("unit_id <> 'silent'").select("unit_id", status.alias("status"), F.lit("e").alias("error"), F.array(good, odd).alias("findings"), F.lit(5).cast("long").alias("tokens"))

    empty = spark.createDataFrame([], CACHE)
    run = lambda cache, who, at: analysis.run(units, cache, provider, who, ["tone"], F.lit(at), retries=2)
    first = run(empty, ["1"] * 6, 1)
    outcomes = {r["unit_id"]: (r["outcome"], r["attempts"], r["error"], r["retryable"]) for r in first.outcomes.collect()}
    assert outcomes == {"ok": ("succeeded", 1, None, None), "late": ("succeeded", 2, None, None), "never": ("failed", 3, "e", True), "bad": ("failed", 1, "e", False), "silent": ("failed", 1, "missing", False)}
    assert asked == [["bad", "late", "never", "ok", "silent"], ["late", "never"], ["never"]] and first.attempts == 3
    assert sorted(r["warning"] for r in first.warnings.collect()) == [f"unit {u}: rejected 1 provider finding(s) (unknown_category)" for u in ("late", "ok")]
    assert {(r["unit_id"], r["level"], r["cached"]) for r in first.findings.collect()} == {("ok", "high", False), ("late", "high", False)}
    summary = analysis.run_summary(first).first()
    assert (summary["units"], summary["succeeded"], summary["failed"], summary["cached"], summary["warnings"]) == (5, 2, 3, 0, 2)
    asked.clear()
    second = run(first.cache, ["1"] * 6, 2)
    assert asked[0] == ["bad", "never", "silent"] and {r["outcome"] for r in second.outcomes.filter("unit_id IN ('ok', 'late')").collect()} == {"cached"}
    asked.clear()
    assert run(first.cache, ["1"] * 5 + ["2"], 2) and asked[0] == ["bad", "late", "never", "ok", "silent"]  # another canon: nothing of the cache fits
    kept = analysis.run(units, first.cache, provider, ["9"] * 6, ["tone"], F.lit(3), entries=1).cache.collect()
    assert [r["stored_at"] for r in kept] == [3]
    with pytest.raises(ValueError, match="seven parts"):
        analysis.cache_key(F.lit("a"))


CHAPTERS = "project string, position int, title string, stem string, source_fp string, context_fp string, paragraphs int"
POINTS = "project string, stem string, source_fp string, context_fp string, plan_fp string, structured boolean, seq int"
RUNS = "project string, seq int, source_fp string, plan_fp string, resume boolean, paused boolean, most_chapters int, previous_plan string, previous_source string"


def test_progress(spark):
    chapters = spark.createDataFrame([(p, i, f"T{i}", f"s{i}", f"src{i}", "ctx", 2) for p in "abcdefg" for i in range(4)], CHAPTERS)
    points = [("b", "s0", "src0", "ctx", "plan", True, 1), ("b", "s1", "src1", "old", "plan", True, 1), ("b", "s1", "src1", "ctx", "plan", False, 2), ("b", "s3", "src3", "ctx", "plan", True, 1), ("c", "s0", "src0", "ctx", "other", True, 1)]
    runs = [("a", 1, "s", "plan", False, False, 2, None, None), ("b", 2, "s", "plan", True, False, None, "plan", "s"), ("c", 2, "s", "plan", True, False, None, "", "s"), ("d", 1, "s", "plan", False, True, None, None, None), ("e", 2, "s2", "plan", True, False, None, "plan", "s"), ("f", 2, "s", "plan", False, False, None, "plan", "s"), ("g", 1, "s", "plan", False, False, None, None, None), ("none", 1, "s", "plan", False, False, None, None, None)]
    todo = []

    def translate(due):
        todo.extend(sorted((r["project"], r["position"]) for r in due.collect()))
        return due.filter("NOT (project = 'g' AND position = 3)").select("project", "position", F.when((F.col("project") == "g") & (F.col("position") == 2), "blocked").alias("error"))

    new, out = progress.run(chapters, spark.createDataFrame(points, POINTS), spark.createDataFrame(runs, RUNS), translate)
    rows = {r["project"]: r for r in out.collect()}
    facts = {p: (r["state"], r["completed_chapters"], r["completed_paragraphs"], r["reused"], r["percent"], r["current"], r["last_checkpoint"], r["error"]) for p, r in rows.items()}
    assert facts == {
        "a": ("paused", 2, 4, 0, 0.5, 1, "s1.txt", None), "b": ("completed", 4, 8, 2, 1.0, 2, "s3.txt", None), "c": ("completed", 4, 8, 0, 1.0, 3, "s3.txt", None), "d": ("paused", 0, 0, 0, 0.0, None, None, None),
        "e": ("resume_incompatible", 0, 0, 0, None, None, None, None), "f": ("already_running", 0, 0, 0, None, None, None, None), "g": ("failed", 2, 4, 0, 0.5, 2, "s1.txt", "blocked"), "none": ("completed", 0, 0, 0, 1.0, None, None, None),
    }
    assert rows["b"]["warnings"] == ["checkpoint for T1 " + progress.UNSTRUCTURED] and rows["c"]["warnings"] == [progress.LEGACY]
    assert todo == [("a", 0), ("a", 1), ("b", 1), ("b", 2), *[(p, i) for p in "cg" for i in range(4)]]
    assert sorted((r["project"], r["stem"]) for r in new.collect()) == [("a", "s0"), ("a", "s1"), ("b", "s1"), ("b", "s2"), *[("c", f"s{i}") for i in range(4)], ("g", "s0"), ("g", "s1")]


def test_texts_are_shuffled_once_for_a_plan_and_not_written_by_a_run(spark, monkeypatch):
    """Scenes, the scenes around, names and terms need no further exchange of the paragraphs, and a run writes no texts."""
    rows = spark.createDataFrame([("b", "c1", 1, "s1", 1, i, f"p{i}", f"Line {i} of Mina") for i in range(1, 5)], "book string, chapter_id string, chapter_index int, scene_id string, scene_order int, position int, paragraph_id string, text string")
    units = analysis.plan_units(rows, entries(spark, ["mina"]), entries(spark, ["line"]), analysis.Planner(unit_chars=20))
    assert units._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    written = []
    monkeypatch.setattr(analysis, "stored", lambda df: written.append(df.columns) or df)
    empty = spark.createDataFrame([], "key string, unit_id string, findings array<struct<category:string,claim:string,confidence:double,evidence:array<string>>>, stored_at int")
    answer = lambda todo, attempt: spark.createDataFrame([], analysis.RESPONSE)
    assert {r["outcome"] for r in analysis.run(units, empty, answer, ["1"] * 6, ["tone"], F.lit(1)).outcomes.collect()} == {"failed"}
    assert not any("text_content" in columns for columns in written)
