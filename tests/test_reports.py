"""Nested validators, blind reviews and audits: cases beside the SQL of the queries."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from folium.operators import audit, blind, checks, evaluation, mining

CORPUS = (
    "corpus int, schema_version int, corpus_id string, title string, source_language string, target_language string, rights_safe boolean, owner string, license string, creation_note string, "
    "cases array<struct<id:string,title:string,source:string,reference:string,dimensions:array<string>,anchors:array<struct<id:string,dimension:string,values:array<string>>>,variants:array<struct<id:string,translation:string,degradation:string,description:string>>>>"
)


def case(**changes):
    base = {"id": "c", "title": "t", "source": "s", "reference": "r", "dimensions": ["voice"], "anchors": [("a", "voice", ["x"])], "variants": [("v", "t", "voice", "d")]}
    base.update(changes)
    return tuple(base.values())


def test_first_failure_in_document_order(spark):
    head = lambda i, cases, **k: (i, k.get("schema", 1), "id", k.get("title", "t"), "en", "fa", k.get("rights", True), "o", "l", "n", cases)
    rows = [
        head(0, [case()]), head(1, [case()], schema=None), head(2, [case()], rights=None, title="t"), head(3, []), head(4, None), head(5, [case(), case()]),
        head(6, [case(anchors=[("a", "voice", ["x"]), ("b", "tone", [" "])], variants=[("", "", "", "")]), case(id="d", title="")]),
        head(7, [case(id="a", anchors=[("a", "voice", ["x", None])]), case(id="a", title="")]),
        head(8, [case(variants=[("v", "t", "voice", "d"), ("v", "t", "voice", "d")]), case(id="", dimensions=[])]), head(9, [case(dimensions=[]), case()]), head(10, [case(anchors=None, variants=None)]),
    ]
    got = {r["corpus"]: (r["rule"], r["path"]) for r in checks.corpus_failures(spark.createDataFrame(rows, CORPUS)).collect()}
    assert got == {
        1: ("schema", [-1, 0, 0]), 2: ("rights", [-1, 0, 0]), 3: ("no_cases", [-1, 0, 0]), 4: ("no_cases", [-1, 0, 0]), 5: ("duplicate_case", [1, 0, 0]), 6: ("anchor_dimension", [0, 1, 1]),
        7: ("anchor_value", [0, 1, 0]), 8: ("duplicate_variant", [0, 2, 1]), 9: ("dimensions", [0, 0, 0]),
    }
    assert checks.corpus_failures(spark.createDataFrame([], CORPUS)).count() == 0


def test_submissions_and_scorecards(spark):
    schema = "submission int, schema_version int, corpus_id string, system_id string, outputs array<struct<case_id:string,translation:string>>"
    rows = [(0, 1, "c", "s", [("a", "x"), ("b", "y")]), (1, 2, "c", "s", []), (2, 1, "c", " ", []), (3, 1, "c", "s", [("a", "x"), ("a", "y"), ("", "")]), (4, 1, "c", "s", [("a", None)]), (5, 1, "c", "s", None)]
    got = {r["submission"]: r["rule"] for r in checks.submission_failures(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "schema", 2: "identity", 3: "duplicate_output", 4: "output_fields"}
    cards = spark.createDataFrame([(0, 1, "a", "r", 3, [("voice", 1), ("tone", 5)]), (1, 1, "z", "r", 3, []), (2, 1, "a", "r", 6, []), (3, 1, "a", "r", 3, [("voice", 0)]), (4, 1, "a", "r", 3, [("voice", 2), ("voice", 2)]), (5, 1, "a", "r", 3, [("voice", 2)])], "scorecard int, schema_version int, case_id string, reviewer_id string, overall int, ratings array<struct<dimension:string,score:int>>")
    cases = spark.createDataFrame([("a", ["voice", "tone"])], "case_id string, dimensions array<string>")
    assert {r["scorecard"]: r["rule"] for r in checks.scorecard_failures(cards, cases).collect()} == {1: "case", 2: "overall", 3: "rating_score", 4: "duplicate_rating", 5: "missing_rating"}


def test_chain_shows_every_change(spark):
    rows = [(o, i, f"d{i}", None if i == 2 else "r") for o in ("x", "y") for i in range(6)]
    chain = lambda data: {(r["o"], r["i"]): r["digest"] for r in blind.chained(spark.createDataFrame(data, "o string, i int, d string, r string").repartition(3), "o", ["i"], ["i", "d", "r"]).collect()}
    first = chain(rows)
    digest = blind.CHAIN_START
    for i in range(6):
        digest = hashlib.sha256(f"{digest}\x1f{i}\x1fd{i}\x1f{'' if i == 2 else 'r'}".encode()).hexdigest()
        assert first["x", i] == first["y", i] == digest
    changed = chain([("x", i, "other" if (o, i) == ("x", 3) else d, r) if o == "x" else (o, i, d, r) for o, i, d, r in rows])
    assert [k for k in first if first[k] != changed[k]] and all((first[k] != changed[k]) == (k[0] == "x" and k[1] >= 3) for k in first)


def test_decisions_count_once(spark):
    cases = spark.createDataFrame([("l", c) for c in "abc"], "ledger string, case_id string")
    rows = [("l", 1, "a", "tie", "r", ""), ("l", 1, "a", "tie", "r", ""), ("l", 2, "a", "candidate_b", " why ", ""), ("l", 3, "a", "defer", " ", ""), ("l", 4, "z", "tie", "r", ""), ("l", 5, "b", "pending", "r", "")]
    state, odd = blind.recorded(cases, spark.createDataFrame(rows, "ledger string, seq int, case_id string, decision string, reason string, notes string"))
    assert sorted((r["case_id"], r["decision"], r["reason"]) for r in state.collect()) == [("a", "candidate_b", "why"), ("b", "pending", None), ("c", "pending", None)]
    assert sorted((r["seq"], r["refused"]) for r in odd.collect()) == [(3, "missing_reason"), (4, "unknown_case"), (5, "unknown_decision")]


def test_preferences_go_into_a_dossier(spark):
    key = spark.createDataFrame([("k", 1, None, "c", "one", "two", [("a", "one", "two"), ("b", "two", "one")])], "reveal string, schema_version int, bundle_sha256 string, corpus_id string, system_one string, system_two string, assignments array<struct<case_id:string,a_system:string,b_system:string>>")
    ledger = lambda r, who, decisions: (r, "k", int(r), 1, None, "c", "b", who, [(c, d, None if d == "pending" else "r") for c, d in decisions])
    rows = [ledger("0", "ann", [("a", "candidate_a"), ("b", "candidate_b")]), ledger("1", "bob", [("b", "tie"), ("a", "candidate_b")]), ledger("2", "ann", [("a", "tie"), ("b", "tie")]), ledger("3", "cy", [("a", "tie"), ("b", "pending")]), ledger("4", "di", [("a", "tie")])]
    ledgers = spark.createDataFrame(rows, "review string, reveal string, position int, schema_version int, bundle_sha256 string, corpus_id string, bundle_fingerprint string, reviewer string, cases array<struct<case_id:string,decision:string,reason:string>>")
    assert {r["review"]: r["rule"] for r in blind.inadmissible(ledgers, key).collect()} == {"2": "reviewer_twice", "3": "pending", "4": "other_cases"}
    found = blind.preferences(ledgers, key).withColumnRenamed("reviewer", "reviewer_id")
    assert sorted((r["case_id"], r["preferred"]) for r in found.collect()) == [("a", "one"), ("a", "two"), ("b", "one"), ("b", "tie")]
    assert evaluation.preference_dossier(found).first()["disagreements"] == 2


def test_middle_is_the_same_in_runs_of_any_size(spark, monkeypatch):
    rng = random.Random(2)
    books = {b: sorted(rng.sample(range(-50, 500), rng.randint(1, 120))) for b in range(12)}
    rows = spark.createDataFrame([(b, i) for b, x in books.items() for i in x], "b int, i int")
    for size in (1, 7, 4_096):
        monkeypatch.setattr(mining, "RUN_CHAPTERS", size)
        assert {r["b"]: r["i"] for r in mining.middle_rows(rows, "b", "i").collect()} == {b: x[len(x) // 2] for b, x in books.items()}


def test_fingerprints_frame_their_segments(spark):
    lists = [["ab", "c"], ["a", "bc"], [], ["ü" * 200, None]]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(lists)], "i int, s array<string>").orderBy("i").select(audit.segments_fingerprint(F.col("s"))).collect()]
    plain = lambda s: "sha256-" + hashlib.sha256(b"phase29-chapter-fingerprint-v1\0" + b"".join(len((x or "").encode()).to_bytes(8, "little") + (x or "").encode() for x in s)).hexdigest()
    assert got == [plain(s) for s in lists] and len(set(got)) == 4


def test_audit_of_empty_tables(spark):
    frames = [spark.createDataFrame([], s) for s in (
        "project int, chapter_index bigint, chapter_id string, content_fp string, n_chars bigint, n_paragraphs bigint, first_paragraph string, longest_paragraph string, dialogue_paragraph string, dialogue_score bigint",
        "project int, chapter_index bigint, translated_id string, source_fp string, plan_fp string, quality_stale boolean, manual_paragraph string", "project int, chapter_index bigint, stale boolean, attention boolean",
    )]
    projects = spark.createDataFrame([(1, "s", None, None, None, None, None), (2, "s", "completed", 0, 0, "p", "s")], "project int, source_fp string, state string, completed_chapters bigint, completed_paragraphs bigint, plan_fp string, progress_source_fp string")
    found = audit.pilot_audit(projects, *frames)
    assert [(r["project"], r["translation_complete"], r["export_ready"]) for r in found.summary.orderBy("project").collect()] == [(1, False, False), (2, True, True)]
    assert [(r["project"], r["code"]) for r in found.issues.collect()] == [(1, "translation_not_complete")] and found.targets.count() == 0
    assert audit.pilot_audit(projects.limit(0), *frames).summary.count() == 0
