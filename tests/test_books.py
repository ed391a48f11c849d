"""Proposals, evidence and packages: cases beside the SQL of the queries."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.operators import align, mining, packets
from folium.sources import packages


def test_proposal_lists_what_is_not_canon(spark):
    characters = spark.createDataFrame([("c1", 1, "Mina", "high", 7, False), ("c2", 2, "Old Bob", "low", 1, False), ("c3", 3, "Reza", "moderate", 2, True)], "seed_id string, position int, name string, level string, count int, approved boolean")
    pairs = spark.createDataFrame([("r1", 1, "Mina", "Reza", 3, False), ("r2", 2, "Reza", "Bob", 1, True)], "seed_id string, position int, a string, b string, count int, approved boolean")
    terms = spark.createDataFrame([("t1", 1, "the gate", None, "other"), ("t2", 2, "reza", None, "character_name"), ("t3", 3, "moon", "ماه", "other"), ("t4", 4, "sun", "خور", "other")], "seed_id string, position int, expression string, translation string, category string")
    aliases = spark.createDataFrame([("Bob", "Robert"), ("old", "Methuselah"), ("", "Nobody")], "alias string, canonical string")
    glossary = spark.createDataFrame([("Sun", "خورشید"), ("Moon", "ماه")], "source_term string, preferred_translation string")
    conflicts = packets.seed_conflicts(characters, terms, aliases, glossary)
    assert sorted(tuple(r) for r in conflicts.collect()) == [("c2", "character_name", "Old Bob", "Robert"), ("t4", "terminology", "خور", "خورشید")]
    evidence = spark.createDataFrame([(s, "ch1") for s in ("c1", "c2", "c3", "r1", "r2", "t1", "t2", "t3", "t4", "t1")] + [("c3", "ch2")], "seed_id string, chapter_id string")
    out = {r["chapter_id"]: r for r in packets.proposal(characters, pairs, terms, conflicts, evidence).collect()}
    assert out["ch1"]["context"] == "\n".join([packets.SEEDS_HEAD, "- character candidate: Mina (High, 7 occurrences)", "- co-occurrence: Mina ↔ Reza (3 interactions; relationship type unknown)", "- terminology candidate: the gate"])
    assert out["ch1"]["character_seeds"] == ["c1", "c2", "c3"] and out["ch1"]["term_seeds"] == ["t1", "t2", "t3", "t4"] and out["ch2"]["context"] == "" and out["ch2"]["relationship_seeds"] == []
    cut = packets.proposal(characters, pairs, terms, conflicts, evidence, 100).filter("chapter_id = 'ch1'").first()["context"]
    assert cut == out["ch1"]["context"][:100]
    assert packets.proposal(characters, pairs, terms, conflicts, evidence.limit(0)).count() == 0


CANDIDATE = "unit_id string, id string, kind string, authority string, text string, reason string, relevance double, evidence_ids array<string>"


def test_fingerprint_is_of_what_counts(spark):
    rows = [("u", "a", "glossary", "canonical", "x", "r", 0.5, ["1", "2"]), ("u", "b", "reference", "inferred", "y", "r", 2.0, [])]
    mark = lambda data: packets.candidates_fingerprint(spark.createDataFrame(data, CANDIDATE)).first()["fingerprint"]
    same = [("u", "b", "reference", "inferred", " y ", "r ", float("inf"), None), ("u", "a", "glossary", "canonical", "x", "r", 0.5, ["2", "1"])]
    assert mark(rows) == mark(same)
    assert mark([rows[0][:5] + ("r", float("nan"), ["1", "2"])]) == mark([rows[0][:5] + ("r", None, ["1", "2"])]) == mark([rows[0][:5] + ("r", -1.0, ["1", "2"])])
    for i, other in ((1, "z"), (2, "character"), (3, "inferred"), (4, "z"), (5, "z"), (6, 0.6), (7, ["1"])):
        assert mark([rows[0][:i] + (other,) + rows[0][i + 1 :], rows[1]]) != mark(rows)


def test_evidence_of_neighbours(spark):
    chapters = spark.createDataFrame([("u1", "b", 1, "Doc", "One", "x" * 1000), ("u2", "b", 2, "Doc", "Two", " "), ("u3", "b", 3, "Doc", "Three", "end"), ("v", "c", 1, "Doc", "One", "alone")], "unit_id string, book string, position int, document_title string, title string, text string")
    reviewed = spark.createDataFrame([("u1", 0, " keep "), ("u1", 1, " ")], "unit_id string, position int, line string")
    out = packets.chapter_candidates(chapters, reviewed=reviewed).collect()
    kinds = sorted((r["unit_id"], r["id"].rsplit("-", 1)[0]) for r in out)
    assert kinds == [("u1", "chapter-metadata"), ("u1", "reviewed-literary"), ("u2", "chapter-metadata"), ("u2", "next-chapter"), ("u2", "previous-chapter"), ("u3", "chapter-metadata"), ("v", "chapter-metadata")]
    tail = next(r for r in out if r["id"].startswith("previous"))
    assert tail["text"] == "PREVIOUS CHAPTER CONTINUITY — source evidence from One:\n" + "x" * 900 and tail["evidence_ids"] == ["u1"]
    assert packets.chapter_candidates(chapters.limit(0)).count() == 0


def test_epub_is_stable_and_escapes(spark):
    chapters = [("A & B", "one <two>\n\nthree"), ("Empty", "")]
    book = packages.epub_bytes('T "x"', "C", "fa", chapters)
    assert book == packages.epub_bytes('T "x"', "C", "fa", chapters) != packages.epub_bytes('T "x"', "C", "en", chapters)
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and 'dir="rtl"' in z.read("OEBPS/text/chapter-00001.xhtml").decode()
    files = spark.createDataFrame([("p", bytearray(book)), ("bad", bytearray(b"no zip"))], "path string, content binary")
    archive = packages.members(files)
    assert [(r["kind"], r["text"]) for r in packages.epub_blocks(archive).orderBy("block").collect()] == [("heading", "A & B"), ("paragraph", "one <two>"), ("paragraph", "three"), ("heading", "Empty")]
    assert [r["error"] for r in archive.filter("error IS NOT NULL").collect()] == ["corrupt_archive"]
    with pytest.raises(ValueError, match="at least one"):
        packages.epub_bytes("t", "c", "en", [])


def slow_cost(source, target, most):
    """The least cost of all alignments, by recursion."""
    from functools import cache

    n, m = len(source), len(target)
    mean = lambda rows: np.mean(rows, axis=0)

    def like(u, v):
        norm = np.linalg.norm(u) * np.linalg.norm(v)
        return float(u @ v) / norm if norm else 0.0

    @cache
    def cost(i, j):
        if (i, j) == (n, m):
            return 0.0
        best = [align.GAP + cost(i + 1, j)] if i < n else []
        best += [align.GAP + cost(i, j + 1)] if j < m else []
        for s in range(1, most + 1):
            for t in range(1, most + 1):
                if i + s <= n and j + t <= m:
                    best.append(1 - max(like(mean(source[i : i + s]), mean(target[j : j + t])), 0.0) + align.SPAN_COST * (s + t - 2) + cost(i + s, j + t))
        return min(best)

    return cost(0, 0)


def test_blocks_of_several_segments_are_optimal(spark):
    rng = np.random.default_rng(6)
    units, rows = {}, []
    for u in range(14):
        base = rng.normal(size=(rng.integers(1, 7), 5))
        target = [(base[i] + base[min(i + 1, len(base) - 1)]) / 2 + rng.normal(size=5) * 0.1 for i in range(0, len(base), rng.integers(1, 3))]
        units[u] = (base, np.array(target))
        rows += [(u, "source", 10 * i, [float(x) for x in v]) for i, v in enumerate(base)] + [(u, "target", 10 * i, [float(x) for x in v]) for i, v in enumerate(target)]
    spans = align.segment_spans(spark.createDataFrame(rows, "unit_id int, side string, position int, embedding array<double>"))
    assert align.span_problems(spans).count() == 0
    blocks = align.align(spans).collect()
    assert any(b["source_len"] > 1 for b in blocks)
    for u, (source, target) in units.items():
        own = sorted((b for b in blocks if b["unit_id"] == u), key=lambda b: (b["source_start"], b["target_start"]))
        cost = sum(align.GAP if b["kind"] != "matched" else 1 - max(b["similarity"], 0.0) + align.SPAN_COST * (b["source_len"] + b["target_len"] - 2) for b in own)
        assert cost == pytest.approx(slow_cost(source, target, 3), abs=1e-4) and sum(b["source_len"] for b in own) == len(source) and sum(b["target_len"] for b in own) == len(target)


def test_one_segment_against_two(spark):
    e = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [("u", "source", 0, [1.0, 1.0, 0.0]), ("u", "source", 1, e[2]), ("u", "target", 0, e[0]), ("u", "target", 1, e[1]), ("u", "target", 2, e[2])]
    got = align.align(align.segment_spans(spark.createDataFrame(rows, "unit_id string, side string, position int, embedding array<double>"))).orderBy("source_start").collect()
    assert [(b["source_start"], b["source_len"], b["target_start"], b["target_len"]) for b in got] == [(0, 1, 0, 2), (1, 1, 2, 1)]


def test_ranks_over_runs(spark, monkeypatch):
    rng = random.Random(1)
    values = rng.sample(range(-200, 900), 300)
    for size in (3, 4_096):
        monkeypatch.setattr(mining, "RUN_CHAPTERS", size)
        out = mining.ranked(spark.createDataFrame([(v,) for v in values], "v int"), "v", "r").select("v", F.col("r").cast("int").alias("r")).collect()
        assert {r["v"]: r["r"] for r in out} == {v: i for i, v in enumerate(sorted(values))}


def test_packages_are_handed_on_in_bounded_batches(monkeypatch):
    """However many books come in one batch, a task holds and hands on few bytes at a time."""
    import pyarrow as pa

    from folium.sources import packages

    monkeypatch.setattr(packages, "BATCH_BYTES", 5_000)
    book = packages.epub_bytes("t", "", "en", [("one", "x " * 2_000), ("two", "y " * 2_000)])
    files = pa.RecordBatch.from_pydict({"path": [f"b{i}" for i in range(20)] + ["bad"], "content": [book] * 20 + [b"no archive"]})
    out = list(packages._records(packages._members(iter([files])), ["path", "member", "body", "error"], [pa.string()] * 4))
    assert len(out) > 20 and max(b.nbytes for b in out) < 20_000
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 20 * 5 + 1 and rows[-1] == {"path": "bad", "member": None, "body": None, "error": "corrupt_archive"}


def test_proposal_gathers_a_chapter_once(spark):
    """Evidence is shuffled once, by chapter; a line that begins at the limit leaves no end of line, and evidence of unknown seeds keeps its chapter."""
    characters = spark.createDataFrame([("c1", 2, "Ann", "high", 3, False), ("c2", 1, "Bob", "low", 1, False)], "seed_id string, position int, name string, level string, count int, approved boolean")
    pairs = spark.createDataFrame([], "seed_id string, position int, a string, b string, count int, approved boolean")
    terms = spark.createDataFrame([(f"t{i:02d}", i, f"term {i}", None, "other") for i in range(20)], "seed_id string, position int, expression string, translation string, category string")
    none = spark.createDataFrame([], "seed_id string, kind string, inferred string, approved string")
    found = [("c1", "x"), ("c2", "x"), ("c2", "x"), ("gone", "y"), *[(f"t{i:02d}", "z") for i in range(20)]]
    evidence = spark.createDataFrame(found, "seed_id string, chapter_id string")
    made = lambda chars: packets.proposal(characters, pairs, terms, none, evidence, chars)
    out = {r["chapter_id"]: r for r in made(2_000).collect()}
    head = packets.SEEDS_HEAD
    assert out["x"]["character_seeds"] == ["c2", "c1"] and out["x"]["context"] == f"{head}\n- character candidate: Bob (Low, 1 occurrences)\n- character candidate: Ann (High, 3 occurrences)"
    assert out["y"]["context"] == "" and out["y"]["term_seeds"] == [] and len(out["z"]["term_seeds"]) == 20 and out["z"]["context"].count("terminology candidate") == packets.MOST_TERMS
    cut = {r["chapter_id"]: r["context"] for r in made(len(head) + 1).collect()}
    assert cut == {"x": head, "y": "", "z": head}
    plan = made(600)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [chapter_id") == 1 and "Window" not in plan
