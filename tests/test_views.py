"""Ingestion, stored entries, project views and plain lookups: cases beside the SQL of the queries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folium.operators import evidence, lookup, matching, mining, workspace
from folium.sources import tables
from folium.sources.registry import Registry, default_registry


def test_a_registered_parser_takes_the_place_of_another(spark):
    files = spark.createDataFrame([("a.TXT", bytearray(b"one\n\ntwo")), ("b.html", bytearray(b"<p>x</p><p>y</p>")), ("c", bytearray(b"?")), ("d.txt", bytearray(b"x" * 50)), ("e.docx", bytearray(b"no zip")), ("f.txt", bytearray(b""))], "path string, content binary")
    own = default_registry()
    blocks, errors = own.ingest(files, most_bytes=20)
    assert sorted((r["doc_id"], r["block"], r["text"]) for r in blocks.collect()) == [("a.TXT", 1, "one"), ("a.TXT", 2, "two"), ("b.html", 1, "x"), ("b.html", 2, "y")]
    assert sorted(tuple(r) for r in errors.collect()) == [("c", "unsupported_format"), ("d.txt", "file_too_large"), ("e.docx", "corrupt_archive"), ("f.txt", "empty")]
    own.register("text", (".txt", "log"), lambda f: f.select(F.col("path").alias("doc_id"), F.lit(1).alias("block"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.upper(F.decode("content", "UTF-8")).alias("text")))
    assert [r["text"] for r in own.ingest(files.filter("path = 'a.TXT'"))[0].collect()] == ["ONE\n\nTWO"]
    assert own.ingest(files.limit(0))[0].count() == 0
    empty = Registry()
    empty.register("text", ("txt",), own.parsers["text"])
    assert [r["error"] for r in empty.ingest(files.filter("path = 'b.html'"))[1].collect()] == ["unsupported_format"]


def test_json_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"source": "s1", "translation": "t1", "context": "c", "tags": ["x"]}, {"source": "s2"}, {"source": "s3", "translation": "t3", "more": 1}]))
    (tmp_path / "in" / "b.jsonl").write_text('{"source": "s4", "translation": "t4"}\n\n{broken\n{"translation": "t5"}\n')
    (tmp_path / "in" / "c.json").write_text("[1, 2")
    good, bad = tables.load_json(spark, str(tmp_path / "in"), "memory")
    assert sorted((r["source"], r["position"], r["context"], r["tags"]) for r in good.collect()) == [("s1", 0, "c", ["x"]), ("s3", 2, "", []), ("s4", 0, "", [])]
    assert sorted((r["path"][-7:], r["position"], r["error"]) for r in bad.collect()) == [("/a.json", 1, "translation"), ("/c.json", 0, "not_json"), ("b.jsonl", 1, "not_json"), ("b.jsonl", 2, "source")]
    tables.save_json(good, str(tmp_path / "out"), "memory")
    again = tables.load_json(spark, str(tmp_path / "out"), "memory")[0]
    assert sorted(tuple(r)[2:] for r in again.collect()) == sorted(tuple(r)[2:] for r in good.collect())
    with pytest.raises(Exception, match="exists"):
        tables.save_json(good, str(tmp_path / "out"), "memory")


def test_entries_are_added_once_a_batch(spark, tmp_path):
    table = tables.EntryTable(spark, f"file://{tmp_path}/g", "glossary")
    row = lambda *x: spark.createDataFrame([x], "source_term string, preferred_translation string, context string")
    assert [table.add(row("gate", "در", ""), "one"), table.add(row("gate", "در", ""), "one"), table.add(row("gateway", "دروازه", "c"), "two"), table.add(row("x", " ", ""), "three")] == ["applied", "already_applied", "applied", "applied"]
    assert sorted(r["source_term"] for r in table.search("gate").collect()) == ["gate", "gateway"] and table.search("GATE").count() == 0
    found = table.lookup(spark.createDataFrame([("gateway",), ("none",), ("gateway",)], "term string")).collect()
    assert [(r["term"], r["preferred_translation"]) for r in found] == [("gateway", "دروازه")]


def test_review_lists(spark):
    items = spark.createDataFrame([(1, "character", "pending", "active"), (2, "character", "pending", "obsolete"), (3, "literary", "edited", "active"), (4, "literary", "applied", "active")], "item_id int, kind string, status string, availability string")
    ids = lambda *a, **k: sorted(r["item_id"] for r in workspace.listed(items, *a, **k).collect())
    assert ids() == [1, 2, 3, 4] and ids("pending") == [1] and ids("obsolete") == [2] and ids("approved_not_applied") == [3] and ids("all", "literary") == [3, 4] and ids("conflicted") == []
    assert ids("conflicted", conflicts=items.filter("item_id = 2").select("item_id")) == [2]
    for bad in (("odd", "all"), ("all", "odd")):
        with pytest.raises(ValueError, match="unsupported"):
            workspace.listed(items, *bad)


def test_contexts(spark):
    row = spark.range(1)
    text = row.select(workspace.character_context(F.lit("Mina"), F.lit(" calm "), F.lit(None).cast("string")).alias("c"), workspace.relationship_context(F.lit("A"), F.lit("B"), F.lit(""), F.lit("sir"), F.lit("x ")).alias("r")).first()
    assert tuple(text) == ("Character: Mina\nVoice: calm", "Relationship: A ↔ B\nForms of address: sir\nContinuity constraints: x")
    chapters = spark.createDataFrame([("a",), ("b",)], "chapter_id string")
    people = spark.createDataFrame([("a", 2, "P2"), ("a", 1, "P1"), ("a", 3, " ")], "chapter_id string, position int, context string")
    terms = spark.createDataFrame([("a", 1, "s", "t", None), ("a", 2, "u", "v", "w")], "chapter_id string, position int, source_term string, preferred_translation string, context string")
    lines = spark.createDataFrame([("a", 1, "[tone] x (global) — y")], "chapter_id string, position int, line string")
    out = {r["chapter_id"]: r["context"] for r in workspace.approved_context(chapters, people, terms, lines).collect()}
    whole = "P1\n\nP2\n\nGlossary: s => t\nGlossary: u => v (w)\n\nReviewed literary canon [tone] x (global) — y"
    assert out == {"a": whole, "b": ""}
    for n in (1, 3, 6, 20, 50):
        assert workspace.approved_context(chapters, people, terms, lines, n).filter("chapter_id = 'a'").first()["context"] == whole[:n]


def test_leading_lines_change_no_context(spark):
    rows = [(m, p, "" if p % 5 == 0 else "x" * (p % 4 + 1) + str(m)) for m in range(3) for p in range(60)]
    lines = spark.createDataFrame(rows, "m int, position int, line string")
    chapters = spark.range(9).select(F.concat(F.lit("c"), "id").alias("chapter_id"), (F.col("id") % 4).cast("int").alias("m"))
    nobody, nothing = spark.createDataFrame([], "chapter_id string, position int, context string"), spark.createDataFrame([], "chapter_id string, position int, source_term string, preferred_translation string, context string")
    for chars in (1, 2, 17, 90, 5_000):
        first = workspace.leading(lines, "m", chars, F.col("line"))
        assert first.groupBy("m").agg(F.sum(F.length("line")).alias("n")).filter(F.col("n") >= chars + 5).count() == 0
        whole, short = (workspace.approved_context(chapters, nobody, nothing, x.filter("line <> ''").join(chapters, "m"), chars) for x in (lines, first))
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, short.collect()))


def test_approved_contexts_make_no_row_for_each_pair(spark):
    """Findings meet chapters by shelf: what is joined with chapters has few lines a shelf, whatever the number of orders."""
    from folium.plans import views

    sf = "/root/testdata/sf0.01"
    shelves = views._contexts(spark, sf)[3].groupBy("chapter_id").count().agg(F.max("count")).first()[0]
    assert 0 < shelves <= views.CONTEXT_CHARS // 20
    assert views.reviewed_literary_lines(spark, sf).count() == 74_539


def test_revisions(spark):
    paragraphs = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two"), ("b", 0, "x\n\ny")], "chapter_id string, position int, translated string")
    chapters = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "chapter_id string, stale boolean")
    rows = [(1, "a", True, "new", [0], False), (2, "a", True, "newer", [0], None), (3, "a", True, "n", [2], False), (4, "b", True, "n", [0], False), (5, "c", True, "n", [0], False), (6, "z", True, "n", [0], False), (7, "a", True, "n", None, False), (8, "a", True, "bad", [1], True), (9, "a", None, "n", [1], False)]
    decisions = workspace.revision_decisions(spark.createDataFrame(rows, "finding_id int, chapter_id string, proposed boolean, suggested string, target_indices array<int>, critical boolean"), paragraphs, chapters)
    assert {r["finding_id"]: r["reason"] for r in decisions.collect()} == {1: None, 2: None, 3: "outside", 4: "not_one_to_one", 5: "stale_review", 6: "no_review", 7: "not_one_target", 8: "structure", 9: "no_proposal"}
    out = workspace.with_revisions(paragraphs, decisions, "ed").orderBy("chapter_id", "position").collect()
    assert [(r["translated"], r["previous"], r["origin"], r["reviewer"]) for r in out] == [("newer", "one", "manual", "ed"), ("two", None, "machine", None), ("x\n\ny", None, "machine", None)]


def test_lookups(spark):
    texts = spark.createDataFrame([("u", "The High-Warlock spoke."), ("v", None), ("w", "")], "unit_id string, text string")
    people = spark.createDataFrame([("Magnus",), ("War",)], "name string")
    aliases = spark.createDataFrame([("Magnus", "high warlock"), ("Nobody", " ")], "name string, alias string")
    found = lookup.characters_in(texts, people, aliases)
    assert sorted(tuple(r) for r in found.collect()) == [("u", "Magnus"), ("u", "War")]
    pairs = spark.createDataFrame([("magnus", "WAR"), ("Magnus", "Nobody")], "a string, b string")
    assert [tuple(r) for r in lookup.relationships_among(found, pairs).collect()] == [("u", "magnus", "WAR")]
    entries = spark.createDataFrame([(1, "a b c", None), (2, "a b", "a b c d"), (3, "z", None), (4, "a b c d e", "")], "entry_id int, source string, context string")
    queries = spark.createDataFrame([(1, "A b, c"), (2, " ")], "query_id int, query string")
    got = [(r["entry_id"], r["score"]) for r in lookup.search(queries, entries, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (4, 0.85)]
    glossary = spark.createDataFrame([("warlock", "جادوگر"), ("spoke", ""), ("none", "x")], "source_term string, preferred_translation string")
    issues = lookup.missing_preferred(texts.withColumn("source", F.col("text")).withColumn("output", F.lit("گفت")), glossary)
    assert [(r["unit_id"], r["source_term"]) for r in issues.collect()] == [("u", "warlock")]
    assert [r[0] for r in spark.range(0, 30, 12).select(lookup.consistency_score(F.col("id"))).collect()] == [1.0, 0.0, 0.0]


def test_scripts_and_provenance(spark):
    rows = spark.createDataFrame([(1, 1, 1, "abc"), (1, 1, 2, "متن"), (2, 1, 1, "abc 12")], "doc_id int, chapter int, scene int, text string")
    assert {r["doc_id"]: (r["chapters"], r["scenes_per_chapter"], r["code_switching"]) for r in workspace.code_switching(rows, ["doc_id"]).collect()} == {1: (1, 2.0, True), 2: (1, 1.0, False)}
    chapters = spark.createDataFrame([("t", "text", None, None, None), ("e", "epub", None, None, None), ("n", "epub", "b", "b", "T")], "chapter_id string, format string, block_id string, title_block_id string, translated_title string")
    part = lambda *x: spark.createDataFrame(x, "chapter_id string, paragraph_id string, block_id string")
    assert workspace.without_provenance(part(("e", "p", "b1")), part(("e", "p", "b1")), chapters).count() == 0
    assert [tuple(r) for r in workspace.without_provenance(part(("e", "p", None)), part(("e", "p", None)), chapters).collect()] == [("e", "block")]


def test_semantic_failure_leaves_the_deterministic_candidates(spark):
    entries = spark.createDataFrame([(1, "his hands were shaking", "a", "fear", ["x"]), (2, "the gate was open", "b", None, None), (3, "nothing alike here", "c", "", [])], "entry_id bigint, source string, translation string, context string, tags array<string>")
    glossary = spark.createDataFrame([("Portal", "p", "term"), ("the Portal", "q", " "), ("absent", "z", None)], "source_term string, preferred_translation string, context string")
    queries = spark.createDataFrame([(1, "His hands were shaking near the Portal."), (2, "his hands were shaking near the portal."), (3, " "), (4, None)], "query_id bigint, query string")
    native = evidence.native_candidates(queries, entries, glossary)
    semantic = spark.createDataFrame([(1, 3, 1), (2, 3, 1), (1, 99, 2)], "query_id bigint, entry_id bigint, rank int")
    failures = spark.createDataFrame([(2, "timeout"), (2, "again")], "query_id bigint, error string")
    found, status = evidence.hybrid_evidence(queries, entries, glossary, semantic, failures, "m")
    key = lambda df, q: sorted((r["id"], r["text"], r["reason"], r["relevance"]) for r in df.collect() if r["query_id"] == q)
    assert key(found, 2) == key(native, 2) and key(found, 1) != key(native, 1) and not key(found, 3) and not key(found, 4)
    texts = {r["text"] for r in found.collect() if r["query_id"] == 1}
    assert texts >= {"the Portal => q", "Portal => p [term]", '"his hands were shaking" => "a" | context: fear', '"nothing alike here" => "c"'}
    states = {r["query_id"]: (r["attempted"], r["used"], r["model"], r["error"] is not None) for r in status.collect()}
    assert states == {1: (True, True, "m", False), 2: (True, False, None, True), 3: (True, False, None, False), 4: (True, False, None, False)}
    text = {r["query_id"]: r for r in evidence.memory_text(queries, entries, glossary).collect()}
    assert text[1]["text"].startswith(f"{evidence.GLOSSARY_HEAD}\n- the Portal => q\n- Portal => p [term]\n\n{evidence.MEMORY_HEAD}\n- ") and text[1]["glossary_hits"] == 2 and text[3]["text"] == "" and not text[1]["truncated"]
    assert evidence.memory_text(queries, entries, glossary, 10).filter("query_id = 1").first()["text"] == evidence.GLOSSARY_HEAD[:10]
    assert evidence.hybrid_evidence(queries, entries.limit(0), glossary, semantic, failures, "m")[1].filter("used").count() == 0


def test_rerank_pool(spark):
    ranked = spark.createDataFrame([(1, i, 1.0 - i / 100, i) for i in range(1, 40)], "query int, neighbour int, cosine double, rank int")
    assert evidence.dense_pool(ranked, 2).count() == 16 and evidence.dense_pool(ranked, 6).count() == 24
    scores = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.9), (1, 30, 9.0)], "query int, neighbour int, score double")
    got = evidence.reranked(evidence.dense_pool(ranked, 2), scores, 4).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [3, 9, 1, 2]


def test_seeds_and_maps(spark):
    names = spark.createDataFrame([("mina", "Mina", 5, "high"), ("reza", "Reza", 5, "high"), ("bob", "Bob", 9, "high")], "key string, display string, n bigint, confidence string")
    seeds = mining.character_seeds(names, spark.createDataFrame([("MINA",)], "name string"), spark.createDataFrame([("x", "reza ")], "canonical_name string, alias string"))
    assert sorted((r["position"], r["name"], r["approved"]) for r in seeds.collect()) == [(1, "Bob", False), (2, "Mina", True), (3, "Reza", True)]
    lines = spark.createDataFrame([(1, "Mina and reza met Bob."), (2, "Reza saw mina, minas and Mina."), (3, "Bobby and Mina"), (4, None)], "unit bigint, text string")
    pairs = matching.relationship_seeds(lines, seeds, spark.createDataFrame([("Reza", "MINA")], "a string, b string")).collect()
    assert sorted((r["a"], r["b"], r["n"], r["evidence"], r["approved"]) for r in pairs) == [("Bob", "Mina", 1, [1], False), ("Bob", "Reza", 1, [1], False), ("Mina", "Reza", 2, [1, 2], True)]
    assert len({r["seed_id"] for r in pairs}) == 3 and all(r["seed_id"].startswith("seed-") for r in pairs)
    facts = spark.createDataFrame([(1,), (2,)], "c int")
    maps = mining.chapter_maps(facts, spark.createDataFrame([(1, 2, "B"), (1, 1, "A"), (1, 1, "A")], "c int, position int, label string"), spark.createDataFrame([], "c int, position int, label string"), ["c"])
    assert sorted((r["c"], r["names"], r["terms"]) for r in maps.collect()) == [(1, ["A", "B"], []), (2, [], [])]
