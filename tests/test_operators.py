from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folium.functions import text
from folium.operators import align, evaluation, ledger, matching, memory, mining, quality, review
from folium.sources import packages
from folium.sources import text as source


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_manuscript(spark):
    body = "---\nTitle: 'X'\n---\nIntro.\n\nChapter 1\n\nOne\ntwo.\n\n***\n\nThree.\n\n# Empty\n\n# Last\n\nEnd."
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id bigint, text string")
    out = source.segment(source.blocks(docs))
    assert rows(out, "chapter", "scene") == [(1, 1, "Chapter 1", 1, 1, "Intro."), (1, 2, "Chapter 1", 1, 1, "One two."), (1, 2, "Chapter 1", 2, 1, "Three."), (1, 3, "Last", 1, 1, "End.")]
    assert docs.limit(1).select(source.frontmatter(F.col("text")).alias("m")).first()["m"] == {"title": "X"}
    assert [r[2] for r in rows(source.book_blocks(out), "position")] == ["heading", "paragraph", "heading", "paragraph", "scene_break", "paragraph", "heading", "paragraph"]


def test_large_book_keeps_every_chapter(spark):
    body = "\n\n".join(f"Chapter {i}\n\nText of it {i}." for i in range(1, 121))
    assert source.chapters(source.segment(source.blocks(spark.createDataFrame([(1, body)], "doc_id bigint, text string")))).count() == 120


def test_html_and_paths(spark):
    df = spark.createDataFrame([("<p>A&amp;B <b>x</b></p><br/>  c", "OEBPS/content.opf", "../t/a.xhtml#f", "http://www.archiveofourown.org/works/0012")], "h string, b string, r string, u string")
    assert tuple(df.select(source.html_text(F.col("h")), source.archive_path(F.col("b"), F.col("r")), source.work_id(F.col("u"))).first()) == ("A&B x\nc", "t/a.xhtml", "12")


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


def test_epub_in_spine_order(spark):
    opf = '<package><metadata><dc:title>T</dc:title></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="zz"/><itemref idref="a"/></spine></package>'
    book = archive(**{"O/c.opf": opf, "O/a.xhtml": "<html><body><p>first</p></body></html>", "O/b.xhtml": "<html><body><h2>Two</h2><p>x</p></body></html>"})
    files = spark.createDataFrame([("f.epub", book), ("bad.epub", bytearray(b"no"))], "path string, content binary")
    m = packages.members(files)
    assert [r[2:] for r in rows(packages.epub_blocks(m), "block")] == [("heading", 2, "Two"), ("paragraph", 0, "x"), ("heading", 1, "a"), ("paragraph", 0, "first")]
    assert m.filter("error = 'corrupt_archive'").count() == 1
    assert packages.epub_metadata(m).first()["title"] == "T"


def test_docx_round_trip(spark):
    chapters = spark.createDataFrame([("b", 1, "One", "p1\n\np2"), ("b", 2, "Two", "p3")], "doc_id string, chapter int, title string, content string")
    books = packages.docx_books(chapters).select(F.concat("doc_id", F.lit(".docx")).alias("path"), "content")
    out = rows(packages.docx_blocks(packages.members(books)), "block")
    assert [r[4] for r in out] == ["b", "One", "p1", "p2", "Two", "p3"] and [r[2] for r in out].count("heading") == 2
    with pytest.raises(ValueError):
        packages.docx_bytes("t", [])


def test_phrase_hits_need_whole_words(spark):
    docs = spark.createDataFrame([(1, "The red fox ran."), (2, "Aired foxes"), (3, None)], "doc_id bigint, text string")
    terms = spark.createDataFrame([(7, "Red Fox"), (8, ""), (9, "ran")], "term_id bigint, term string")
    assert rows(matching.phrase_hits(docs, terms, "doc_id", "text", "term_id", "term")) == [(1, 7), (1, 9)]


def test_alias_beats(spark):
    p = spark.createDataFrame([("Elizabeth",), ("Jane",)], "name string")
    a = spark.createDataFrame([("Jane", "Elizabeth"), ("Elizabeth", "Lizzy")], "canonical_name string, alias string")
    assert {r["key"]: r["name"] for r in matching.alias_index(p, a).collect()} == {"elizabeth": "Elizabeth", "jane": "Jane", "lizzy": "Elizabeth"}


def test_positions_or_one_row(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d")], "u int, p int, t string")
    t = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "CD")], "u int, p int, t string")
    assert rows(matching.align_positions(s, t, "u", "p", "t")) == [(1, 1, "a", "A"), (1, 2, "b", "B"), (2, 1, "c\n\nd", "CD")]


def test_coreference_needs_one_name(spark):
    index = spark.createDataFrame([("ann", "Ann"), ("bob", "Bob")], "key string, name string")
    c = spark.createDataFrame([(1, 1, "Ann"), (1, 2, "she"), (2, 1, "Ann"), (2, 2, "Bob"), (2, 3, "they"), (3, 1, "it")], "cluster int, mention int, text string")
    assert rows(matching.canonical_links(c, index)) == [(1, 2, "Ann")]


def test_phrases_skip_stop_words(spark):
    docs = spark.createDataFrame([(i, "of the old sea of the") for i in range(3)], "doc_id bigint, text string")
    assert {r["phrase"]: (r["n"], r["evidence"], r["confidence"]) for r in mining.recurring_phrases(docs).collect()}["old sea"] == (3, [0, 1, 2], "moderate")
    assert "of the" not in {r["phrase"] for r in mining.recurring_phrases(docs).collect()}


def test_memory_ranking(spark):
    m = spark.createDataFrame([(1, "the sea is calm", "A", "", ["sea"]), (2, "the sea is calm tonight", "B", "", []), (3, "horses run", "C", "", []), (4, "the sea is calm", "A", "", [])], "entry_id int, source string, translation string, context string, tags array<string>")
    q = spark.createDataFrame([(1, "The sea is calm."), (2, " ")], "query_id int, query string")
    scored = memory.score_memory(q, m)
    assert [(r["entry_id"], r["score"]) for r in scored.orderBy("entry_id").collect()] == [(1, 1.0), (2, 1.0), (4, 1.0)]
    assert [r[:3] for r in rows(memory.rank_memory(scored, diversity=1.0))] == [(1, 1, 1), (1, 2, 2)]
    assert [r[2] for r in rows(memory.rank_memory(scored))] == [1]


def test_metrics_of_a_perfect_ranking(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, item_id string, rank int")
    t = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 0)], "query_id int, item_id string, gain int")
    assert rows(memory.ranking_metrics(r, t, 2)) == [(1, 1.0, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0)]


def test_packing_goes_on_after_a_miss(spark):
    c = spark.createDataFrame([("u", "a", "glossary", "canonical", "x" * 50, "r", 1.0), ("u", "b", "reference", "inferred", "short", "r", 0.5), ("u", "b", "reference", "inferred", "again", "r", 0.4)], "unit_id string, id string, kind string, authority string, text string, reason string, relevance double")
    out = rows(memory.pack_context(c, most_chars=400), "position")
    assert [(r[2], r[4]) for r in out] == [("a", "x" * 50), ("b", "short")]
    assert rows(memory.pack_context(c, most_chars=1)) == []


def test_gate(spark):
    df = spark.createDataFrame([("a long source text here", "x"), ("a", "the passage"), ("", None), ("same size", "size same")], "source string, output string")
    assert [r["blocking"] for r in quality.gate(df).collect()] == [["truncated"], ["leak:passage"], ["empty_source", "empty_output"], []]


def test_findings_are_checked(spark):
    f = spark.createDataFrame([(1, "theme", "c", 0.9, ["para-1", "para-2"]), (1, "odd", "c", 0.9, []), (1, "theme", "c", 2.0, []), (1, "theme", "c", 0.6, ["para-9"])], "unit_id int, category string, claim string, confidence double, evidence array<string>")
    s = spark.createDataFrame([(1, "para-1"), (1, "para-2")], "unit_id int, ordinal string")
    assert [(r["reason"], r["level"]) for r in quality.validate_findings(f, s, ["theme"]).collect()][0] == (None, "high")
    assert {r["reason"] for r in quality.validate_findings(f, s, ["theme"]).collect()} == {None, "unknown_category", "bad_confidence", "unsupplied_evidence"}


def test_alignment_finds_the_gap(spark):
    e = lambda i: [1.0 if k == i else 0.0 for k in range(4)]
    spans = spark.createDataFrame([(1, "source", i, 1, e(i)) for i in range(3)] + [(1, "target", 0, 1, e(0)), (1, "target", 1, 1, e(2))], "unit_id int, side string, start int, len int, embedding array<double>")
    out = rows(align.align(spans, 1), "source_start")
    assert [(r[1], r[2], r[4]) for r in out] == [("matched", 0, 0), ("omission", 1, 1), ("matched", 2, 1)]
    assert align.gap_findings(align.align(spans, 1)).count() == 1
    assert rows(align.span_problems(spans.filter("start <> 1"), 1)) == [(1, "source", "missing_span")]


def test_chrf(spark):
    df = spark.createDataFrame([("the cat", "the cat"), ("abc", "xyz"), ("", "x")], "h string, r string")
    assert [round(r[0], 3) for r in df.select(align.chrf(F.col("h"), F.col("r"))).collect()] == [100.0, 0.0, 0.0]


def test_spans(spark):
    got = spark.createDataFrame([(["a", "b"],)], "s array<string>").select(quality.span_specs(F.col("s"), 3).alias("x")).first()["x"]
    assert [tuple(r) for r in got] == [(0, 1, "a"), (1, 1, "b"), (0, 2, "a\nb")]


def test_anchors(spark):
    a = spark.createDataFrame([(1, "x", "d", "all_present", ["sea", "calm"]), (1, "y", "d", "any_present", ["no", "sea"]), (1, "z", "e", "all_absent", ["storm"]), (2, "x", "d", "all_absent", ["q"])], "case_id int, anchor_id string, dimension string, mode string, values array<string>")
    o = spark.createDataFrame([(1, "The calm SEA")], "case_id int, text string")
    report = {(r["scope"], r["key"]): (r["passed"], r["anchors"]) for r in evaluation.anchor_report(evaluation.anchor_results(o, a)).collect()}
    assert report == {("case", "1"): (3, 3), ("case", "2"): (0, 1), ("dimension", "d"): (2, 3), ("dimension", "e"): (1, 1), ("total", ""): (3, 4)}


def test_reconcile(spark):
    old = [("k", 1, "a", 1, "approved", "active"), ("k", 2, "b", 2, "rejected", "active"), ("k", 3, "c", 1, "approved", "active"), ("other", 4, "d", 1, "approved", "active"), ("k", 6, "f", 1, "edited", "obsolete"), ("k", 7, "g", 1, "approved", "obsolete"), ("k", 8, "h", 1, "approved", "active")]
    old = spark.createDataFrame(old, "kind string, key int, fp string, revision int, status string, availability string")
    new = spark.createDataFrame([("k", 1, "a", False), ("k", 2, "B", False), ("k", 5, "e", False), ("k", 7, "g", False), ("k", 8, "h", True), ("k", 9, "i", True)], "kind string, key int, fp string, already_canonical boolean")
    out = ledger.reconcile(old, new, ["kind", "key"], "fp", ["k"])
    assert rows(out, "key") == [
        ("k", 1, "unchanged", False, 1, "approved", "active", "a"),
        ("k", 2, "changed", False, 3, "pending", "active", "B"),
        ("k", 3, "kept", True, 1, "approved", "obsolete", "c"),  # the human decision stays
        ("other", 4, "kept", False, 1, "approved", "active", "d"),  # not of this pass
        ("k", 5, "added", False, 1, "pending", "active", "e"),
        ("k", 6, "kept", False, 1, "edited", "obsolete", "f"),  # reported before
        ("k", 7, "unchanged", False, 1, "approved", "active", "g"),  # came back with its decision
        ("k", 8, "unchanged", True, 1, "approved", "obsolete", "h"),  # canonical by now
    ]
    assert [r["key"] for r in ledger.archived(old, out, ["kind", "key"]).collect()] == [2]


DECISIONS = "item_id int, seq int, action string, reviewer string, reason string, replacement string, obsolete boolean"


def test_replay_rejects_bad_decisions(spark):
    def status(*actions, **over):
        base = {"reviewer": "r", "reason": "x", "replacement": "v", "obsolete": False} | over
        d = spark.createDataFrame([(1, i, a, base["reviewer"], base["reason"], base["replacement"], base["obsolete"]) for i, a in enumerate(actions)], DECISIONS)
        return rows(ledger.replay(d))[0][1:]

    assert status("defer", "approve", "defer") == ("approved", 2, 1)
    assert status("approve", "edit", "reject", "approve") == ("approved", 1, 3)
    assert status("approve", "reopen", "edit", "reopen", "reject", "reopen") == ("pending", 6, 0)
    assert status("reopen", "defer", "reopen", "apply") == ("deferred", 1, 3)
    assert status("edit", replacement=None) == status("approve", reviewer=" ") == status("approve", reason=None) == status("reject", obsolete=True) == ("pending", 0, 1)


def test_plan_blocks_conflicts(spark):
    items = spark.createDataFrame([(1, "a", "approved", "x"), (2, "a", "edited", "y"), (3, "b", "approved", "z"), (4, "c", "pending", "q")], "item_id int, subject_key string, status string, value string")
    canon = spark.createDataFrame([("b", "z")], "subject_key string, value string")
    plan = ledger.promotion_plan(items, canon)
    assert rows(plan, "item_id") == [(1, "a", "blocked", "competing_items"), (2, "a", "blocked", "competing_items"), (3, "b", "unchanged", None)]
    assert ledger.plan_id(plan).first()["plan_id"] == ledger.plan_id(plan.repartition(7)).first()["plan_id"]


def test_registered_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_freshness(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, fp string")
    old = spark.createDataFrame([(1, "x"), (1, "a"), (2, "old"), (3, "c"), (9, "z")], "k int, fp string")
    assert rows(review.freshness(now, old, "k", "fp")) == [(1, "fresh"), (2, "stale"), (3, "stale"), (4, "missing")]
    assert review.freshness(now.limit(0), old, "k", "fp").count() == 0


def test_readiness_needs_every_chapter(spark):
    c = spark.createDataFrame([("x", 1, "f"), ("x", 2, "f"), ("y", 1, "f"), ("y", 1, "f")], "book string, chapter int, fp string")
    o = spark.createDataFrame([("x", 1, "f"), ("x", 2, "other"), ("y", 1, "f")], "book string, chapter int, fp string")
    assert rows(review.export_readiness(c, o, "book", "chapter", "fp")) == [("x", 2, 1, False), ("y", 1, 1, True)]


def test_counts_lines_and_entries(spark):
    f = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "pos int, category string")
    assert [r["category"] for r in review.finding_counts(f, "category", "pos").orderBy("rank").collect()] == ["b", "a", None]
    t = spark.createDataFrame([(1, 1, " "), (1, 2, "one line"), (1, 3, "two"), (1, 4, "three"), (2, 1, None)], "u int, p int, t string")
    assert rows(review.context_lines(t, "u", "p", F.col("t"), 2, 3)) == [(1, "one\ntwo")]
    got = spark.createDataFrame([("Ann met bob",), (None,)], "t string").select(review.present_entries(F.col("t"), F.array(F.lit("BOB"), F.lit(""), F.lit("zed"), F.lit("ann")), 5))
    assert [r[0] for r in got.collect()] == [["BOB", "ann"], []]
    r = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("a", "a", 3)], "a string, b string, ref int")
    assert rows(review.relationship_refs(r), "name") == [("a", [2, 3]), ("b", [1, 2]), ("c", [1])]


def test_many_copies_leave_room_for_other_entries(spark):
    scored = spark.range(600).selectExpr("1 AS query_id", "int(id) AS entry_id", "'the sea is calm' AS source", "'A' AS translation", "1.0D AS score")
    other = spark.createDataFrame([(1, 900, "horses run over hills", "B", 0.5)], scored.schema)
    assert [r[:3] for r in rows(memory.rank_memory(scored.unionByName(other)))] == [(1, 1, 0), (1, 2, 900)]


def test_gate_counts_lacking_terms(spark):
    pairs = spark.createDataFrame([(1, "the dark lord came", "der dunkle Herr kam"), (2, "the dark lord came", "der Fuerst kam")], "unit_id int, source string, output string")
    terms = spark.createDataFrame([("Dark Lord", "dunkle herr"), ("", "x")], "source_term string, preferred_translation string")
    out = quality.gate(pairs, terms=terms).orderBy("unit_id").select("warnings", "score", "passes").collect()
    assert [tuple(r) for r in out] == [([], 1.0, True), (["term:Dark Lord"], 0.9, True)]


def test_a_line_in_a_long_passage_scores_whole(spark):
    line = "the harbour lay still under a grey and windless morning sky"
    q = spark.createDataFrame([(1, "Nobody spoke for a long while and the boats did not move at all that day. " + line + "; then came rain and more rain and cold.")], "query_id int, query string")
    m = spark.createDataFrame([(7, line, "t", None, None)], "entry_id int, source string, translation string, context string, tags array<string>")
    assert memory.score_memory(q, m).first()["score"] == 1.0


def test_memory_blocks_change_no_score(spark, monkeypatch):
    rows = [(i, f"word{i % 7} of line {i % 5}") for i in range(40)]
    q = spark.createDataFrame(rows[::5], "query_id int, query string")
    m = spark.createDataFrame([(i, t, t, "", []) for i, t in rows], "entry_id int, source string, translation string, context string, tags array<string>")
    whole = sorted(map(tuple, memory.score_memory(q, m).collect()))
    monkeypatch.setattr(memory, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, memory.score_memory(q, m).collect())) == whole


def test_hybrid_ranks_fuse(spark):
    scored = spark.createDataFrame([(1, 10, "a", "x", 0.9), (1, 11, "bb", "y", 0.9), (1, 12, "c", "z", 0.5)], "query_id int, entry_id int, source string, translation string, score double")
    semantic = spark.createDataFrame([(1, 12, 1), (1, 99, 2)], "query_id int, entry_id int, rank int")
    out = memory.hybrid_candidates(scored, semantic, most=2).orderBy("rank").select("entry_id", "native_rank", "semantic_rank", "relevance").collect()
    assert [tuple(r) for r in out] == [(12, 3, 1, 1.0), (10, 1, None, round(round(1 / 61, 9) / round(1 / 63 + 1 / 61, 9), 6))]
    entries = spark.createDataFrame([(12, "s", "t", " ctx "), (10, "u", "v", None)], "entry_id int, source string, translation string, context string")
    assert memory.memory_context(memory.hybrid_candidates(scored, semantic, most=2), entries).first()["context"] == "s => t | context: ctx\nu => v"


def test_files_that_cannot_be_read_have_error_rows(spark, tmp_path, monkeypatch):
    import zipfile

    from folium.sources import packages
    from folium.sources import text as source

    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "c.exe").write_text("x")
    assert sorted((r["path"].rsplit("/", 1)[1], r["error"]) for r in source.file_errors(spark, str(tmp_path)).collect()) == [("c.exe", "unsupported_format")]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("big.xml", "<a/>" * 1_000)
        z.writestr("small.xml", "<a/>")
    monkeypatch.setattr(packages, "MEMBER_BYTES", 100)
    import pandas as pd

    out = pd.concat(packages._members(iter([pd.DataFrame({"path": ["d", "e"], "content": [(tmp_path / "d.docx").read_bytes(), b"no archive"]})])))
    assert sorted(out["error"].dropna()) == ["corrupt_archive", "member_too_large:big.xml"] and list(out["member"].dropna()) == ["small.xml"]


def test_ranking_keeps_what_a_fold_over_the_entries_keeps(spark):
    words = ["sea", "calm", "night", "horse", "run", "hill"]
    entries = [(q, e, " ".join(words[(e * k + q) % 6] for k in (1, 2, 3, 5)), [None, "", "A", "B", "C", f"t{e % 7}"][(e * 5 + q) % 6], 1.0 - (e * 7 % 10) / 10) for q in range(4) for e in range(60)]
    scored = spark.createDataFrame(entries, "query_id int, entry_id int, source string, translation string, score double")
    sources = spark.createDataFrame([(x, y) for x in {e[2] for e in entries} for y in {e[2] for e in entries}], "a string, b string")
    near = {(r["a"], r["b"]) for r in sources.filter(text.similarity_normalized(F.col("a"), F.col("b")) >= 0.82).collect()}
    due = []
    for q in range(4):
        kept = []
        for e in sorted((e for e in entries if e[0] == q), key=lambda e: (-e[4], len(e[2]), e[1])):
            if len(kept) < 6 and not any((e[3] and k[3] and e[3].lower() == k[3].lower()) or (k[2], e[2]) in near for k in kept):
                kept.append(e)
        due += [(q, i + 1, e[1]) for i, e in enumerate(kept)]
    assert sorted(tuple(r)[:3] for r in memory.rank_memory(scored).collect()) == due


def test_lists_of_values_are_bounded_and_rows_whole(spark):
    seen = spark.range(50).selectExpr("if(id < 45, ' Hot', 'cold') AS k", "if(id < 45, concat('v', id), 'same') AS v", "if(id % 2 = 0, id, null) AS at")
    out = {r["key"]: r for r in quality.audit_consistency(seen, "k", "v", "at", evidence=3, listed=4).collect()}
    assert (out["hot"]["variants"], out["hot"]["n"], out["hot"]["n_variants"], out["hot"]["locations"], out["hot"]["stable"]) == (["v0", "v1", "v10", "v11"], 45, 45, [0, 2, 4], False)
    assert (out["cold"]["variants"], out["cold"]["n"], out["cold"]["n_variants"], out["cold"]["locations"], out["cold"]["stable"]) == (["same"], 5, 1, [46], True)
    assert quality.observed_values(seen, "k", "v", "at").count() == 46
    found = quality.term_conflicts(seen, "k", "v", listed=2).collect()
    assert len(found) == 45 and {r["n_alternatives"] for r in found} == {44}
    assert {r["translation"]: r["alternatives"] for r in found}["v0"] == ["v1", "v10"] and {r["translation"]: r["alternatives"] for r in found}["v9"] == ["v0", "v1"]


def test_a_word_of_many_names_stays_a_name(spark):
    names = spark.createDataFrame([(f"lady n{i}", 1) for i in range(200)] + [("lady", 9), ("n7", 3), ("alone", 2)], "name string, n int")
    out = {r["name"]: (r["n"], r["aliases"]) for r in matching.merge_short_names(names).collect()}
    assert out["lady"] == (9, []) and out["lady n7"] == (4, ["n7"]) and out["alone"] == (2, []) and len(out) == 202


def test_package_metadata_joins_what_is_known(spark):
    xml = '<m><dc:identifier id="x">http://a.org/1</dc:identifier><identifier>x //AO3.org/works/000</identifier><dc:source/><dc:source>https://ao3.org/works/0077?x</dc:source><dc:date>d1</dc:date><dc:date>d2</dc:date><dc:description> a\n &lt;b&gt;  &amp;amp; c </dc:description><subject>S</subject><dc:subject>T</dc:subject><dc:subject>S</dc:subject><rights> </rights></m>'
    many = "<m>" + "".join(f"<dc:subject>{'s' * 70}{i}</dc:subject>" for i in range(300)) + "</m>"
    df = spark.createDataFrame([(1, {"epub_date": "old", "source_url": "u", "k": "v"}, xml), (2, None, many), (3, {"source_url": "u"}, None), (4, None, "<dc:source>notao3.org/works/1 https://download.archiveofourown.com/works/2</dc:source>")], "id int, known map<string,string>, xml string")
    out = {r["id"]: r["m"] for r in df.select("id", packages.merge_package_metadata(F.col("known"), F.col("xml")).alias("m")).collect()}
    assert out[1] == {"epub_date": "old", "k": "v", "epub_identifier": "http://a.org/1", "epub_source": "https://ao3.org/works/0077?x", "epub_description": "a <b> &amp; c", "epub_subjects": "T | S", "source_site": "archiveofourown.org", "source_url": "https://archiveofourown.org/works/0", "ao3_work_id": "0"}
    due = " | ".join(f"{'s' * 70}{i}" for i in range(256))[:16384]
    assert out[2] == {"epub_subjects": due} and len(due) == 16384
    assert out[3] == {"source_url": "u"} and out[4] == {"epub_source": "notao3.org/works/1 https://download.archiveofourown.com/works/2"}


def test_aliases_and_upserts_in_order(spark):
    names, old = spark.createDataFrame([("Ann",), ("Bo",)], "name string"), spark.createDataFrame([("Ann", "Queen")], "canonical_name string, alias string")
    given = [(1, "Bo", "the QUEEN"), (2, "Bo", "queen"), (3, "Ann", "queen!"), (4, "Bo", "ann"), (5, "Bo", "King"), (6, "Ann", "king"), (7, "bo", "KING"), (8, "", "x"), (9, None, None), (10, "Ann", " "), (11, "Ann", "ANN"), (12, "Cy", "the queen")]
    out = matching.add_aliases(spark.createDataFrame(given, "position int, canonical_name string, alias string"), names, old)
    assert [(r["outcome"], r["owner"]) for r in out.orderBy("position").collect()] == [
        ("inserted", None), ("collision", "Ann"), ("unchanged", None), ("collision", "Ann"), ("inserted", None), ("collision", "Bo"), ("unchanged", None), ("empty_name", None), ("empty_name", None), ("empty_alias", None), ("unchanged", None), ("collision", "Bo"),
    ]
    canon = spark.createDataFrame([("k", "a")], "k string, v string")
    more = spark.createDataFrame([(1, "k", "b"), (2, "k", "b"), (3, "k", "a"), (4, "n", "x"), (5, "n", "y"), (6, "n", "x"), (7, None, "z")], "position int, k string, v string")
    done = lambda replace: [r["outcome"] for r in ledger.upserts_in_order(more, canon, "k", "v", replace=replace).orderBy("position").collect()]
    assert done(True) == ["replaced", "unchanged", "replaced", "inserted", "replaced", "replaced", "invalid"]
    assert done(False) == ["conflict", "conflict", "unchanged", "inserted", "conflict", "unchanged", "invalid"]
    pairs = spark.createDataFrame([("Ann", "bo"), ("BO", "ann!"), ("a", "A"), ("", "b"), (None, "b")], "a string, b string").select(ledger.pair_key(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r["p"] for r in pairs] == ["ann\nbo", "ann\nbo", None, None, None]


def test_recurring_phrases_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, "the old sea and the old sea") for i in range(12)] + [(3, "old sea")], "doc_id bigint, text string")
    found = mining.recurring_phrases(docs)
    row = found.filter("phrase = 'old sea'").first()
    assert (row["n"], row["n_docs"], row["first_doc"], row["evidence"]) == (25, 12, 0, list(range(8)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_names_count_the_same_with_and_without_evidence(spark):
    """Spellings of one key meet; the form first met is shown. Without evidence no table of names and documents is joined."""
    rows = [(2, 0, "Anna-Lee"), (1, 5, "ANNA LEE"), (1, 9, "Anna Lee"), (3, 1, "anna lee"), (3, 0, "Bob"), (4, 7, "Cy"), (2, 3, "Cy"), (4, 2, "--"), (5, 0, None)]
    df = spark.createDataFrame(rows, "doc_id int, position int, name string")
    plain = mining.name_counts(df, evidence=0)
    listed = lambda d: sorted((r["key"], r["display"], r["n"], r["confidence"]) for r in d.collect())
    assert listed(plain) == listed(mining.name_counts(df)) == [("anna lee", "ANNA LEE", 4, "moderate"), ("cy", "Cy", 2, "moderate")]
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString() and "evidence" not in plain.columns


def test_chapter_maps_scan_names_once(spark, tmp_path, monkeypatch):
    """Names are sought in the texts once, and so are names and terms."""
    from folium.plans import recall

    spark.createDataFrame([(i, "Anna met Bob.\nthe red stone" if i % 2 else "Anna sat", "s") for i in range(70)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "Anna x the red y"), (1, "q r sat")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, searched, plain, hits = spark.sparkContext.accumulator(0), [], recall.scan._candidates, recall.matching.phrase_hits
    monkeypatch.setattr(recall.scan, "_candidates", lambda t: (made.add(1), plain(t))[1])
    monkeypatch.setattr(recall.matching, "phrase_hits", lambda *a: (searched.append(1), hits(*a))[1])
    out = {r["doc_id"]: r["terms"] for r in recall.chapter_maps(spark, str(tmp_path)).collect()}
    assert len(out) == 70 and out[1] == "the red" and out[0] == "sat" and len(searched) == 1 and made.value == 70


def test_package_elements_are_sought_once(spark):
    """Each element is sought once for a package, whatever is made of its texts."""
    df = spark.createDataFrame([("<dc:source>x</dc:source><identifier>https://ao3.org/works/07</identifier><subject>s</subject>",), (None,)], "xml string")
    out = df.select(packages.merge_package_metadata(F.create_map(F.lit("epub_source"), F.lit("kept")), F.col("xml")).alias("m"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"<{tag}(?:") for tag in ("dc:identifier", "identifier", "dc:source", "source", "description", "subject")] == [1] * 6
    work = {"source_site": "archiveofourown.org", "source_url": "https://archiveofourown.org/works/7", "ao3_work_id": "7"}
    assert [r["m"] for r in out.collect()] == [{"epub_source": "kept", "epub_identifier": "https://ao3.org/works/07", "epub_subjects": "s", **work}, {"epub_source": "kept"}]
