"""Queries of plans, runs, audits and packets, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.text import upper_letters
from folium.operators import analysis, progress
from folium.sources.shared import stored


def _read(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


PLANNER = analysis.Planner(unit_chars=400, context_chars=120, most_names=3, most_terms=2)
SCENE_LINES = 9


def _manuscripts(spark, d) -> DataFrame:
    """Documents as chapters of their source; nine lines are a scene, lines are paragraphs."""
    rows = _read(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    scene = F.floor(F.col("pos") / SCENE_LINES).cast("int")
    return rows.select(
        F.col("source").alias("book"), F.concat(F.lit("chapter-"), F.col("doc_id").cast("string")).alias("chapter_id"), F.col("doc_id").alias("chapter_index"), F.concat(F.lit("scene-"), scene.cast("string")).alias("scene_id"), scene.alias("scene_order"),
        (F.col("pos") % SCENE_LINES + 1).alias("position"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("paragraph_id"), "text",
    )


def _entries(spark, d) -> tuple[DataFrame, DataFrame]:
    """First words of the items as names, two words of them as terms."""
    w = F.split("text", " ")
    rows = _read(spark, d, "benchmark")
    return rows.select(F.col("item_id").alias("position"), upper_letters(F.get(w, F.lit(0))).alias("value")), rows.select(F.col("item_id").alias("position"), F.array_join(F.slice(w, 4, 2), " ").alias("value"))


def _units(spark, d) -> DataFrame:
    return analysis.plan_units(_manuscripts(spark, d), *_entries(spark, d), PLANNER)


def analysis_units(spark, d):
    """Bounded units of all documents, with the scenes around and the names and terms that they hold."""
    out = _units(spark, d)
    return out.select(
        "book", "chapter_id", "scene_id", "chunk", "unit_id", F.sha2("text_content", 256).alias("text_sha"), F.size("paragraph_ids").alias("paragraphs"), F.sha2(F.coalesce("previous_context", F.lit("-")), 256).alias("previous_sha"),
        F.sha2(F.coalesce("next_context", F.lit("-")), 256).alias("next_sha"), F.array_join("known_names", ",").alias("names"), F.array_join("known_terms", ",").alias("terms"),
    )


def _provider(requests: DataFrame, attempt: int) -> DataFrame:
    """Answers by rule: some units answer at once, some at a later attempt, some never; findings cite marks of the unit and others."""
    n = F.crc32(F.encode("unit_id", "UTF-8"))
    way = n % 6
    status = F.when(way == 4, "permanent").when((way == 3) | (way > 4) & (n % 7 > attempt) | (way.between(1, 2) & (way > attempt)), "retryable").otherwise("ok")
    category = F.element_at(F.array(F.lit("tone"), F.lit("voice"), F.lit("plot")), (n % 3 + 1).cast("int"))
    one = F.struct(category.alias("category"), F.left("text_content", F.lit(30)).alias("claim"), (n % 11 / 10.0).cast("double").alias("confidence"), F.array(F.get("ordinals", F.lit(0))).alias("evidence"))
    two = F.struct(F.lit("tone").alias("category"), F.when(n % 5 == 0, " ").otherwise("same").alias("claim"), F.lit(0.9).alias("confidence"), F.array(F.get("ordinals", F.lit(0)), F.when(n % 4 == 0, "para-99").otherwise("para-2")).alias("evidence"))
    return requests.select("unit_id", status.alias("status"), F.when(status != "ok", F.concat(F.lit("error "), way.cast("string"))).alias("error"), F.array(one, two).alias("findings"), (n % 100).alias("tokens"))


IDENTITY = ["1", "v1", "rules", "m", PLANNER.fingerprint(), "canon"]
CATEGORIES = ["tone", "voice"]


def _run(spark, d) -> analysis.Run:
    """A run over all units whose cache has what an earlier run over half of the chapters left."""
    units = stored(_units(spark, d).select("chapter_index", "unit_id", "text_content", "ordinals"))
    empty = spark.createDataFrame([], "key string, unit_id string, findings array<struct<category:string,claim:string,confidence:double,evidence:array<string>>>, stored_at int")
    first = analysis.run(units.filter("chapter_index % 2 = 0"), empty, _provider, IDENTITY, CATEGORIES, F.lit(1), entries=None)
    return analysis.run(units, stored(first.cache), _provider, IDENTITY, CATEGORIES, F.lit(2), entries=None)


def analysis_outcomes(spark, d):
    """What became of each unit in the second run: cached, succeeded after some attempts, or failed."""
    return _run(spark, d).outcomes


def analysis_findings(spark, d):
    """Valid findings of the second run, from the cache and from answers."""
    return _run(spark, d).findings.select("unit_id", "category", F.sha2("claim", 256).alias("claim_sha"), F.round("confidence", 6).alias("confidence"), F.array_join("evidence", ",").alias("evidence"), "level", "cached")


UNITS_SQL = f"""
WITH RECURSIVE lines AS (SELECT doc_id, source, unnest(a) AS text, unnest(range(len(a))) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents)),
par AS (SELECT source AS book, doc_id, pos // {SCENE_LINES} AS scene, (pos % {SCENE_LINES} + 1) AS position, text, row_number() OVER (PARTITION BY doc_id, pos // {SCENE_LINES} ORDER BY pos) AS i FROM lines WHERE trim(text) <> ''),
fill AS (SELECT doc_id, scene, i, length(text) AS used, 0 AS chunk FROM par WHERE i = 1
    UNION ALL SELECT p.doc_id, p.scene, p.i, CASE WHEN f.used + length(p.text) > {PLANNER.unit_chars} THEN length(p.text) ELSE f.used + length(p.text) END, CASE WHEN f.used + length(p.text) > {PLANNER.unit_chars} THEN f.chunk + 1 ELSE f.chunk END
    FROM fill f JOIN par p ON p.doc_id = f.doc_id AND p.scene = f.scene AND p.i = f.i + 1),
body AS (SELECT book, doc_id, scene, chunk, string_agg('[para-' || position || '] ' || text, chr(10) || chr(10) ORDER BY i) AS content, count(*)::INT AS paragraphs, list('para-' || position ORDER BY i) AS ordinals FROM par JOIN fill USING (doc_id, scene, i) GROUP BY ALL),
units AS (SELECT *, 'unit-' || sha256('chapter-' || doc_id || chr(0) || 'scene-' || scene || chr(0) || chunk || chr(0) || sha256(content)) AS unit_id FROM body),
scenes AS (SELECT doc_id, scene, string_agg(text, chr(10) || chr(10) ORDER BY i) AS t FROM par GROUP BY ALL),
heads AS (SELECT doc_id, scene, CASE WHEN length(t) > {PLANNER.context_chars} THEN left(t, {PLANNER.context_chars}) || ' …' ELSE t END AS h FROM scenes),
near AS (SELECT doc_id, scene, lag(h) OVER w AS p, lead(h) OVER w AS n FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY scene)),
entries AS (SELECT item_id, upper(string_split(text, ' ')[1]) AS name, array_to_string(string_split(text, ' ')[4:5], ' ') AS term FROM benchmark),
hits AS (SELECT unit_id, list(name ORDER BY item_id) FILTER (trim(name) <> '' AND contains(lower(content), lower(name))) AS names, list(term ORDER BY item_id) FILTER (trim(term) <> '' AND contains(lower(content), lower(term))) AS terms FROM units, entries GROUP BY unit_id)"""

ANALYSIS_UNITS_SQL = UNITS_SQL + f"""
SELECT book, 'chapter-' || doc_id AS chapter_id, 'scene-' || scene AS scene_id, chunk, unit_id, sha256(content) AS text_sha, paragraphs, sha256(coalesce(p, '-')) AS previous_sha, sha256(coalesce(n, '-')) AS next_sha,
    coalesce(array_to_string(names[1:{PLANNER.most_names}], ','), '') AS names, coalesce(array_to_string(terms[1:{PLANNER.most_terms}], ','), '') AS terms
FROM units JOIN near USING (doc_id, scene) JOIN hits USING (unit_id)"""


def _crc_sql(x: str) -> str:
    """crc32 of ASCII text."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({x}) + 1), lambda i: ascii({x}[i])::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
    )


RUN_SQL = UNITS_SQL + f""",
rule AS (SELECT *, n % 6 AS way FROM (SELECT *, {_crc_sql('unit_id')} AS n FROM units)),
tries AS (SELECT rule.*, t.attempt, CASE WHEN way = 4 THEN 'permanent' WHEN way = 3 OR (way > 4 AND n % 7 > t.attempt) OR (way BETWEEN 1 AND 2 AND way > t.attempt) THEN 'retryable' ELSE 'ok' END AS status FROM rule, (VALUES (0), (1), (2)) t(attempt)),
last AS (SELECT * FROM tries QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY (status <> 'retryable')::INT DESC, CASE WHEN status <> 'retryable' THEN attempt ELSE -attempt END) = 1),
outcome AS (SELECT *, doc_id % 2 = 0 AND status = 'ok' AS cached FROM last),
found AS (SELECT unit_id, cached, ordinals, ['tone', 'voice', 'plot'][n % 3 + 1] AS category, left(content, 30) AS claim, (n % 11) / 10.0::DOUBLE AS confidence, [ordinals[1]] AS evidence FROM outcome WHERE status = 'ok'
    UNION ALL SELECT unit_id, cached, ordinals, 'tone', CASE WHEN n % 5 = 0 THEN ' ' ELSE 'same' END, 0.9::DOUBLE, [ordinals[1], CASE WHEN n % 4 = 0 THEN 'para-99' ELSE 'para-2' END] FROM outcome WHERE status = 'ok')"""

OUTCOMES_SQL = RUN_SQL + """
SELECT unit_id, CASE WHEN cached THEN 'cached' WHEN status = 'ok' THEN 'succeeded' ELSE 'failed' END AS outcome, CASE WHEN cached THEN 0 ELSE attempt + 1 END::INT AS attempts, CASE WHEN status <> 'ok' THEN 'error ' || way END AS error,
    CASE WHEN status <> 'ok' THEN status = 'retryable' END AS retryable, CASE WHEN NOT cached THEN n % 100 END AS tokens FROM outcome"""

FINDINGS_SQL = RUN_SQL + """
SELECT unit_id, category, sha256(claim) AS claim_sha, round(confidence, 6) AS confidence, array_to_string(evidence, ',') AS evidence, CASE WHEN confidence >= 0.8 AND len(list_distinct(evidence)) >= 2 THEN 'high' WHEN confidence >= 0.5 THEN 'moderate' ELSE 'low' END AS level, cached
FROM found WHERE category IN ('tone', 'voice') AND trim(claim) <> '' AND len(list_filter(evidence, lambda x: NOT list_contains(ordinals, x))) = 0"""


def _books(spark, d) -> DataFrame:
    """Orders of a customer as the chapters of a project, by date."""
    o = _read(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("position"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("c-"), F.col("o_orderkey").cast("string")).alias("stem"),
        F.col("o_orderstatus").alias("source_fp"), F.col("o_orderpriority").alias("context_fp"), (F.col("o_orderkey") % 9 + 1).alias("paragraphs"),
    )


def _gate(chapters: DataFrame) -> DataFrame:
    """Chapters that the quality gate blocks under the first plan, and some under the second."""
    k = F.col("position")
    blocked = (k % 17 == 0) & (F.col("plan_fp") == "plan-1") | (k % 41 == 0)
    return chapters.select("project", "position", F.when(blocked, F.concat(F.lit("quality gate blocked "), "stem")).alias("error"))


def _progress(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two runs of every project: the first does up to four chapters; the second resumes, under another plan or source for some, with lost artifacts for others."""
    books, who = _books(spark, d), _read(spark, d, "customer").select(F.col("c_custkey").alias("project"))
    k = F.col("project")
    none = F.lit(None).cast("string")
    empty = spark.createDataFrame([], "project bigint, stem string, source_fp string, context_fp string, plan_fp string, structured boolean, seq int")
    start = who.select("project", F.lit(1).alias("seq"), F.lit("s").alias("source_fp"), F.lit("plan-1").alias("plan_fp"), F.lit(False).alias("resume"), (k % 13 == 0).alias("paused"), F.lit(4).alias("most_chapters"), none.alias("previous_plan"), none.alias("previous_source"))
    made, first = progress.run(books, empty, start, _gate)
    made, first = stored(made), stored(first)
    kept = made.withColumn("structured", F.pmod(F.length("stem") + F.col("project"), F.lit(5)) != 0)
    changed = books.withColumn("context_fp", F.when(F.col("position") % 10 == 0, "edited").otherwise(F.col("context_fp")))
    again = who.select("project", F.lit(2).alias("seq"), F.when(k % 11 == 0, "t").otherwise("s").alias("source_fp"), F.when(k % 3 == 0, "plan-2").otherwise("plan-1").alias("plan_fp"), (k % 19 != 0).alias("resume"), F.lit(False).alias("paused"), F.when(k % 2 == 0, 3).alias("most_chapters"), F.when(k % 7 == 0, "").otherwise("plan-1").alias("previous_plan"), F.lit("s").alias("previous_source"))
    more, second = progress.run(changed, kept, again, _gate)
    return made.unionByName(more), first.unionByName(second)


def translation_progress(spark, d):
    return _progress(spark, d)[1].withColumn("warnings", F.array_join("warnings", "|"))


def translation_checkpoints(spark, d):
    return _progress(spark, d)[0].drop("structured")


def _run_sql(name: str, chapters: str, kept: str, runs: str) -> str:
    """One run in SQL: {name}_v has the chapters with their state, {name}_p the progress."""
    return f"""
{name}_r AS ({runs}),
{name}_j AS (SELECT c.*, r.seq, r.plan_fp, r.resume, r.paused, r.most, coalesce(r.resume AND k.source_fp = c.source_fp AND k.context_fp = c.context_fp AND k.plan_fp = r.plan_fp, false) AS same, coalesce(k.structured, false) AS structured
    FROM {chapters} c JOIN {name}_r r USING (project) LEFT JOIN {kept} k ON k.project = c.project AND k.stem = c.stem WHERE r.refusal IS NULL),
{name}_t AS (SELECT *, same AND structured AS reused, sum((NOT (same AND structured))::INT) OVER (PARTITION BY project ORDER BY position) AS turn FROM {name}_j),
{name}_w AS (SELECT *, NOT paused AND (most IS NULL OR turn <= most) AS inside, (position % 17 = 0 AND plan_fp = 'plan-1') OR position % 41 = 0 AS bad FROM {name}_t),
{name}_b AS (SELECT project, min(position) AS stop, 'quality gate blocked c-' || min(position) AS error FROM {name}_w WHERE inside AND NOT reused AND bad GROUP BY project),
{name}_v AS (SELECT w.*, b.stop, b.error, inside AND (b.stop IS NULL OR position < b.stop) AS visited, inside AND (b.stop IS NULL OR position <= b.stop) AS seen FROM {name}_w w LEFT JOIN {name}_b b USING (project)),
{name}_c AS (SELECT project, count(*) FILTER (visited) AS done, sum(paragraphs) FILTER (visited) AS paragraphs, count(*) FILTER (visited AND reused) AS reused, count(*) AS total, max(position) FILTER (seen AND NOT reused) AS current, max(position) FILTER (visited) AS last_done,
    string_agg('checkpoint for ' || title || ' lacks a matching structured artifact or required provenance; translating again', '|' ORDER BY title) FILTER (seen AND same AND NOT reused) AS notes, any_value(error) AS error FROM {name}_v GROUP BY project),
{name}_p AS (SELECT project, seq, CASE WHEN refusal IS NOT NULL THEN refusal WHEN error IS NOT NULL THEN 'failed' WHEN paused THEN 'paused' WHEN coalesce(done, 0) >= coalesce(total, 0) THEN 'completed' ELSE 'paused' END AS state, coalesce(done, 0) AS completed_chapters,
    coalesce(paragraphs, 0)::BIGINT AS completed_paragraphs, coalesce(reused, 0) AS reused, coalesce(total, 0) AS total_chapters, CASE WHEN refusal IS NULL THEN CASE WHEN coalesce(total, 0) = 0 THEN 1.0::DOUBLE ELSE round(done::DOUBLE / total, 6) END END AS percent, current,
    'c-' || last_done || '.txt' AS last_checkpoint, concat_ws('|', CASE WHEN refusal IS NULL AND resume AND previous_plan <> plan_fp THEN CASE WHEN previous_plan = '' THEN 'legacy checkpoints have no translation-plan fingerprint; they will be regenerated'
        ELSE 'translation plan changed; checkpoints from the previous provider/model/target/style plan will be regenerated' END END, notes) AS warnings, error FROM {name}_r LEFT JOIN {name}_c USING (project))"""


PROGRESS_SQL = "WITH " + f"""books AS (SELECT o_custkey AS project, o_orderkey AS position, 'Order ' || o_orderkey AS title, 'c-' || o_orderkey AS stem, o_orderstatus AS source_fp, o_orderpriority AS context_fp, o_orderkey % 9 + 1 AS paragraphs FROM orders),
nothing AS (SELECT NULL::BIGINT AS project, NULL::VARCHAR AS stem, NULL::VARCHAR AS source_fp, NULL::VARCHAR AS context_fp, NULL::VARCHAR AS plan_fp, false AS structured WHERE false),
{_run_sql('a', 'books', 'nothing', "SELECT c_custkey AS project, 1 AS seq, 'plan-1' AS plan_fp, false AS resume, c_custkey % 13 = 0 AS paused, 4 AS most, NULL::VARCHAR AS previous_plan, NULL::VARCHAR AS refusal FROM customer")},
kept AS (SELECT project, stem, source_fp, context_fp, plan_fp, (length(stem) + project) % 5 <> 0 AS structured FROM a_v WHERE visited AND NOT reused),
changed AS (SELECT * REPLACE (CASE WHEN position % 10 = 0 THEN 'edited' ELSE context_fp END AS context_fp) FROM books),
{_run_sql('b', 'changed', 'kept', "SELECT c_custkey AS project, 2 AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'plan-2' ELSE 'plan-1' END AS plan_fp, c_custkey % 19 <> 0 AS resume, false AS paused, CASE WHEN c_custkey % 2 = 0 THEN 3 END AS most, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'plan-1' END AS previous_plan, CASE WHEN c_custkey % 19 = 0 THEN 'already_running' WHEN c_custkey % 11 = 0 THEN 'resume_incompatible' END AS refusal FROM customer")}"""

QUERIES = (analysis_units, analysis_outcomes, analysis_findings, translation_progress, translation_checkpoints)
ORACLES = {
    "analysis_units": ANALYSIS_UNITS_SQL, "analysis_outcomes": OUTCOMES_SQL, "analysis_findings": FINDINGS_SQL, "translation_progress": PROGRESS_SQL + " SELECT * FROM a_p UNION ALL SELECT * FROM b_p",
    "translation_checkpoints": PROGRESS_SQL + " SELECT project, stem, source_fp, context_fp, plan_fp, seq FROM a_v WHERE visited AND NOT reused UNION ALL SELECT project, stem, source_fp, context_fp, plan_fp, seq FROM b_v WHERE visited AND NOT reused",
}
