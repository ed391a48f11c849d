"""Queries of nested validators, blind reviews and book audits, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.operators import audit, blind, checks


def _read(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _corpora(spark, d) -> DataFrame:
    """Conversations as corpora, turns as cases, some of them broken somewhere."""
    c, t = F.col("conv_id"), F.col("turn")
    word = lambda i: F.get(F.split("text", " "), F.lit(i))
    dims = F.when((c + t) % 41 == 0, F.array().cast("array<string>")).when((c * t) % 53 == 1, F.array(*map(F.lit, "abcde"))).otherwise(F.array(F.lit("voice"), F.lit("terms")))
    anchor = lambda i, bad: F.struct(F.when((c * 2 + t) % 47 == i, " ").when((c + 5 * t) % 43 == 2, "a0").otherwise(f"a{i}").alias("id"), F.when((c * 3 + t) % bad == i, "tone").otherwise("voice").alias("dimension"), F.when((c * 7 + t) % 37 == i, F.array().cast("array<string>")).when((c * 7 + t) % 39 == i, F.array(word(i), F.lit(" "))).otherwise(F.array(word(i))).alias("values"))
    variant = F.struct(F.lit("v").alias("id"), F.when((c + t) % 61 == 3, "").otherwise(F.upper("text")).alias("translation"), F.when((c + t) % 59 == 5, "tone").otherwise("terms").alias("degradation"), F.lit("upper case").alias("description"))
    twice = F.when((c + t) % 67 == 4, F.array(variant, variant)).otherwise(F.array(variant))
    case = F.struct(t.alias("t"), _text("case-", F.when(c % 13 == 0, F.floor(t / 2)).otherwise(t)).alias("id"), F.when((c + 2 * t) % 71 == 6, " ").otherwise("title").alias("title"), F.col("text").alias("source"), F.col("text").alias("reference"), dims.alias("dimensions"), F.array(anchor(0, 29), anchor(1, 31)).alias("anchors"), twice.alias("variants"))
    cases = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(case)).alias("cases"))
    kept = F.when(c % 17 == 3, F.slice("cases", 1, 0)).otherwise(F.col("cases"))
    return cases.select(
        c.alias("corpus"), F.when(c % 31 == 1, 2).otherwise(1).alias("schema_version"), _text("corpus ", c).alias("corpus_id"), F.when(c % 29 == 2, "").otherwise("t").alias("title"), F.lit("en").alias("source_language"),
        F.when(c % 23 == 4, " ").otherwise("fa").alias("target_language"), (c % 19 != 5).alias("rights_safe"), F.lit("o").alias("owner"), F.lit("l").alias("license"), F.when(c % 37 != 6, "n").alias("creation_note"), kept.alias("cases"),
    )


def corpus_failures(spark, d):
    return checks.corpus_failures(_corpora(spark, d)).select("corpus", "rule", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


CORPUS_SQL = """
WITH t AS (SELECT conv_id AS c, turn AS t, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 'case-' || CASE WHEN conv_id % 13 = 0 THEN turn // 2 ELSE turn END AS id FROM conversations WHERE conv_id % 17 <> 3),
head AS (SELECT c, [-1, 0, 0] AS path, CASE WHEN c % 31 = 1 THEN 'schema' WHEN c % 29 = 2 THEN 'identity' WHEN c % 23 = 4 THEN 'languages' WHEN c % 19 = 5 THEN 'rights' WHEN c % 37 = 6 THEN 'provenance' WHEN c % 17 = 3 THEN 'no_cases' END AS rule FROM (SELECT DISTINCT conv_id AS c FROM conversations)),
cases AS (SELECT c, t, pos, CASE WHEN row_number() OVER (PARTITION BY c, id ORDER BY pos) > 1 THEN 'duplicate_case' WHEN (c + 2 * t) % 71 = 6 OR trim(text) = '' THEN 'case_fields' WHEN (c + t) % 41 = 0 OR (c * t) % 53 = 1 THEN 'dimensions' END AS rule,
    CASE WHEN (c + t) % 41 = 0 THEN [] WHEN (c * t) % 53 = 1 THEN ['a', 'b', 'c', 'd', 'e'] ELSE ['voice', 'terms'] END AS dims, string_split(text, ' ') AS w FROM t),
anchors AS (SELECT c, t, pos, dims, i, CASE WHEN (c * 2 + t) % 47 = i THEN ' ' WHEN (c + 5 * t) % 43 = 2 THEN 'a0' ELSE 'a' || i END AS id, CASE WHEN (c * 3 + t) % (29 + 2 * i) = i THEN 'tone' ELSE 'voice' END AS dim,
    CASE WHEN (c * 7 + t) % 37 = i THEN [] WHEN (c * 7 + t) % 39 = i THEN [w[i + 1], ' '] ELSE [w[i + 1]] END AS vals FROM cases, (VALUES (0), (1)) x(i)),
wrong AS (SELECT c, pos, i, CASE WHEN trim(id) = '' OR len(vals) = 0 THEN 'empty_anchor' WHEN NOT list_contains(dims, dim) THEN 'anchor_dimension' WHEN len(list_filter(vals, lambda v: trim(coalesce(v, '')) = '')) > 0 THEN 'anchor_value'
    WHEN row_number() OVER (PARTITION BY c, pos, id ORDER BY i) > 1 THEN 'duplicate_anchor' END AS rule FROM anchors),
variants AS (SELECT c, pos, dims, j, CASE WHEN (c + t) % 61 = 3 OR trim(array_to_string(w, ' ')) = '' THEN 'incomplete_variant' WHEN NOT list_contains(dims, CASE WHEN (c + t) % 59 = 5 THEN 'tone' ELSE 'terms' END) THEN 'variant_dimension' WHEN j = 1 THEN 'duplicate_variant' END AS rule
    FROM cases, (VALUES (0), (1)) x(j) WHERE j = 0 OR (c + t) % 67 = 4),
faults AS (SELECT c, path, rule FROM head UNION ALL SELECT c, [pos, 0, 0], rule FROM cases UNION ALL SELECT c, [pos, 1, i], rule FROM wrong UNION ALL SELECT c, [pos, 2, j], rule FROM variants)
SELECT c AS corpus, rule, array_to_string(CASE path[1] WHEN -1 THEN path ELSE path END, '.') AS path FROM faults WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY path[1], path[2], path[3]) = 1
"""


def _ledgers(spark, d) -> DataFrame:
    """Orders of a customer as a review ledger."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 2 == 0, "character").otherwise("terminology")
    status = F.element_at(F.array(*map(F.lit, ("pending", "approved", "edited", "rejected", "applied"))), (k % 5 + 1).cast("int"))
    reviewed = F.when(k % 97 != 1, F.struct(F.when(k % 89 == 2, "relationship").otherwise(kind).alias("kind"), F.when(k % 83 == 3, " ").otherwise("s").alias("subject")))
    item = F.struct(
        k.alias("k"), F.when(k % 73 == 4, "same").otherwise(k.cast("string")).alias("id"), kind.alias("kind"), F.when(k % 79 == 5, "literary").otherwise(kind).alias("proposed_kind"), kind.alias("original_kind"), k.cast("string").alias("proposal_id"),
        F.when(k % 101 != 6, k.cast("string")).alias("original_proposal_id"), F.when(k % 103 == 7, "").otherwise("key").alias("subject_key"), F.when(k % 107 == 8, 0).otherwise(1).alias("revision"), F.lit("fp").alias("fingerprint"), status.alias("status"), reviewed.alias("reviewed"),
    )
    return _read(spark, d, "orders").groupBy(c.alias("ledger")).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumns({"schema_version": F.when(F.col("ledger") % 41 == 9, 3).otherwise(1), "manuscript_id": F.when(F.col("ledger") % 43 == 10, " ").otherwise("m")})


def ledger_failures(spark, d):
    return checks.ledger_failures(_ledgers(spark, d)).select("ledger", "rule", F.get("path", F.lit(0)).alias("place"))


LEDGER_SQL = """
WITH i AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 73 = 4 THEN 'same' ELSE o_orderkey::VARCHAR END AS id, o_orderkey % 5 IN (1, 2, 4) AS judged FROM orders),
f AS (SELECT c, pos, CASE WHEN row_number() OVER (PARTITION BY c, id ORDER BY pos) > 1 THEN 'duplicate_item' WHEN k % 79 = 5 THEN 'kind' WHEN k % 101 = 6 OR k % 103 = 7 OR k % 107 = 8 THEN 'identity' WHEN judged AND k % 97 = 1 THEN 'unreviewed' WHEN judged AND k % 89 = 2 THEN 'reviewed_kind' WHEN judged AND k % 83 = 3 THEN 'reviewed_value' END AS rule FROM i
    UNION ALL SELECT DISTINCT o_custkey, -1, CASE WHEN o_custkey % 41 = 9 THEN 'schema' WHEN o_custkey % 43 = 10 THEN 'manuscript' END FROM orders)
SELECT c AS ledger, rule, pos::INT AS place FROM f WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY pos) = 1
"""


def _blind(spark, d) -> tuple[DataFrame, DataFrame]:
    """Conversations as reveals whose turns are cases; four reviewers each, some of their ledgers not admissible."""
    c, t, r = F.col("conv_id"), F.col("turn"), F.col("reviewer_no")
    turns = _read(spark, d, "conversations").select("conv_id", "turn")
    sha = F.sha2(c.cast("string"), 256)
    assignment = F.struct(_text("case-", t).alias("case_id"), F.when((c + t) % 2 == 0, "one").otherwise("two").alias("a_system"), F.when((c + t) % 83 == 1, "other").when((c + t) % 2 == 0, "two").otherwise("one").alias("b_system"))
    keys = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(assignment)).alias("assignments"))
    keys = keys.select(c.alias("reveal"), F.when(c % 29 == 2, 1).otherwise(2).alias("schema_version"), F.when(c % 29 != 2, F.when(c % 31 == 3, "short").otherwise(sha)).alias("bundle_sha256"), _text("corpus ", c).alias("corpus_id"), F.lit("one").alias("system_one"), F.lit("two").alias("system_two"), "assignments")
    rows = turns.withColumn("reviewer_no", F.explode(F.sequence(F.lit(0), F.lit(3))))
    decision = F.when((c * 5 + t + r) % 59 == 0, "pending").otherwise(F.element_at(F.array(*map(F.lit, blind.DECISIONS)), ((c + t * r) % 4 + 1).cast("int")))
    case = F.struct(_text("case-", t).alias("case_id"), decision.alias("decision"), F.when((decision != "pending") & ((c + t + 7 * r) % 61 != 0), "because").alias("reason"))
    cases = rows.filter((c + r) % 37 != 0).groupBy("conv_id", "reviewer_no").agg(F.array_sort(F.collect_list(case)).alias("cases"))
    less = F.when((c + r) % 23 == 0, F.slice("cases", 2, 1 << 30)).otherwise(F.col("cases"))
    ledgers = cases.select(
        F.concat_ws("-", c.cast("string"), r.cast("string")).alias("review"), c.alias("reveal"), r.alias("position"), F.when(c % 29 == 2, 1).otherwise(2).alias("schema_version"), F.when(c % 29 != 2, F.when((c + r) % 41 == 5, F.sha2(F.lit("x"), 256)).otherwise(sha)).alias("bundle_sha256"),
        F.when((c + 3 * r) % 43 == 6, "another").otherwise(_text("corpus ", c)).alias("corpus_id"), F.when((c + r) % 47 == 7, "b2").otherwise("b1").alias("bundle_fingerprint"), F.when((c % 7 == 0) & (r == 3), "reviewer 1").otherwise(_text("reviewer ", r)).alias("reviewer"), less.alias("cases"),
    )
    return ledgers, keys


def inadmissible_reviews(spark, d):
    return blind.inadmissible(*_blind(spark, d))


def blind_preferences(spark, d):
    return blind.preferences(*_blind(spark, d)).groupBy("reveal", "preferred").agg(F.count(F.lit(1)).alias("n"))


BLIND_SQL = """
WITH t AS (SELECT conv_id AS c, turn AS t FROM conversations),
a AS (SELECT c, t, CASE WHEN (c + t) % 2 = 0 THEN 'one' ELSE 'two' END AS a, CASE WHEN (c + t) % 83 = 1 THEN 'other' WHEN (c + t) % 2 = 0 THEN 'two' ELSE 'one' END AS b FROM t),
keys AS (SELECT c, CASE WHEN c % 29 <> 2 AND c % 31 = 3 THEN 'key_digest_form' WHEN bool_or(b = 'other') THEN 'key_unknown_system' END AS odd, count(*) AS n FROM a GROUP BY c),
l AS (SELECT c, t, r, CASE WHEN (c * 5 + t + r) % 59 = 0 THEN 'pending' ELSE ['candidate_a', 'candidate_b', 'tie', 'defer'][(c + t * r) % 4 + 1] END AS decision FROM t, (VALUES (0), (1), (2), (3)) x(r) WHERE (c + r) % 37 <> 0),
k AS (SELECT * FROM l QUALIFY (c + r) % 23 <> 0 OR row_number() OVER (PARTITION BY c, r ORDER BY 'case-' || t) > 1),
size AS (SELECT c, r, count(k.t) AS n, coalesce(bool_or(decision = 'pending'), false) AS pending, coalesce(bool_or(decision <> 'pending' AND (c + k.t + 7 * r) % 61 = 0), false) AS silent FROM (SELECT DISTINCT c, r FROM l) LEFT JOIN k USING (c, r) GROUP BY c, r),
j AS (SELECT size.*, keys.odd, keys.n AS wanted, (c + r) % 47 = 7 AS second, CASE WHEN c % 7 = 0 AND r = 3 THEN 1 ELSE r END AS who, first_value((c + r) % 47 = 7) OVER (PARTITION BY c ORDER BY r) AS first FROM size JOIN keys USING (c)),
v AS (SELECT c, r, CASE WHEN odd IS NOT NULL THEN odd WHEN n = 0 THEN 'no_cases' WHEN silent THEN 'missing_reason' WHEN (c + 3 * r) % 43 = 6 THEN 'other_corpus' WHEN second <> first THEN 'other_bundle' WHEN c % 29 <> 2 AND (c + r) % 41 = 5 THEN 'unbound'
    WHEN row_number() OVER (PARTITION BY c, who ORDER BY r) > 1 THEN 'reviewer_twice' WHEN n <> wanted THEN 'other_cases' WHEN pending THEN 'pending' END AS rule FROM j)"""


def review_records(spark, d):
    """Events as records of decisions of their user's ledger, accepted or refused, the accepted ones chained."""
    e = _read(spark, d, "events")
    n = F.col("event_id")
    decision = F.element_at(F.array(*map(F.lit, (*blind.DECISIONS, "maybe"))), (n % 5 + 1).cast("int"))
    records = e.select(F.col("user_id").alias("ledger"), n.alias("seq"), (n % 7).alias("case_id"), decision.alias("decision"), F.when(n % 11 != 0, F.concat(F.lit(" "), "event_type")).alias("reason"), F.lit("").alias("notes"))
    cases = e.select(F.col("user_id").alias("ledger")).distinct().withColumn("case_id", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")))
    state, odd = blind.recorded(cases, records)
    chain = blind.chained(records.join(odd.select("ledger", "seq"), ["ledger", "seq"], "left_anti"), "ledger", ["seq"], ["seq", "case_id", "decision", "reason"])
    last = chain.groupBy("ledger").agg(F.max_by("digest", "seq").alias("digest"), F.count(F.lit(1)).alias("accepted"))
    refused = odd.groupBy("ledger").agg(F.count(F.lit(1)).alias("refused"))
    open_ = state.groupBy("ledger").agg(F.count_if(F.col("decision") == "pending").alias("pending"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "decision"))), lambda x: x["decision"]), ",").alias("decisions"))
    return open_.join(last, "ledger", "left").join(refused, "ledger", "left").select("ledger", "pending", "decisions", "digest", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("refused", F.lit(0)).alias("refused"))


RECORDS_SQL = """
WITH RECURSIVE r AS (SELECT user_id AS ledger, event_id AS n, event_id % 7 AS case_id, ['candidate_a', 'candidate_b', 'tie', 'defer', 'maybe'][event_id % 5 + 1] AS decision, ' ' || event_type AS reason, event_id % 7 < 6 AND event_id % 5 < 4 AND event_id % 11 <> 0 AS fit FROM events),
fit AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY n) AS i FROM r WHERE fit),
chain AS (SELECT ledger, i, sha256(repeat('0', 64) || chr(31) || n || chr(31) || case_id || chr(31) || decision || chr(31) || reason) AS digest FROM fit WHERE i = 1
    UNION ALL SELECT f.ledger, f.i, sha256(c.digest || chr(31) || f.n || chr(31) || f.case_id || chr(31) || f.decision || chr(31) || f.reason) FROM chain c JOIN fit f ON f.ledger = c.ledger AND f.i = c.i + 1),
last AS (SELECT ledger, arg_max(digest, i) AS digest, count(*) AS accepted FROM chain GROUP BY ledger),
cases AS (SELECT DISTINCT user_id AS ledger, unnest(range(6)) AS case_id FROM events),
state AS (SELECT ledger, case_id, coalesce(arg_max(decision, n), 'pending') AS decision FROM cases LEFT JOIN (SELECT ledger, case_id, decision, n FROM fit) USING (ledger, case_id) GROUP BY ALL),
odd AS (SELECT ledger, count(*) AS refused FROM r WHERE NOT fit GROUP BY ledger)
SELECT ledger, count(*) FILTER (decision = 'pending') AS pending, string_agg(decision, ',' ORDER BY case_id) AS decisions, any_value(digest) AS digest, coalesce(any_value(accepted), 0) AS accepted, coalesce(any_value(refused), 0) AS refused
FROM state LEFT JOIN last USING (ledger) LEFT JOIN odd USING (ledger) GROUP BY ledger
"""


def _audit(spark, d) -> audit.Audit:
    """Customers as projects, their orders as chapters, most of them translated and reviewed."""
    o, who = _read(spark, d, "orders"), _read(spark, d, "customer")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    chapters = o.select(
        c.alias("project"), k.alias("chapter_index"), _text("ch-", k).alias("chapter_id"), F.col("o_orderstatus").alias("content_fp"), F.floor("o_totalprice").alias("n_chars"), (k % 9).alias("n_paragraphs"),
        F.when(k % 13 != 0, _text("p0-", k)).alias("first_paragraph"), _text("pl-", k).alias("longest_paragraph"), _text("pd-", k).alias("dialogue_paragraph"), (k % 6).alias("dialogue_score"),
    )
    done = o.filter((k % 17 != 1) | (c % 2 == 0)).select(c.alias("project"), k.alias("chapter_index"), F.when(k % 61 == 2, "moved").otherwise(_text("ch-", k)).alias("translated_id"), F.when(k % 67 == 3, "old").otherwise(F.col("o_orderstatus")).alias("source_fp"), F.when(k % 71 == 4, "plan 0").otherwise("plan").alias("plan_fp"), (k % 19 == 5).alias("quality_stale"), F.when(k % 11 == 6, _text("pm-", k)).alias("manual_paragraph"))
    seen = o.filter(k % 7 != 0).select(c.alias("project"), k.alias("chapter_index"), (k % 23 == 7).alias("stale"), (k % 29 == 8).alias("attention"))
    sums = chapters.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("n_paragraphs").alias("paragraphs"))
    projects = who.select(p.alias("project")).join(sums, "project", "left")
    projects = projects.select(
        "project", F.lit("s").alias("source_fp"), F.when(F.col("project") % 10 != 0, F.when(F.col("project") % 8 == 1, "paused").otherwise("completed")).alias("state"), F.coalesce("n", F.lit(0)).alias("completed_chapters"),
        (F.coalesce("paragraphs", F.lit(0)) + F.when(F.col("project") % 9 == 2, 1).otherwise(0)).alias("completed_paragraphs"), F.when(F.col("project") % 33 == 3, " ").otherwise("plan").alias("plan_fp"), F.when(F.col("project") % 21 == 4, "t").otherwise("s").alias("progress_source_fp"),
    )
    return audit.pilot_audit(projects, chapters, done, seen)


def pilot_issues(spark, d):
    return _audit(spark, d).issues


def pilot_summary(spark, d):
    return _audit(spark, d).summary


def pilot_review_targets(spark, d):
    return _audit(spark, d).targets.withColumn("reasons", F.array_join("reasons", ",")).withColumn("target_id", audit.target_id(F.col("project"), F.col("chapter_id"), F.col("paragraph_id")))


AUDIT_SQL = """
WITH ch AS (SELECT o_custkey AS project, o_orderkey AS k, 'ch-' || o_orderkey AS chapter_id, floor(o_totalprice) AS n_chars, o_orderkey % 9 AS n_paragraphs FROM orders),
tot AS (SELECT project, count(*) AS total_chapters, sum(n_paragraphs)::BIGINT AS total_paragraphs FROM ch GROUP BY project),
books AS (SELECT c_custkey AS project, coalesce(total_chapters, 0) AS total_chapters, coalesce(total_paragraphs, 0) AS total_paragraphs, CASE WHEN c_custkey % 33 <> 3 THEN 'plan' END AS current_plan, c_custkey % 10 <> 0 AS begun,
    c_custkey % 10 <> 0 AND c_custkey % 8 <> 1 AND c_custkey % 9 <> 2 AS translation_complete, c_custkey % 21 = 4 AS other FROM customer LEFT JOIN tot ON project = c_custkey),
x AS (SELECT ch.*, current_plan, k % 17 <> 1 OR project % 2 = 0 AS done, k % 61 <> 2 AND k % 67 <> 3 AS source_ok, current_plan IS NOT NULL AND k % 71 <> 4 AS plan_ok, k % 11 = 6 AS manual, k % 19 = 5 AS old, k % 7 <> 0 AS seen, k % 23 = 7 AS stale, k % 29 = 8 AS ask FROM ch JOIN books USING (project)),
issues AS (SELECT project, code, k AS chapter_index, chapter_id, code IN ('chapter_source_mismatch', 'chapter_plan_mismatch', 'chapter_missing_translation') AS blocking FROM (SELECT project, k, chapter_id, unnest(list_filter([
        CASE WHEN done AND NOT source_ok THEN 'chapter_source_mismatch' END, CASE WHEN done AND NOT plan_ok THEN 'chapter_plan_mismatch' END, CASE WHEN done AND manual THEN 'manual_revision_present' END, CASE WHEN done AND old THEN 'translation_quality_stale' END,
        CASE WHEN done AND seen AND stale THEN 'literary_review_stale' END, CASE WHEN done AND seen AND ask AND NOT stale THEN 'literary_review_attention' END, CASE WHEN done AND NOT seen THEN 'literary_review_missing' END, CASE WHEN NOT done THEN 'chapter_missing_translation' END], lambda v: v IS NOT NULL)) AS code FROM x)
    UNION ALL SELECT project, unnest(list_filter([CASE WHEN NOT translation_complete THEN 'translation_not_complete' END, CASE WHEN begun AND current_plan IS NULL THEN 'legacy_or_missing_plan_identity' END, CASE WHEN begun AND other THEN 'progress_source_mismatch' END], lambda v: v IS NOT NULL)), NULL, NULL, true FROM books),
flags AS (SELECT project, bool_or(blocking) AS blocked, bool_or(code IN ('literary_review_missing', 'translation_quality_stale')) AS unclear FROM issues GROUP BY project),
counts AS (SELECT project, count(*) FILTER (done) AS translated_chapters, coalesce(sum(n_paragraphs) FILTER (done AND source_ok AND plan_ok), 0)::BIGINT AS completed_source_paragraphs, count(*) FILTER (done AND seen) AS reviewed_chapters, count(*) FILTER (done AND seen AND stale) AS stale_reviews,
    count(*) FILTER (done AND seen AND ask AND NOT stale) AS attention_reviews, count(*) FILTER (done AND manual) AS manual_chapters FROM x GROUP BY project),
able AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY n_chars DESC, k DESC) AS l, row_number() OVER (PARTITION BY project ORDER BY k % 6 DESC, k) AS t FROM x WHERE done AND source_ok AND plan_ok),
why AS (SELECT project, k, unnest(list_filter([CASE WHEN done AND manual THEN 'manual_revision' END, CASE WHEN done AND old THEN 'translation_quality_stale' END, CASE WHEN done AND seen AND stale THEN 'literary_review_stale' END, CASE WHEN done AND seen AND ask AND NOT stale THEN 'literary_review_attention' END], lambda v: v IS NOT NULL)) AS reason FROM x
    UNION ALL SELECT project, k, unnest(list_filter([CASE WHEN i = 0 THEN 'early_book' END, CASE WHEN i = n // 2 THEN 'middle_book' END, CASE WHEN i = n - 1 THEN 'late_book' END, CASE WHEN l = 1 THEN 'long_chapter' END, CASE WHEN t = 1 AND k % 6 > 0 THEN 'dialogue_heavy' END], lambda v: v IS NOT NULL)) FROM able),
ranked AS (SELECT project, k, list(DISTINCT reason) AS r, max(CASE reason WHEN 'early_book' THEN 20 WHEN 'middle_book' THEN 30 WHEN 'late_book' THEN 40 WHEN 'long_chapter' THEN 50 WHEN 'dialogue_heavy' THEN 60 WHEN 'manual_revision' THEN 90 WHEN 'literary_review_stale' THEN 95 WHEN 'literary_review_attention' THEN 100 ELSE 85 END) AS priority FROM why GROUP BY project, k),
best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY project ORDER BY priority DESC, k) <= 12),
targets AS (SELECT project, k AS chapter_index, 'ch-' || k AS chapter_id, coalesce(CASE WHEN list_contains(r, 'manual_revision') THEN 'pm-' || k END, CASE WHEN k % 13 <> 0 AND list_has_any(r, ['translation_quality_stale', 'literary_review_stale', 'literary_review_attention', 'early_book', 'middle_book', 'late_book']) THEN 'p0-' || k END,
    CASE WHEN list_contains(r, 'long_chapter') THEN 'pl-' || k END, CASE WHEN list_contains(r, 'dialogue_heavy') THEN 'pd-' || k END, CASE WHEN k % 13 <> 0 THEN 'p0-' || k END) AS paragraph_id, priority,
    array_to_string(list_filter(['early_book', 'middle_book', 'late_book', 'long_chapter', 'dialogue_heavy', 'manual_revision', 'literary_review_stale', 'literary_review_attention', 'translation_quality_stale'], lambda v: list_contains(r, v)), ',') AS reasons FROM best)"""


def _reviewed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Records on the review targets: by rule current, stale, or of a target that is no more."""
    found = _audit(spark, d)
    marked = found.targets.select("project", audit.target_id(F.col("project"), F.col("chapter_id"), F.col("paragraph_id")).alias("target_id"), "chapter_index")
    targets = marked.select("project", "target_id", F.lit("s").alias("source"), (F.col("chapter_index") % 4).cast("string").alias("translation"), F.lit("c").alias("context"), F.lit("p").alias("plan"))
    k = F.col("chapter_index")
    seq = marked.filter(k % 5 != 0).withColumn("seq", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))))
    outcome = F.element_at(F.array(F.lit("clear"), F.lit("needs_revision"), F.lit("accepted_as_is")), ((k + F.col("seq")) % 3 + 1).cast("int"))
    records = seq.select("project", F.when(k % 14 == 0, "gone").otherwise(F.col("target_id")).alias("target_id"), F.lit("s").alias("source"), ((k + F.when(F.col("seq") == 1, k % 2).otherwise(0)) % 4).cast("string").alias("translation"), F.lit("c").alias("context"), F.lit("p").alias("plan"), "seq", outcome.alias("outcome"))
    return audit.review_state(targets, records, found.summary)


def pilot_review_summary(spark, d):
    return _reviewed(spark, d)[1]


STATE_SQL = AUDIT_SQL + """,
g AS (SELECT project, chapter_index AS k, 'pilot-target-' || sha256('phase29-target-v1' || chr(0) || project || chr(0) || chapter_id || chr(0) || coalesce(paragraph_id, 'chapter')) AS target_id FROM targets),
rec AS (SELECT project, k, k % 14 = 0 AS gone, seq, (k + CASE WHEN seq = 1 THEN k % 2 ELSE 0 END) % 4 = k % 4 AS current, ['clear', 'needs_revision', 'accepted_as_is'][(k + seq) % 3 + 1] AS outcome FROM (SELECT *, unnest(range(k % 3 + 1)) AS seq FROM g WHERE k % 5 <> 0)),
st AS (SELECT g.project, g.k, arg_max(outcome, seq) FILTER (current) AS outcome, count(*) FILTER (NOT current) AS stale FROM g LEFT JOIN (SELECT * FROM rec WHERE NOT gone) rec ON rec.project = g.project AND rec.k = g.k GROUP BY g.project, g.k),
s AS (SELECT project, count(*) AS targets, count(outcome) AS reviewed, count(*) FILTER (outcome IN ('clear', 'accepted_as_is')) AS resolved, count(*) FILTER (outcome = 'needs_revision') AS needs_revision, count(*) FILTER (outcome IS NULL) AS missing, sum(stale)::BIGINT AS stale_records FROM st GROUP BY project),
lost AS (SELECT project, count(*) AS orphaned FROM rec WHERE gone GROUP BY project),
ready AS (SELECT project, translation_complete AND NOT coalesce(blocked, false) AS export_ready FROM books LEFT JOIN flags USING (project))
SELECT project, coalesce(targets, 0) AS targets, coalesce(reviewed, 0) AS reviewed, coalesce(resolved, 0) AS resolved, coalesce(needs_revision, 0) AS needs_revision, coalesce(missing, 0) AS missing, coalesce(stale_records, 0) AS stale_records, coalesce(orphaned, 0) AS orphaned,
    coalesce(targets, 0) > 0 AND export_ready AND resolved = targets AS complete FROM ready LEFT JOIN s USING (project) LEFT JOIN lost USING (project)"""


def segment_fingerprints(spark, d):
    """Fingerprints of each conversation's turns."""
    turns = _read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("s"))
    return turns.select("conv_id", audit.segments_fingerprint(F.col("s")).alias("fingerprint"), F.size("s").alias("segments"))


SEGMENTS_SQL = """
SELECT conv_id, 'sha256-' || sha256(unhex(hex(encode('phase29-chapter-fingerprint-v1' || chr(0))) || string_agg(array_to_string(list_transform(range(8), lambda i: lpad(hex((strlen(text) >> (8 * i)) & 255), 2, '0')), '') || hex(encode(text)), '' ORDER BY turn))) AS fingerprint, count(*)::INT AS segments
FROM conversations GROUP BY conv_id
"""

def review_submissions(spark, d):
    """Orders as reviews and their lines as findings, refused for their first failure."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    finding = F.struct(
        n.alias("n"), F.col("l_partkey").alias("p"), F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical"), F.lit("info")), ((k + n) % 4 + 1).cast("int")).alias("severity"), F.when(n % 3 == 1, (k % 50).cast("int")).alias("source_start"), F.when(n % 3 == 1, (k % 50 + n - 1).cast("int")).alias("source_end"),
        F.when(n % 5 == 2, 0).alias("target_start"), F.when(n % 5 == 2, (k % 60).cast("int")).alias("target_end"), F.when((k + n) % 7 != 3, "n").alias("note"),
    )
    found = _read(spark, d, "lineitem").filter("l_orderkey % 3 <> 0").groupBy(k.alias("submission")).agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    o = F.col("o_orderkey")
    rows = _read(spark, d, "orders").select(
        o.alias("submission"), F.when(o % 31 == 1, " ").when(o % 37 == 2, F.repeat(F.lit("r"), 201)).otherwise("r").alias("reviewer"), F.when(o % 4 == 0, "").otherwise("note").alias("note"),
        F.element_at(F.array(F.lit("clear"), F.lit("accepted_as_is"), F.lit("needs_revision")), (F.floor(o / 3) % 3 + 1).cast("int")).alias("outcome"), F.lit(45).alias("source_chars"), F.lit(50).alias("target_chars"),
    )
    return checks.review_submission_failures(rows.join(found, "submission", "left")).select("submission", "rule", F.get("path", F.lit(0)).alias("place"))


SUBMISSIONS_SQL = """
WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, ['info', 'warning', 'critical', 'info'][(l_orderkey + l_linenumber) % 4 + 1] AS severity FROM lineitem WHERE l_orderkey % 3 <> 0),
s AS (SELECT k, count(*) AS n, bool_or(severity = 'critical') AS critical, bool_or(severity <> 'info') AS warned FROM f GROUP BY k),
o AS (SELECT o_orderkey AS k, ['clear', 'accepted_as_is', 'needs_revision'][(o_orderkey // 3) % 3 + 1] AS outcome, coalesce(n, 0) AS n, coalesce(critical, false) AS critical, coalesce(warned, false) AS warned FROM orders LEFT JOIN s ON s.k = o_orderkey),
a AS (SELECT k, -1 AS pos, CASE WHEN k % 31 = 1 OR k % 37 = 2 THEN 'reviewer' WHEN n > 16 THEN 'too_many_findings' WHEN outcome = 'clear' AND n > 0 THEN 'clear_with_findings' WHEN outcome = 'accepted_as_is' AND n = 0 AND k % 4 = 0 THEN 'accepted_without_reason'
    WHEN outcome = 'accepted_as_is' AND critical THEN 'accepted_critical' WHEN outcome = 'needs_revision' AND NOT warned THEN 'revision_without_warning' END AS rule FROM o
    UNION ALL SELECT f.k, pos, CASE WHEN f.n % 3 = 1 AND (f.n <= 1 OR f.k % 50 + f.n - 1 > 45) THEN 'source_span' WHEN f.n % 5 = 2 AND (f.k % 60 = 0 OR f.k % 60 > 50) THEN 'target_span' WHEN f.n % 3 <> 1 AND f.n % 5 <> 2 AND (f.k + f.n) % 7 = 3 THEN 'empty_finding' END FROM f)
SELECT k AS submission, rule, pos::INT AS place FROM a WHERE rule IS NOT NULL AND k IN (SELECT k FROM o) QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1
"""

QUERIES = (corpus_failures, ledger_failures, inadmissible_reviews, blind_preferences, review_records, pilot_issues, pilot_summary, pilot_review_targets, pilot_review_summary, segment_fingerprints, review_submissions)
ORACLES = {
    "corpus_failures": CORPUS_SQL, "ledger_failures": LEDGER_SQL, "inadmissible_reviews": BLIND_SQL + " SELECT c || '-' || r AS review, rule FROM v WHERE rule IS NOT NULL",
    "blind_preferences": BLIND_SQL + " SELECT k.c AS reveal, CASE decision WHEN 'candidate_a' THEN a.a WHEN 'candidate_b' THEN a.b ELSE decision END AS preferred, count(*) AS n FROM k JOIN v ON v.c = k.c AND v.r = k.r AND v.rule IS NULL JOIN a ON a.c = k.c AND a.t = k.t GROUP BY 1, 2",
    "review_records": RECORDS_SQL, "pilot_issues": AUDIT_SQL + " SELECT * FROM issues",
    "pilot_summary": AUDIT_SQL + """ SELECT project, current_plan, total_chapters, total_paragraphs, coalesce(translated_chapters, 0) AS translated_chapters, coalesce(completed_source_paragraphs, 0) AS completed_source_paragraphs, coalesce(reviewed_chapters, 0) AS reviewed_chapters,
        coalesce(stale_reviews, 0) AS stale_reviews, coalesce(attention_reviews, 0) AS attention_reviews, coalesce(manual_chapters, 0) AS manual_chapters, translation_complete, translation_complete AND NOT coalesce(blocked, false) AS export_ready,
        translation_complete AND NOT coalesce(blocked, false) AND coalesce(reviewed_chapters, 0) = total_chapters AND coalesce(stale_reviews, 0) = 0 AND coalesce(attention_reviews, 0) = 0 AND NOT coalesce(unclear, false) AS review_clear
        FROM books LEFT JOIN counts USING (project) LEFT JOIN flags USING (project)""",
    "pilot_review_targets": AUDIT_SQL + " SELECT *, 'pilot-target-' || sha256('phase29-target-v1' || chr(0) || project || chr(0) || chapter_id || chr(0) || coalesce(paragraph_id, 'chapter')) AS target_id FROM targets",
    "pilot_review_summary": STATE_SQL, "segment_fingerprints": SEGMENTS_SQL, "review_submissions": SUBMISSIONS_SQL,
}
