"""Queries over the driver's tables, one or more for each family of operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import ids, scan, text
from folium.operators import align, evaluation, ledger, matching, memory, mining, quality, review
from folium.plans import books, recall, reports, reviews, runs, seeds, sql, views
from folium.sources import text as source
from folium.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]


#: Tables of long texts, whose rows cost much more to work on than to move.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as read; long texts that come in fewer splits than there are cores (one small file) are dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df


def normalize_text(spark, d):
    t = F.col("text")
    n = text.normalize(t)
    return table(spark, d, "documents").select("doc_id", F.sha2(n, 256).alias("normalized_sha"), F.size(text.tokens(n)).alias("n_tokens"), text.has_negation(n).alias("negated"), F.sha2(text.normalize_identity(t), 256).alias("identity_sha"))


def similarity_pairs(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("a"), text.normalize("text").alias("ta"))
    b = a.select((F.col("a") - 1).alias("a"), F.col("ta").alias("tb"))
    return a.join(b, "a").select("a", F.round(text.similarity_normalized(F.col("ta"), F.col("tb")), 6).alias("similarity"))


def lines_of(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "")


def paragraph_facts(spark, d):
    facts = mining.paragraph_facts(lines_of(spark, d), "line")
    return facts.select("doc_id", "pos", "n_words", "n_sentences", F.array_join("conventions", ",").alias("conventions"), "is_dialogue")


def observed_profile(spark, d):
    return mining.observed_profile(mining.paragraph_facts(lines_of(spark, d), "line"), ["lang"])


def chapter_map(spark, d):
    return mining.observed_profile(mining.paragraph_facts(lines_of(spark, d), "line"), ["source", "doc_id"])


def chapter_samples(spark, d):
    return mining.position_samples(chapter_map(spark, d), "source", "doc_id")


def chapter_sessions(spark, d):
    """Turns of a conversation in sessions that a user turn starts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("session", F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return turns.groupBy("conv_id", "session").agg(F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("n_chars"))


def document_segments(spark, d):
    """Documents as manuscripts of blank-line blocks: one paragraph row for each run of lines."""
    return source.segment(source.blocks(table(spark, d, "documents"))).groupBy("doc_id").agg(F.max("chapter").alias("chapters"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("n_chars"))


def html_pages(spark, d):
    t = source.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(t, 256).alias("text_sha"), F.length(t).alias("n_chars"))


def recurring_phrases(spark, d):
    out = mining.recurring_phrases(table(spark, d, "documents"))
    return out.select("phrase", "n", "n_docs", "first_doc", F.array_join("evidence", ",").alias("evidence"), "confidence")


def name_mentions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.posexplode(scan.name_candidates("text")).alias("position", "name"))
    return mining.name_counts(docs, evidence=0).select("key", "display", "n", "confidence")


def cooccurrence(spark, d):
    """Names of five documents or more that stand in one line together."""
    found = F.regexp_extract_all("line", F.lit(r"([A-Z][a-z]{5,})"), 1)
    names = lines_of(spark, d).select("doc_id", (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("unit"), F.explode(found).alias("name"))
    often = names.groupBy("name").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 5").select("name")
    out = matching.co_occurrence(names.join(often, "name"), "unit", "name").filter("n >= 2")
    return out.select("a", "b", "n", F.array_join("evidence", ",").alias("evidence"))


def merged_names(spark, d):
    pairs = table(spark, d, "part").select(F.lower("p_name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return matching.merge_short_names(pairs.unionByName(words)).select("name", "n", F.array_join("aliases", ",").alias("aliases"))


def benchmark_terms(spark, d) -> DataFrame:
    """Two neighbouring words of each benchmark item as terms."""
    w = text.tokens(text.normalize("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(w, 3, 2), " ").alias("term"))


def glossary_hits(spark, d):
    return matching.phrase_hits(table(spark, d, "documents"), benchmark_terms(spark, d), "doc_id", "text", "item_id", "term")


def documents_with_terms(spark, d):
    docs = table(spark, d, "documents")
    return docs.join(glossary_hits(spark, d), "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def documents_without_terms(spark, d):
    docs = table(spark, d, "documents")
    return docs.join(glossary_hits(spark, d), "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def memory_scores(spark, d):
    """Benchmark items whose id 20 divides, against all items as a translation memory."""
    items = table(spark, d, "benchmark")
    m = items.select(F.col("item_id").alias("entry_id"), F.col("text").alias("source"), F.col("text").alias("translation"), F.lit("").alias("context"), F.array().cast("array<string>").alias("tags"))
    q = items.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return memory.score_memory(q, m)


def memory_ranked(spark, d):
    return memory.rank_memory(memory_scores(spark, d))


def memory_best(spark, d):
    s = memory_scores(spark, d)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.octet_length("source"), "entry_id"))
    return s.withColumn("rank", rank).filter("rank <= 3").select("query_id", "entry_id", "score", "rank")


def rankings(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey")
    by = lambda c: o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.row_number().over(w.orderBy(F.desc(c), "o_orderkey")).alias("rank")).filter("rank <= 5")
    return by("o_totalprice"), by("o_orderdate")


def fused_ranking(spark, d):
    return memory.reciprocal_rank_fusion(*rankings(spark, d), ["query_id", "item_id"])


def ranking_metrics(spark, d):
    truth = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("gain"))
    return memory.ranking_metrics(rankings(spark, d)[0], truth, 3)


def knn_cosine(spark, d):
    v = table(spark, d, "embeddings")
    return memory.nearest_vectors(v.filter("vec_id % 20 = 0"), v, 5)


def context_packets(spark, d):
    """Turns of each conversation as ranked evidence within a budget."""
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("unit_id"), F.concat(F.lit("t"), F.col("turn")).alias("id"), F.when(F.col("role") == "user", "reference").otherwise("scene_summary").alias("kind"), F.when(F.col("turn") % 3 == 0, "canonical").otherwise("deterministic").alias("authority"), "text", F.lit("turn").alias("reason"), (1.0 / (F.col("turn") + 1)).alias("relevance"))
    return memory.pack_context(rows, most_chars=1_000, most_items=4, item_chars=300)


def neighbor_context(spark, d):
    return memory.neighbour_context(table(spark, d, "conversations"), "conv_id", "turn", "text", 90)


def paragraph_groups(spark, d):
    return memory.group_paragraphs(table(spark, d, "conversations"), "conv_id", "turn", "text", 600).withColumn("group", F.col("group").cast("bigint"))


def answer_pairs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source")).join(a, ["conv_id", "turn"])


def answer_terms(pairs: DataFrame) -> DataFrame:
    """Two words of every third question as a term, and two words of its answer as the wording for it."""
    two = lambda c: F.array_join(F.slice(text.tokens(text.normalize(c)), 2, 2), " ")
    rows = pairs.filter("conv_id % 3 = 0").select(two("source").alias("source_term"), two("output").alias("preferred_translation"))
    return rows.filter("source_term <> ''").groupBy("source_term").agg(F.min("preferred_translation").alias("preferred_translation"))


def quality_gate(spark, d):
    pairs = stored(answer_pairs(spark, d).withColumn("unit_id", F.concat_ws(":", "conv_id", "turn")))  # the terms and the gate read them
    out = quality.gate(pairs, terms=answer_terms(pairs))
    return out.select("conv_id", "turn", F.array_join("blocking", ",").alias("blocking"), F.array_join("warnings", ",").alias("warnings"), "score", "passes")


def native_review(spark, d):
    rows = answer_pairs(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("unit_id"), "source", F.col("output").alias("target"))
    return quality.review(rows)


def consistency_audit(spark, d):
    out = quality.audit_consistency(table(spark, d, "part"), "p_brand", "p_type", "p_partkey", 5)
    return out.select("key", F.array_join("variants", ",").alias("variants"), "n", F.array_join("locations", ",").alias("locations"), "stable")


def consistency_score(spark, d):
    return quality.consistency_score(quality.audit_consistency(table(spark, d, "customer"), "c_name", "c_mktsegment", "c_custkey"))


def glossary_conflicts(spark, d):
    out = quality.term_conflicts(table(spark, d, "part"), "p_name", "p_type")
    return out.select("term", "translation", F.array_join("alternatives", ",").alias("alternatives"))


def memory_conflicts(spark, d):
    return quality.memory_conflicts(table(spark, d, "part"), "p_partkey", "p_name", "p_brand")


def claim_disagreement(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("claim"), ids.confidence(F.col("doc_id") % 7).alias("confidence"))
    return quality.disagreement(rows, ["source"]).select("doc_id", "source", "confidence", "contradicting")


def anchors_of(spark, d) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "benchmark")
    words = text.tokens(text.normalize("text"))
    anchors = items.select(F.col("item_id").alias("case_id"), F.explode(F.array(
        F.struct(F.lit("a1").alias("anchor_id"), F.lit("terms").alias("dimension"), F.lit("all_present").alias("mode"), F.slice(words, 1, 2).alias("values")),
        F.struct(F.lit("a2").alias("anchor_id"), F.lit("voice").alias("dimension"), F.lit("any_present").alias("mode"), F.array(F.lit("zzz"), F.element_at(words, 5)).alias("values")),
        F.struct(F.lit("a3").alias("anchor_id"), F.lit("voice").alias("dimension"), F.lit("all_absent").alias("mode"), F.array(F.element_at(words, -1)).alias("values")),
    )).alias("a")).select("case_id", "a.*")
    outputs = items.filter("item_id % 7 <> 0").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("o"))).otherwise(F.col("text")).alias("text"))
    return outputs, anchors


def anchor_report(spark, d):
    return evaluation.anchor_report(evaluation.anchor_results(*anchors_of(spark, d)))


def submission_problems(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"))
    actual = items.filter("case_id % 5 <> 0").unionByName(items.filter("case_id % 11 = 3")).unionByName(items.filter("case_id < 4").select((F.col("case_id") + 100_000).alias("case_id")))
    return matching.missing_and_unknown(items, actual, "case_id")


def preference_dossier(spark, d):
    return evaluation.preference_dossier(reviews_of(spark, d))


def system_preferences(spark, d):
    return evaluation.system_preferences(reviews_of(spark, d))


def reviews_of(spark, d) -> DataFrame:
    kinds = F.create_map(F.lit("click"), F.lit("system-a"), F.lit("view"), F.lit("system-b"), F.lit("error"), F.lit("defer"))
    return table(spark, d, "events").select((F.col("event_id") % 500).alias("case_id"), F.col("user_id").alias("reviewer_id"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("tie")).alias("preferred"))


def telemetry(spark, d):
    e = table(spark, d, "events").select("event_type", F.length("props").alias("input_tokens"), (F.col("user_id") % 100).alias("output_tokens"), F.col("event_id").alias("latency_ms"))
    return evaluation.telemetry(e, ["event_type"]).withColumn("latency_ms", F.col("latency_ms").cast("bigint"))


def ledger_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as a ledger, some of it obsolete, and as proposals, some of them canonical."""
    o = table(spark, d, "orders")
    availability = F.when(F.col("o_orderkey") % 7 == 0, "obsolete").otherwise("active")
    status = F.when(F.col("o_orderkey") % 2 == 0, "approved").otherwise("rejected")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("subject_key"), F.col("o_orderstatus").alias("fp"), F.lit(1).alias("revision"), status.alias("status"), availability.alias("availability"))
    new = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("subject_key"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("fp"), (F.col("o_orderkey") % 11 == 0).alias("already_canonical"))
    return old, new


def ledger_reconcile(spark, d):
    return ledger.reconcile(*ledger_parts(spark, d), ["kind", "subject_key"], "fp", ["1-URGENT", "5-LOW"])


def obsolete_sweep(spark, d):
    old, new = ledger_parts(spark, d)
    return old.join(new, ["kind", "subject_key"], "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def latest_revision(spark, d):
    return ledger.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def history_retention(spark, d):
    return ledger.keep_newest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], 5)


ACTIONS = ("approve", "edit", "reject", "defer", "reopen", "apply")


def decision_replay(spark, d):
    """Events as decisions on items, some of them without a replacement, a reviewer or a current proposal."""
    n = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.pmod(F.floor(n / 7), F.lit(6)) + 1).cast("int"))
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("item_id"), n.alias("seq"), action.alias("action"), F.when(n % 13 == 0, " ").otherwise("r").alias("reviewer"), F.lit("x").alias("reason"),
        F.when(n % 4 != 0, "value").alias("replacement"), (n % 17 == 0).alias("obsolete"),
    )
    return ledger.replay(rows)


def review_queue(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("toxic") == 1).alias("conflicted"), F.col("quality").alias("confidence"), F.lit("note").alias("kind"), F.col("doc_id").alias("position"))
    return rows.orderBy(*ledger.review_queue(rows)).limit(50).select("item_id", "conflicted", "confidence")


def pilot_targets(spark, d):
    docs, marks = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(marks, "doc_id").select(F.col("doc_id").alias("chapter"), F.when(F.col("toxic") == 1, "risk").when(F.col("quality") == 0, "weak").otherwise("routine").alias("reason"), F.when(F.col("toxic") == 1, 100).when(F.col("quality") == 0, 60).otherwise(20).alias("priority"))
    return evaluation.pilot_targets(rows)


def promotion_plan(spark, d):
    o = table(spark, d, "orders")
    items = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("subject_key"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"), F.col("o_orderpriority").alias("value"))
    canon = o.filter("o_orderkey % 3 = 1").groupBy(F.col("o_custkey").alias("subject_key")).agg(F.min("o_orderpriority").alias("value"))
    return ledger.promotion_plan(items, canon)


def canon_upsert(spark, d):
    p = table(spark, d, "part")
    pick = lambda m, f: p.filter(f"p_partkey % 4 <> {m}").groupBy(F.col("p_name").alias("term")).agg(f("p_brand").alias("value"))
    return ledger.upsert(pick(1, F.min), pick(2, F.max), "term", "value")


def chapter_work_list(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ids.sha256(F.col("text")).alias("source_fp"))
    done = docs.filter("doc_id % 2 = 0").withColumn("source_fp", F.when(F.col("doc_id") % 10 == 0, F.lit("stale")).otherwise(F.col("source_fp")))
    return ledger.resumable(docs, done, ["doc_id", "source_fp"])[1]


def rule_violations(spark, d):
    rules = {"text_present": F.trim("text") != "", "count_matches": F.length("text") == F.col("n_chars"), "long_enough": F.col("n_chars") >= 20}
    return ledger.violations(table(spark, d, "documents"), "doc_id", rules)


def status_summary(spark, d):
    return ledger.status_summary(table(spark, d, "orders"), "o_orderpriority", ["F", "O", "P"], "o_orderstatus")


def evidence_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.sha256(F.col("doc_id"), F.col("lang"), F.col("text")).alias("evidence_id"))


def fnv_fingerprint(spark, d):
    return table(spark, d, "benchmark").select("item_id", ids.fnv1a64(F.col("text")).alias("fnv"))


def chunk_passage(spark, d):
    """Chunks of every document; their concatenation is the text."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(scan.passages(F.col("text"), 2_000)).alias("chunk", "passage"))


def quoted_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(scan.quotes("text")).alias("q")).select("doc_id", "q.*")


def document_freshness(spark, d):
    """Documents against stored fingerprints, of which every tenth is out of date and odd ones are absent."""
    docs = table(spark, d, "documents").select("doc_id", ids.sha256(F.col("text")).alias("fp"))
    kept = docs.filter("doc_id % 2 = 0").withColumn("fp", F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(F.col("fp")))
    return review.freshness(docs, kept, "doc_id", "fp")


def export_readiness(spark, d):
    """Orders of a customer as the chapters of a book; finished orders are done."""
    o = table(spark, d, "orders")
    return review.export_readiness(o, o.filter("o_orderstatus = 'F'"), "o_custkey", "o_orderkey", "o_orderpriority")


def finding_counts(spark, d):
    return review.finding_counts(table(spark, d, "events"), "event_type", "event_id")


def context_lines(spark, d):
    return review.context_lines(table(spark, d, "conversations"), "conv_id", "turn", F.col("text"), 3, 40)


PRESENT = ("Metal", "steel", "BLUE", "", "green", "red")


def present_entries(spark, d):
    found = review.present_entries(F.col("p_name"), F.array(*map(F.lit, PRESENT)), 2)
    return table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("entries"))


def relationship_refs(spark, d):
    """Suppliers as relationships between their nation and the nation of the same position reversed."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), (24 - F.col("s_nationkey")).alias("b"), F.col("s_suppkey").alias("ref"))
    return review.relationship_refs(s).select("name", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


QUERIES: tuple[Query, ...] = (
    normalize_text, similarity_pairs, paragraph_facts, observed_profile, chapter_map, chapter_samples, chapter_sessions,
    document_segments, html_pages, recurring_phrases, name_mentions, cooccurrence, merged_names, glossary_hits, documents_with_terms, documents_without_terms,
    memory_scores, memory_best, memory_ranked, fused_ranking, ranking_metrics, knn_cosine, context_packets, neighbor_context, paragraph_groups, quality_gate,
    native_review, consistency_audit, consistency_score, glossary_conflicts, memory_conflicts, claim_disagreement, anchor_report, submission_problems,
    preference_dossier, system_preferences, telemetry, ledger_reconcile, obsolete_sweep, latest_revision, history_retention, decision_replay, review_queue,
    pilot_targets, promotion_plan, canon_upsert, chapter_work_list, rule_violations, status_summary, evidence_fingerprint, fnv_fingerprint, chunk_passage,
    quoted_spans,
    document_freshness, export_readiness, finding_counts, context_lines, present_entries, relationship_refs,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*QUERIES, *seeds.QUERIES, *reviews.QUERIES, *runs.QUERIES, *reports.QUERIES, *books.QUERIES, *views.QUERIES, *recall.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES | seeds.ORACLES | reviews.ORACLES | runs.ORACLES | reports.ORACLES | books.ORACLES | views.ORACLES | recall.ORACLES
