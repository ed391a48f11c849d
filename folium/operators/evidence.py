"""Evidence from glossary and translation memory: deterministic candidates, and their fusion with a semantic ranking that may fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.operators import matching, memory
from folium.operators.packets import evidence_id
from folium.sources.shared import stored

# Hits, entries, characters and least score of a memory context, the pool that is reranked, and the headings of a context.
MOST_HITS, MOST_TERMS, MOST_CHARS, LEAST, POOL = 5, 12, 6_000, 0.16, 512
GLOSSARY_HEAD, MEMORY_HEAD = "GLOSSARY — preserve these decisions:", "TRANSLATION MEMORY — use as style/continuity evidence, not as mandatory wording:"
CANDIDATE = ["query_id", "id", "kind", "authority", "text", "reason", "relevance"]


def quoted(text: Column) -> Column:
    """A string literal: backslashes, quotation marks, line ends and tabs escaped."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def glossary_hits(queries: DataFrame, glossary: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, position, source_term, preferred_translation, context): entries whose term a query holds, longest first.

    ``queries``: query_id, query; ``glossary``: source_term,
    preferred_translation, context. Equal entries count once.
    """
    rows = glossary.select("source_term", "preferred_translation", F.coalesce("context", F.lit("")).alias("context")).distinct()
    keyed = rows.withColumn("entry", F.struct(*rows.columns))
    hits = matching.phrase_hits(queries, keyed, "query_id", "query", "entry", "source_term").select("query_id", "entry.*")
    order = [*matching.longest_first(hits, "source_term"), F.asc("preferred_translation"), F.asc("context")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("position", place).filter(F.col("position") <= most)


def _entry_text(source: str, translation: str, context: str) -> Column:
    note = F.trim(F.coalesce(context, F.lit("")))
    return F.concat(quoted(F.col(source)), F.lit(" => "), quoted(F.col(translation)), F.when(note != "", F.concat(F.lit(" | context: "), note)).otherwise(F.lit("")))


def _glossary_candidates(queries: DataFrame, glossary: DataFrame, most: int) -> DataFrame:
    hits = glossary_hits(queries, glossary, most)
    note = F.trim("context")
    text = F.concat("source_term", F.lit(" => "), "preferred_translation", F.when(note != "", F.concat(F.lit(" ["), note, F.lit("]"))).otherwise(F.lit("")))
    key = evidence_id("glossary", F.col("source_term"), F.col("preferred_translation"), F.col("context"))
    return hits.select("query_id", key.alias("id"), F.lit("glossary").alias("kind"), F.lit("canonical").alias("authority"), text.alias("text"), F.lit("source term is present in the current translation unit").alias("reason"), F.lit(1.0).alias("relevance"))


def _with_entries(hits: DataFrame, entries: DataFrame) -> DataFrame:
    rows = entries.select("entry_id", "source", "translation", F.coalesce("context", F.lit("")).alias("context"))
    return hits.join(rows, "entry_id").withColumns({"id": evidence_id("translation-memory", F.col("source"), F.col("translation"), F.col("context")), "text": _entry_text("source", "translation", "context")})


def native_candidates(queries: DataFrame, entries: DataFrame, glossary: DataFrame, most_hits: int = MOST_HITS, most_terms: int = MOST_TERMS, least: float = LEAST) -> DataFrame:
    """(query_id, id, kind, authority, text, reason, relevance) of glossary entries and ranked memory entries; blank queries have none."""
    asked = queries.filter("trim(coalesce(query, '')) <> ''")
    ranked = memory.rank_memory(memory.score_memory(asked, entries, least=least), most=most_hits)
    hits = _with_entries(ranked, entries)
    found = hits.select("query_id", "id", F.lit("translation_memory").alias("kind"), F.lit("deterministic").alias("authority"), "text", F.lit("deterministic translation-memory retrieval matched the current unit").alias("reason"), F.col("score").alias("relevance"))
    return _glossary_candidates(asked, glossary, most_terms).unionByName(found)


def hybrid_evidence(queries: DataFrame, entries: DataFrame, glossary: DataFrame, semantic: DataFrame, failures: DataFrame, model: str, most_hits: int = MOST_HITS) -> tuple[DataFrame, DataFrame]:
    """(candidates, status): memory entries reranked by a semantic ranking (query_id, entry_id, rank) fused with the deterministic one.

    The semantic side is advisory: queries in ``failures`` (query_id, error)
    get exactly the deterministic candidates. Status has query_id, attempted,
    used, model and error for each query; blank queries, and all where the
    memory is empty, are attempted without being used.
    """
    asked = queries.filter("trim(coalesce(query, '')) <> ''")
    broken = failures.select("query_id", "error").dropDuplicates(["query_id"])
    fit = asked.join(broken, "query_id", "left_anti")
    scored = stored(memory.score_memory(fit, entries, least=0.0))  # the rankings, the scores and the status read them
    fused = memory.hybrid_candidates(scored, semantic.select("query_id", "entry_id", "rank"), pool=POOL, most=most_hits)
    native = scored.select("query_id", "entry_id", F.col("score").alias("native_score"))
    hits = _with_entries(fused.select("query_id", "entry_id", "native_rank", "semantic_rank", "relevance").join(native, ["query_id", "entry_id"]), entries)
    rank = lambda c: F.col(c).cast("string")
    score = F.format_string("%.3f", F.round("native_score", 3))
    reason = F.when(F.col("semantic_rank").isNull(), F.concat(F.lit("deterministic TM candidate retained after hybrid fusion: native_rank="), rank("native_rank"), F.lit(", native_score="), score))
    reason = reason.otherwise(F.concat(F.lit("hybrid TM retrieval: native_rank="), rank("native_rank"), F.lit(", semantic_rank="), rank("semantic_rank"), F.lit(", native_score="), score, F.lit(f", model={model}")))
    reranked = hits.select("query_id", "id", F.lit("translation_memory").alias("kind"), F.lit("deterministic").alias("authority"), "text", reason.alias("reason"), "relevance")
    rest = asked.join(broken.select("query_id"), "query_id", "left_semi")
    whole = _glossary_candidates(fit, glossary, MOST_TERMS).unionByName(reranked).unionByName(native_candidates(rest, entries, glossary, most_hits))
    pooled = scored.select("query_id", F.lit(True).alias("pooled")).distinct()
    status = queries.select("query_id").join(broken, "query_id", "left").join(pooled, "query_id", "left")
    used = F.col("error").isNull() & F.coalesce("pooled", F.lit(False))
    return whole.select(*CANDIDATE), status.select("query_id", F.lit(True).alias("attempted"), used.alias("used"), F.when(used, F.lit(model)).alias("model"), "error")


def memory_text(queries: DataFrame, entries: DataFrame, glossary: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(query_id, text, memory_hits, glossary_hits, truncated): both kinds of hits as one context of two sections, cut to ``most_chars``; queries without hits have an empty one."""
    asked = queries.filter("trim(coalesce(query, '')) <> ''")
    note = F.trim("context")
    term = F.concat(F.lit("- "), "source_term", F.lit(" => "), "preferred_translation", F.when(note != "", F.concat(F.lit(" ["), note, F.lit("]"))).otherwise(F.lit("")))
    ranked = _with_entries(memory.rank_memory(memory.score_memory(asked, entries, least=LEAST), most=MOST_HITS), entries)
    line = F.concat(F.lit("- "), "text", F.lit(" (relevance "), F.format_string("%.2f", F.round("score", 2)), F.lit(")"))
    gathered = lambda df, order, text, n: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("l")))), lambda x: x["l"]), "\n").alias(n), F.count(F.lit(1)).alias(f"{n}_hits"))
    out = queries.select("query_id").join(gathered(glossary_hits(asked, glossary), "position", term, "glossary"), "query_id", "left").join(gathered(ranked, "rank", line, "memory"), "query_id", "left")
    section = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head + "\n"), F.col(c)))
    full = F.concat_ws("\n\n", section(GLOSSARY_HEAD, "glossary"), section(MEMORY_HEAD, "memory"))
    return out.select("query_id", F.left(full, F.lit(most_chars)).alias("text"), F.coalesce("memory_hits", F.lit(0)).alias("memory_hits"), F.coalesce("glossary_hits", F.lit(0)).alias("glossary_hits"), (F.length(full) > most_chars).alias("truncated"))


def dense_pool(ranked: DataFrame, k: int) -> DataFrame:
    """The neighbours (query, neighbour, cosine, rank) that a reranker of the best ``k`` gets: four times as many, sixteen at least."""
    return ranked.filter(F.col("rank") <= max(16, 4 * k))


def reranked(pool: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(query, neighbour, rank, score): a pool by the scores (query, neighbour, score) of a reranker, at most ``k``; those without a score come last in their dense order."""
    joined = pool.join(scores, ["query", "neighbour"], "left")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "rank", "neighbour"))
    return joined.withColumn("place", place).filter(F.col("place") <= k).select("query", "neighbour", F.col("place").alias("rank"), "score")
