"""Retrieval from translation memory, rank fusion, ranking metrics, vector ranking and context packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import normalize, sanitize_score, similarity_normalized, tokens, truncate
from folium.operators.vectors import nearest_vectors as nearest_vectors

#: Queries, and bytes of their texts, that are broadcast at a time to be compared with every memory entry.
BLOCK_ROWS, BLOCK_BYTES = 10_000, 8 << 20
# Marks that end a segment of a passage.
SEGMENT_END = "[.!?…;:\\n\\r]"
FUSION_OFFSET = 60
# Priorities of context authorities and kinds.
AUTHORITY = {"advisory": 1, "inferred": 2, "deterministic": 3, "canonical": 4, "human_approved": 5}
KIND = {
    "glossary": 100, "translation_decision": 95, "character": 90, "relationship": 85, "local_continuity": 80, "scene_summary": 75, "chapter_summary": 70, "arc_summary": 60, "book_summary": 50, "translation_memory": 45,
    "reference": 35, "advisory": 20,
}


def passage_similarity(passage: Column, segments: Column, candidate: Column) -> Column:
    """Best similarity of a normalised candidate with a normalised passage, one of its (normalised) segments, or one of its windows.

    Windows have twice as many words as the candidate, 4 to 24.
    """
    words, size = tokens(passage), F.least(F.greatest(F.size(tokens(candidate)) * 2, F.lit(4)), F.lit(24))
    spare = F.size(words) - size
    windows = F.transform(F.sequence(F.lit(1), F.greatest(spare, F.lit(0)) + 1), lambda i: similarity_normalized(F.array_join(F.slice(words, i, size), " "), candidate))
    part = F.array_max(F.transform(segments, lambda x: similarity_normalized(x, candidate)))
    whole = F.greatest(similarity_normalized(passage, candidate), part)
    return F.when(spare > 0, F.greatest(whole, F.array_max(windows))).otherwise(whole)


def score_memory(queries: DataFrame, memory: DataFrame, query_id: str = "query_id", query: str = "query", least: float = 0.12) -> DataFrame:
    """(query_id, entry_id, source, translation, score) of entries (entry_id, source, translation, context, tags) that score ``least`` or more.

    Source similarity, plus 0.30 of the context's, 0.15 of the best tag's and
    0.30 for an equal source, at most 1. The stated queries are compared with
    every entry, in blocks that are broadcast: the memory is never shuffled.
    """
    q = queries.select(F.col(query_id).alias("query_id"), normalize(F.col(query)).alias("q"), F.array_distinct(F.transform(F.split(query, SEGMENT_END), normalize)).alias("parts")).filter("q <> ''")
    m = memory.select("entry_id", "source", "translation", normalize(F.col("source")).alias("s"), normalize(F.coalesce("context", F.lit(""))).alias("c"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), normalize).alias("tg"))
    rows, size = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("q")), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    block = lambda i: q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)) == i)
    pairs = reduce(lambda a, b: a.unionByName(b), [m.join(F.broadcast(block(i)), F.lit(True)) for i in range(blocks)])
    tag = F.coalesce(F.array_max(F.transform("tg", lambda t: similarity_normalized(F.col("q"), t))), F.lit(0.0))
    total = passage_similarity(F.col("q"), F.col("parts"), F.col("s")) + 0.30 * passage_similarity(F.col("q"), F.col("parts"), F.col("c")) + 0.15 * tag + F.when(F.col("q") == F.col("s"), 0.30).otherwise(0.0)
    scored = pairs.select("query_id", "entry_id", "source", "translation", F.round(F.least(F.lit(1.0), total), 6).alias("score"))
    return scored.filter(F.col("score") >= least)


def rank_memory(scored: DataFrame, most: int = 6, diversity: float = 0.82) -> DataFrame:
    """(query_id, rank, entry_id, score): the best entries of each query, without repeated translations or near-equal sources.

    Entries stand by score, then shorter source, then id; in that order one is
    kept unless its translation or a source at least ``diversity`` similar was
    kept (1.0: no source test). Of entries with equal source and translation
    only the first can be kept, so copies are collapsed first. The i-th kept
    one then drops what repeats it, for i below ``most``: windows over one
    sorted exchange, which spill, and no list of a query's entries.
    """
    item = F.struct((-F.col("score")).alias("down"), F.octet_length("source").alias("length"), "entry_id", "score", "s", "t")
    whole = scored.withColumn("s", normalize(F.col("source"))).withColumn("t", normalize(F.col("translation")))
    # blank translations never repeat one another, so those entries stay apart
    apart = F.when(F.coalesce(F.col("t"), F.lit("")) == "", F.col("entry_id"))
    left = whole.groupBy("query_id", "s", "t", apart.alias("apart")).agg(F.min(item).alias("x")).select("query_id", "x")
    w = Window.partitionBy("query_id").orderBy("x")
    for i in range(1, most):
        # rows up to the i-th kept one are kept themselves and see no i-th value before them
        left = left.withColumns({"r": F.row_number().over(w), "y": F.nth_value("x", i).over(w)})
        repeats = (F.col("x.t") != "") & (F.col("y.t") == F.col("x.t"))
        if diversity < 1:
            repeats = repeats | (similarity_normalized(F.col("x.s"), F.col("y.s")) >= diversity)
        left = left.filter((F.col("r") <= i) | ~F.coalesce(repeats, F.lit(False))).select("query_id", "x")
    return left.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "x.entry_id", "x.score")


def hybrid_candidates(scored: DataFrame, semantic: DataFrame, pool: int = 512, most: int = 6) -> DataFrame:
    """(query_id, rank, entry_id, native_rank, semantic_rank, score, relevance, reason): a deterministic and a semantic ranking fused.

    ``scored`` is the output of ``score_memory``, whose best ``pool`` entries a
    query are ranked (score, shorter source, id); ``semantic`` has (query_id,
    entry_id, rank). Semantic ids outside the pool don't count. relevance is
    the fused score as a share of the query's best.
    """
    native = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.octet_length("source"), "entry_id"))
    first = scored.select("query_id", "entry_id", native.alias("rank")).filter(F.col("rank") <= pool)
    second = semantic.select("query_id", "entry_id", "rank").join(first.select("query_id", "entry_id"), ["query_id", "entry_id"], "left_semi")
    fused = reciprocal_rank_fusion(first, second, ["query_id", "entry_id"])
    relevance = F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6)
    reason = F.when(F.col("semantic_rank").isNull(), F.concat(F.lit("native_rank="), "native_rank")).otherwise(F.concat(F.lit("native_rank="), "native_rank", F.lit(", semantic_rank="), "semantic_rank"))
    out = fused.withColumns({"relevance": relevance, "native_rank": F.col("first_rank"), "semantic_rank": F.col("second_rank")}).filter(F.col("fused_rank") <= most)
    return out.select("query_id", F.col("fused_rank").alias("rank"), "entry_id", "native_rank", "semantic_rank", "score", "relevance", reason.alias("reason"))


def memory_context(hits: DataFrame, memory: DataFrame) -> DataFrame:
    """(query_id, context): the ranked entries (query_id, rank, entry_id) of each query as lines ``source => translation``, with their context where there is one."""
    line = F.concat("source", F.lit(" => "), "translation", F.when(F.trim(F.coalesce("context", F.lit(""))) != "", F.concat(F.lit(" | context: "), F.trim("context"))).otherwise(F.lit("")))
    lines = hits.join(memory.select("entry_id", line.alias("line")), "entry_id")
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, keys: list[str], weights: tuple[float, float] = (1.0, 1.0), offset: int = FUSION_OFFSET) -> DataFrame:
    """``keys``, first_rank, second_rank, score, fused_rank of two rankings with a column ``rank``; a repeated id keeps its best rank.

    score is the sum of weight / (offset + rank). Equal scores go by first rank, second rank and id (nulls last).
    """
    best = lambda df, name: df.groupBy(*keys).agg(F.min("rank").alias(name))
    joined = best(first, "first_rank").join(best(second, "second_rank"), keys, "full")
    part = lambda name, w: F.coalesce(F.lit(float(w)) / (F.lit(float(offset)) + F.col(name)), F.lit(0.0))
    fused = joined.withColumn("score", F.round(part("first_rank", weights[0]) + part("second_rank", weights[1]), 9))
    order = Window.partitionBy(*keys[:-1]) if keys[:-1] else Window.partitionBy(F.lit(0))
    return fused.withColumn("fused_rank", F.row_number().over(order.orderBy(F.desc("score"), F.asc_nulls_last("first_rank"), F.asc_nulls_last("second_rank"), keys[-1])))


def ranking_metrics(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank, ndcg) at ``k`` for each query of ``truth``.

    ``ranking``: (query_id, item_id, rank); ``truth``: (query_id, item_id, gain),
    relevant if the gain is above 0. Recall counts distinct hits; precision and
    gain count every row. Queries without relevant items get 0.
    """
    top = ranking.filter(F.col("rank") <= k).join(truth, ["query_id", "item_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    hit = F.when(F.col("gain") > 0, F.col("item_id"))
    gained = lambda gain, rank: (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1)
    found = top.groupBy("query_id").agg(F.count(hit).alias("hits"), F.count_distinct(hit).alias("distinct_hits"), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"), F.sum(gained(F.col("gain"), F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item_id"))
    ideal = truth.withColumn("place", place).groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, gained(F.col("gain"), F.col("place"))).otherwise(0.0)).alias("best"), F.count_if(F.col("gain") > 0).alias("relevant"))
    share = lambda a, b: F.coalesce(F.round(F.try_divide(a.cast("double"), b), 6), F.lit(0.0))
    joined = ideal.join(found, "query_id", "left").fillna(0, ["hits", "distinct_hits", "dcg"])
    return joined.select("query_id", share(F.col("hits"), F.lit(k)).alias("precision"), share(F.col("distinct_hits"), F.col("relevant")).alias("recall"), share(F.lit(1), F.col("first")).alias("reciprocal_rank"), share(F.col("dcg"), F.col("best")).alias("ndcg"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; 0 where one has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def pack_context(candidates: DataFrame, unit: str = "unit_id", most_chars: int = 8_000, most_items: int = 28, item_chars: int = 1_800, least: float = 0.0) -> DataFrame:
    """(unit_id, position, id, kind, text, truncated): ranked evidence of each unit within a budget of characters and items.

    ``candidates``: unit, id, kind, authority, text, reason, relevance. Order:
    authority, kind, relevance, id; an id counts once; blank ids or texts and
    relevance below ``least`` don't. An item that the rest of the budget has no
    room for is skipped and later ones may still fit. A unit's candidates are
    a bounded list by contract, so the fold runs on one array.
    """
    level = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), c), F.lit(0))
    rel = sanitize_score(F.col("relevance"))
    usable = candidates.filter((F.trim("id") != "") & (F.trim("text") != "") & (rel >= least))
    order = F.row_number().over(Window.partitionBy(unit).orderBy(level(AUTHORITY, F.col("authority")).desc(), level(KIND, F.col("kind")).desc(), rel.desc(), "id"))
    once = F.row_number().over(Window.partitionBy(unit, "id").orderBy("o"))
    short = truncate(F.trim("text"), item_chars, " …")
    label = lambda c: F.replace(F.col(c), F.lit("_"), F.lit("-"))
    header = F.concat(F.lit("["), label("kind"), F.lit(" | "), label("authority"), F.lit(" | id="), "id", F.lit(" | relevance="), F.format_string("%.3f", rel), F.lit("]\nReason: "), F.trim("reason"), F.lit("\n"))
    items = usable.withColumn("o", order).withColumn("u", once).filter("u = 1").select(unit, F.struct("o", "id", "kind", short.alias("text"), F.length(header).alias("head"), (F.length(F.trim("text")) > item_chars).alias("cut")).alias("x"))
    lists = items.groupBy(unit).agg(F.array_sort(F.collect_list("x")).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.filter("items", lambda x: F.lit(False)).alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        fixed = x["head"] + F.when(F.size(acc["kept"]) > 0, 2).otherwise(0)
        room = most_chars - acc["used"] - fixed
        fits = (F.size(acc["kept"]) < most_items) & (room > 0)
        text = F.left(x["text"], F.greatest(room, F.lit(0)))
        new = F.struct(x["o"].alias("o"), x["id"].alias("id"), x["kind"].alias("kind"), text.alias("text"), x["head"].alias("head"), (x["cut"] | (F.length(x["text"]) > room)).alias("cut"))
        return F.when(fits & (F.trim(text) != ""), F.struct((acc["used"] + fixed + F.length(text)).alias("used"), F.concat(acc["kept"], F.array(new)).alias("kept"))).otherwise(acc)

    kept = lists.select(unit, F.posexplode(F.aggregate("items", start, add)["kept"]).alias("i", "x"))
    return kept.select(unit, (F.col("i") + 1).alias("position"), "x.id", "x.kind", "x.text", F.col("x.cut").alias("truncated"))


def neighbour_context(rows: DataFrame, unit: str, position: str, text: str, chars: int = 900) -> DataFrame:
    """``unit``, ``position``, previous_tail and next_head: the end of the row before and the start of the row after."""
    w = Window.partitionBy(unit).orderBy(position)
    return rows.select(unit, position, F.right(F.lag(text).over(w), F.lit(chars)).alias("previous_tail"), F.left(F.lead(text).over(w), F.lit(chars)).alias("next_head"))


def group_paragraphs(paragraphs: DataFrame, unit: str, position: str, text: str, most_chars: int = 10_000) -> DataFrame:
    """(unit, position, group): consecutive paragraphs filled greedily into groups of at most ``most_chars``; none is split."""
    rows = paragraphs.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.length(text).alias("n")))).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("g"), F.array().cast("array<struct<p:bigint,g:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        fresh = (acc["used"] > 0) & (acc["used"] + 2 + x["n"] > most_chars)
        used = F.when(fresh | (acc["used"] == 0), x["n"]).otherwise(acc["used"] + 2 + x["n"])
        g = acc["g"] + F.when(fresh | (F.size(acc["out"]) == 0), 1).otherwise(0)
        return F.struct(used.alias("used"), g.alias("g"), F.concat(acc["out"], F.array(F.struct(x["p"].cast("bigint").alias("p"), g.alias("g")))).alias("out"))

    return rows.select(unit, F.explode(F.aggregate("items", start, add)["out"]).alias("x")).select(unit, F.col("x.p").alias(position), F.col("x.g").alias("group"))
