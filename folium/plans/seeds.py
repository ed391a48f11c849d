"""Queries of name indexes, seeds, validators, hybrid retrieval and positional joins, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import ids, text
from folium.operators import evaluation, ledger, matching, memory, mining, quality
from folium.plans import sql


def _read(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _profiles(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two neighbouring words of an item are a name, two further ones an alias of it."""
    w = text.tokens(text.normalize("text"))
    rows = _read(spark, d, "benchmark").select(F.array_join(F.slice(w, 3, 2), " ").alias("name"), F.array_join(F.slice(w, 7, 2), " ").alias("alias"))
    return rows.select("name").filter("name <> ''").distinct(), rows.filter("name <> '' AND alias <> ''").select(F.col("name").alias("canonical_name"), "alias").distinct()


def profile_mentions(spark, d):
    return matching.known_profiles(_read(spark, d, "documents"), *_profiles(spark, d))


def alias_index(spark, d):
    return matching.alias_index(*_profiles(spark, d))


def alias_additions(spark, d):
    """Parts propose their name and type as an alias of their brand; some propose nothing, a brand or their own brand."""
    p, n = _read(spark, d, "part"), F.col("p_partkey")
    named = F.concat_ws(" ", "p_name", "p_type")
    proposed = p.select(n.alias("position"), F.when(n % 19 == 0, " ").otherwise(F.col("p_brand")).alias("canonical_name"), F.when(n % 23 == 0, "--").when(n % 13 == 0, F.upper("p_brand")).when(n % 17 == 0, "brand#3").otherwise(named).alias("alias"))
    known = p.filter(n % 50 == 0).select(F.col("p_brand").alias("canonical_name"), named.alias("alias"))
    return matching.add_aliases(proposed, p.select(F.col("p_brand").alias("name")).distinct(), known)


def relationship_upserts(spark, d):
    """Parts propose their type as the relationship of two brands, whose order is free, with and without replacement."""
    p = _read(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("position"), ledger.pair_key(F.col("p_brand"), F.concat(F.lit("brand#"), F.col("p_partkey") % 26)).alias("pair"), F.col("p_type").alias("kind"))
    canon = rows.filter("position % 4 = 0 AND pair IS NOT NULL").groupBy("pair").agg(F.min_by("kind", "position").alias("kind"))
    done = lambda replace: ledger.upserts_in_order(rows.filter("position % 4 <> 0"), canon, "pair", "kind", replace=replace).withColumn("replacing", F.lit(replace))
    return done(True).unionByName(done(False))


def relationships_present(spark, d):
    """Names of items that follow one another are related."""
    names = _read(spark, d, "benchmark").select("item_id", F.array_join(F.slice(text.tokens(text.normalize("text")), 3, 2), " ").alias("name"))
    related = names.withColumnRenamed("name", "a").join(names.select((F.col("item_id") - 1).alias("item_id"), F.col("name").alias("b")), "item_id").filter("a <> b").select("a", "b").distinct()
    return matching.relationships_present(profile_mentions(spark, d), related).select("doc_id", "a", "b")


def unknown_names(spark, d):
    """Part names that none of the first parts has."""
    p = _read(spark, d, "part")
    known = p.filter("p_partkey < 40").select(F.col("p_name").alias("name")).distinct()
    index = matching.alias_index(known, known.select(F.col("name").alias("canonical_name"), F.concat(F.lit("the "), "name").alias("alias")))
    return matching.unknown_names(p.select("p_partkey", F.col("p_name").alias("name")), index)


def terminology_seeds(spark, d):
    """Brands as names, types as terms, part names as phrases; types are in the glossary with a wording."""
    p = _read(spark, d, "part")
    counted = lambda c: p.groupBy(F.col(c).alias("expression")).agg(F.count(F.lit(1)).alias("n"))
    glossary = p.groupBy(F.upper("p_type").alias("source_term")).agg(F.min("p_brand").alias("preferred_translation"))
    return mining.terminology(counted("p_brand"), counted("p_type"), counted("p_name"), glossary)


def aligned_turns(spark, d):
    """Questions and answers of a conversation side by side."""
    c = _read(spark, d, "conversations")
    side = lambda role: c.filter(F.col("role") == role)
    return matching.align_positions(side("user"), side("assistant"), "conv_id", "turn", "text")


def canonical_links(spark, d):
    """Customers of one nation and segment as clusters of mentions; a few segments are names of people."""
    c = _read(spark, d, "customer").select(F.pmod("c_custkey", F.lit(97)).alias("cluster"), F.col("c_custkey").alias("mention"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise(F.lit("she")).alias("text"))
    index = spark.createDataFrame([("automobile", "Otto"), ("building", "Bill"), ("machinery", "Otto")], "key string, name string")
    return matching.canonical_links(c, index)


def lacking_terms(spark, d):
    """Items whose text holds the term of an item but not its preferred wording."""
    b = _read(spark, d, "benchmark")
    w = text.tokens(text.normalize("text"))
    terms = b.select(F.array_join(F.slice(w, 3, 2), " ").alias("source_term"), F.array_join(F.slice(w, 5, 1), " ").alias("preferred_translation")).filter("source_term <> ''").groupBy("source_term").agg(F.min("preferred_translation").alias("preferred_translation"))
    return quality.missing_terms(b.select(F.col("item_id").alias("unit_id"), F.col("text").alias("source"), F.reverse("text").alias("output")), terms)


CATEGORIES = ("click", "view", "error")


def validated_findings(spark, d):
    """Events as findings about their user; the first turns of the conversation of that number are supplied as evidence."""
    e, c = _read(spark, d, "events"), _read(spark, d, "conversations")
    para = lambda n: F.concat(F.lit("para-"), n.cast("string"))
    found = e.select("event_id", F.col("user_id").alias("unit_id"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 19 == 0, " ").otherwise("claim").alias("claim"), (F.pmod("event_id", F.lit(12)) / 10.0).alias("confidence"), F.array(para(F.pmod("event_id", F.lit(3))), para(F.pmod("event_id", F.lit(5)))).alias("evidence"))
    supplied = c.select(F.col("conv_id").alias("unit_id"), para(F.col("turn")).alias("ordinal"))
    return quality.validate_findings(found, supplied, list(CATEGORIES)).select("event_id", "reason", "n_cited", "level")


def analysis_spans(spark, d):
    """Runs of up to three neighbouring lines of the items."""
    b = _read(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    return b.select("item_id", F.explode(quality.span_specs(F.col("w"), 3)).alias("s")).select("item_id", "s.start", "s.len", "s.text")


def contrastive_failures(spark, d):
    """Items with a letter changed as degraded variants of themselves."""
    b = _read(spark, d, "benchmark")
    w = text.tokens(text.normalize("text"))
    anchors = b.select(F.col("item_id").alias("case_id"), F.explode(F.array(
        F.struct(F.lit("a1").alias("anchor_id"), F.lit("terms").alias("dimension"), F.lit("all_present").alias("mode"), F.slice(w, 1, 2).alias("values")),
        F.struct(F.lit("a2").alias("anchor_id"), F.lit("terms").alias("dimension"), F.lit("any_present").alias("mode"), F.slice(w, 4, 2).alias("values")),
    )).alias("a")).select("case_id", "a.*")
    variants = b.select(F.col("item_id").alias("case_id"), F.explode(F.array(*[F.struct(F.lit(v).alias("variant_id"), F.replace("text", F.lit(v), F.lit("#")).alias("text")) for v in "aet"])).alias("v")).select("case_id", "v.*", F.lit("terms").alias("dimension"))
    return evaluation.contrastive_failures(variants, anchors)


def blind_pairs(spark, d):
    """Items, plain and with a mark before them, as the outputs of two systems."""
    b = _read(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    out = evaluation.blind_pairs(b.select("case_id"), b, b.withColumn("text", F.concat(F.lit("> "), "text")))
    return out.select("case_id", F.sha2("a", 256).alias("a_sha"), F.sha2("b", 256).alias("b_sha"), "a_is_first")


def hybrid_retrieval(spark, d):
    """The translation-memory ranking of benchmark items fused with the vector ranking of the same ids."""
    return memory.hybrid_candidates(_scored(spark, d), _semantic(spark, d)).drop("reason")


def memory_contexts(spark, d):
    hits = memory.hybrid_candidates(_scored(spark, d), _semantic(spark, d))
    return memory.memory_context(hits, _memory(spark, d)).select("query_id", F.sha2("context", 256).alias("context_sha"), F.length("context").alias("n_chars"))


def _memory(spark, d) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("text").alias("source"), F.col("text").alias("translation"), F.lit("").alias("context"), F.array().cast("array<string>").alias("tags"))


def _scored(spark, d) -> DataFrame:
    q = _read(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return memory.score_memory(q, _memory(spark, d), least=0.0)


def _semantic(spark, d) -> DataFrame:
    v = _read(spark, d, "embeddings")
    near = memory.nearest_vectors(v.filter("vec_id % 20 = 0"), v, 40)
    return near.select(F.col("query").alias("query_id"), F.col("neighbour").alias("entry_id"), "rank")


def identifiers(spark, d):
    """Ordinals, file stems, labels and secrets, digests told apart, and confidence of evidence counts."""
    p = _read(spark, d, "part")
    label = F.element_at(F.array(F.lit("[para-"), F.lit("paragraph-"), F.lit("para ")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))
    name = F.concat(label, F.pmod("p_partkey", F.lit(4)).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "]").otherwise(""))
    return p.select("p_partkey", ids.ordinal(name).alias("ordinal"), ids.file_stem(F.col("p_name"), F.col("p_partkey") % 1000).alias("stem"), ids.sanitize_label(F.col("p_type")).alias("label"), ids.looks_secret(F.concat(F.element_at(F.array(F.lit("SK-"), F.lit("task"), F.lit("Token "), F.lit("sk ")), (F.col("p_partkey") % 4 + 1).cast("int")), "p_name")).alias("secret"), ids.is_sensitive_field(F.concat(F.element_at(F.array(F.lit("ConText"), F.lit("name"), F.lit("Translation_id")), (F.col("p_partkey") % 3 + 1).cast("int")), "p_brand")).alias("sensitive"), ids.is_sha256_hex(F.when(F.col("p_partkey") % 2 == 0, F.sha2("p_name", 256)).otherwise(F.col("p_name"))).alias("digest"), ids.confidence(F.pmod("p_partkey", F.lit(7))).alias("confidence"))


def first_proposals(spark, d):
    """The first order of each customer and day, of two stacked halves of the orders."""
    o = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = ledger.stacked([o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")])
    return ledger.first_of(both, ["o_custkey", "o_orderdate"], ["part", "o_orderkey"])


def merged_notes(spark, d):
    """Comments of suppliers merged into blank ones."""
    s = _read(spark, d, "supplier")
    return s.select("s_suppkey", ledger.merge_notes(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.lit("  ")), F.lit("new")).alias("note"))


def review_summary(spark, d):
    """Review items by kind: open, decided and obsolete ones, and the share that is decided."""
    out = ledger.reconcile(*_ledger(spark, d), ["kind", "subject_key"], "fp", ["1-URGENT", "5-LOW"])
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.count_if((F.col("availability") == "active") & (F.col("status") == "pending")).alias("open"), F.count_if(F.col("availability") == "obsolete").alias("obsolete"), F.round(F.avg((F.col("status") != "pending").cast("double")), 6).alias("decided"))


def _ledger(spark, d) -> tuple[DataFrame, DataFrame]:
    from folium.plans.catalog import ledger_parts

    return ledger_parts(spark, d)


QUERIES = (
    profile_mentions, alias_index, alias_additions, relationship_upserts, relationships_present, unknown_names, terminology_seeds, aligned_turns, canonical_links, lacking_terms, validated_findings, analysis_spans, contrastive_failures,
    blind_pairs, hybrid_retrieval, memory_contexts, identifiers, first_proposals, merged_notes, review_summary,
)

PAIR = lambda a, b: f"trim(array_to_string(({sql.toks(sql.norm('text'))})[{a}:{b}], ' '))"
INDEX = f"""p AS (SELECT {PAIR(3, 4)} AS name, {PAIR(7, 8)} AS alias FROM benchmark),
own AS (SELECT DISTINCT name, name AS display, 0 AS rank FROM p WHERE name <> '' UNION ALL SELECT DISTINCT name, alias, 1 FROM p WHERE name <> '' AND alias <> ''),
idx AS (SELECT {sql.norm('display')} AS key, name, display FROM own QUALIFY row_number() OVER (PARTITION BY {sql.norm('display')} ORDER BY rank, name, display) = 1),
mentions AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, ' ' || {sql.norm('text')} || ' ' AS t FROM documents) d JOIN idx ON contains(t, ' ' || key || ' '))"""
HYBRID = f"""{sql.scores()}, native AS (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, strlen(source), entry_id)::INT AS native_rank FROM scores QUALIFY native_rank <= 512),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), near AS (SELECT q.vec_id AS query_id, b.vec_id AS entry_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, b.e), 6) DESC, b.vec_id)::INT AS semantic_rank FROM v q, v b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id QUALIFY semantic_rank <= 40),
j AS (SELECT query_id, entry_id, native_rank, semantic_rank, round(1::DOUBLE / (60 + native_rank) + coalesce(1::DOUBLE / (60 + semantic_rank), 0), 9) AS score FROM native LEFT JOIN near USING (query_id, entry_id)),
hybrid AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, native_rank, semantic_rank NULLS LAST, entry_id)::INT AS rank, entry_id, native_rank, semantic_rank, score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS relevance FROM j QUALIFY rank <= 6)"""

ORACLES = {
    "profile_mentions": f"WITH {INDEX} SELECT * FROM mentions",
    "alias_index": f"WITH {INDEX} SELECT * FROM idx",
    "alias_additions": f"""WITH r AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE p_brand END AS canonical_name, CASE WHEN p_partkey % 23 = 0 THEN '--' WHEN p_partkey % 13 = 0 THEN upper(p_brand) WHEN p_partkey % 17 = 0 THEN 'brand#3' ELSE p_name || ' ' || p_type END AS alias FROM part),
        t AS (SELECT *, {sql.norm('alias')} AS k, {sql.norm('canonical_name')} AS who FROM r),
        names AS (SELECT {sql.norm('p_brand')} AS k, min(p_brand) AS known FROM part GROUP BY 1), old AS (SELECT {sql.norm("p_name || ' ' || p_type")} AS k, min(p_brand) AS known FROM part WHERE p_partkey % 50 = 0 GROUP BY 1),
        f AS (SELECT k, arg_min(canonical_name, position) AS fname, min(position) AS fpos FROM t WHERE who <> '' AND k <> '' AND k <> who GROUP BY k),
        j AS (SELECT t.*, coalesce(names.known, old.known) AS known, fname, fpos FROM t LEFT JOIN names ON names.k = t.k LEFT JOIN old ON old.k = t.k LEFT JOIN f ON f.k = t.k),
        o AS (SELECT *, CASE WHEN who = '' THEN 'empty_name' WHEN k = '' THEN 'empty_alias' WHEN k = who THEN 'unchanged' WHEN known IS NULL AND fpos = position THEN 'inserted' WHEN {sql.norm('coalesce(known, fname)')} = who THEN 'unchanged' ELSE 'collision' END AS outcome FROM j)
        SELECT position, canonical_name, alias, outcome, CASE WHEN outcome = 'collision' THEN coalesce(known, fname) END AS owner FROM o""",
    "relationship_upserts": f"""WITH e AS (SELECT p_partkey AS position, {sql.norm('p_brand')} AS a, {sql.norm("'brand#' || (p_partkey % 26)")} AS b, p_type AS kind FROM part),
        r AS (SELECT position, CASE WHEN a <> b THEN least(a, b) || chr(10) || greatest(a, b) END AS pair, kind FROM e),
        c AS (SELECT pair, arg_min(kind, position) AS had FROM r WHERE position % 4 = 0 AND pair IS NOT NULL GROUP BY pair),
        w AS (SELECT r.*, had, lag(kind) OVER (PARTITION BY pair ORDER BY position) AS latest, first_value(kind) OVER (PARTITION BY pair ORDER BY position) AS earliest, row_number() OVER (PARTITION BY pair ORDER BY position) AS n FROM r LEFT JOIN c USING (pair) WHERE position % 4 <> 0),
        m AS (SELECT position, pair, kind, true AS replacing, coalesce(latest, had) AS was FROM w UNION ALL SELECT position, pair, kind, false, coalesce(had, CASE WHEN n > 1 THEN earliest END) FROM w)
        SELECT position, pair, kind, replacing, CASE WHEN pair IS NULL THEN 'invalid' WHEN was IS NULL THEN 'inserted' WHEN was = kind THEN 'unchanged' WHEN replacing THEN 'replaced' ELSE 'conflict' END AS outcome FROM m""",
    "relationships_present": f"""WITH {INDEX}, n AS (SELECT item_id, {PAIR(3, 4)} AS name FROM benchmark), r AS (SELECT DISTINCT x.name AS a, y.name AS b FROM n x JOIN n y ON y.item_id = x.item_id + 1 WHERE x.name <> y.name)
        SELECT m.doc_id, a, b FROM r JOIN mentions m ON m.name = a JOIN mentions k ON k.doc_id = m.doc_id AND k.name = b""",
    "unknown_names": f"WITH k AS (SELECT {sql.norm('p_name')} AS k FROM part WHERE p_partkey < 40 UNION SELECT {sql.norm(chr(39) + 'the ' + chr(39) + ' || p_name')} FROM part WHERE p_partkey < 40) SELECT p_partkey, p_name AS name FROM part WHERE {sql.norm('p_name')} NOT IN (SELECT k FROM k)",
    "terminology_seeds": f"""WITH u AS (SELECT p_brand AS expression, count(*) AS n, 'name' AS origin, 0 AS r FROM part GROUP BY 1 UNION ALL SELECT p_type, count(*), 'term', 1 FROM part GROUP BY 1 UNION ALL SELECT p_name, count(*), 'phrase', 2 FROM part GROUP BY 1),
        f AS (SELECT *, {sql.norm('expression')} AS key FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY r, n DESC, expression) = 1), t AS (SELECT * FROM f ORDER BY r, n DESC, expression LIMIT 256), g AS (SELECT {sql.norm('p_type')} AS key, min(p_brand) AS approved FROM part GROUP BY 1)
        SELECT expression, origin, n, approved FROM t LEFT JOIN g USING (key)""",
    "aligned_turns": """WITH s AS (SELECT conv_id AS unit, text, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position FROM conversations WHERE role IN ('user', 'assistant') AND text <> '***'),
        k AS (SELECT unit, count(*) FILTER (role = 'user') AS ns, count(*) FILTER (role = 'assistant') AS nt FROM s GROUP BY 1)
        SELECT x.unit, x.position::INT AS position, x.text AS source, y.text AS target FROM s x JOIN s y ON x.unit = y.unit AND x.position = y.position AND x.role = 'user' AND y.role = 'assistant' JOIN k ON k.unit = x.unit AND ns = nt
        UNION ALL SELECT k.unit, 1, (SELECT string_agg(text, chr(10) || chr(10) ORDER BY position) FROM s WHERE s.unit = k.unit AND role = 'user'), (SELECT string_agg(text, chr(10) || chr(10) ORDER BY position) FROM s WHERE s.unit = k.unit AND role = 'assistant') FROM k WHERE ns <> nt""",
    "canonical_links": """WITH m AS (SELECT c_custkey % 97 AS cluster, c_custkey AS mention, CASE WHEN c_custkey % 5 = 0 THEN CASE lower(c_mktsegment) WHEN 'automobile' THEN 'Otto' WHEN 'machinery' THEN 'Otto' WHEN 'building' THEN 'Bill' END END AS person FROM customer),
        k AS (SELECT cluster, min(person) AS name FROM m GROUP BY 1 HAVING min(person) = max(person)) SELECT cluster, mention, name FROM m JOIN k USING (cluster) WHERE person IS NULL""",
    "lacking_terms": f"""WITH t AS (SELECT st, min(pt) AS pt FROM (SELECT {PAIR(3, 4)} AS st, {PAIR(5, 5)} AS pt FROM benchmark) WHERE st <> '' GROUP BY 1), u AS (SELECT item_id AS unit_id, ' ' || {sql.norm('text')} || ' ' AS s, ' ' || {sql.norm('reverse(text)')} || ' ' AS o FROM benchmark)
        SELECT DISTINCT unit_id, st AS source_term FROM u JOIN t ON contains(s, ' ' || st || ' ') AND pt <> '' AND NOT contains(o, ' ' || pt || ' ')""",
    "validated_findings": """WITH f AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'claim' END AS claim, (event_id % 12) / 10.0::DOUBLE AS c, ['para-' || event_id % 3, 'para-' || event_id % 5] AS ev FROM events),
        k AS (SELECT conv_id AS user_id, list(DISTINCT 'para-' || turn) AS known FROM conversations GROUP BY 1), j AS (SELECT f.*, len(list_distinct(ev))::INT AS n, len(list_filter(ev, lambda x: NOT list_contains(coalesce(known, []), x))) AS bad FROM f LEFT JOIN k USING (user_id))
        SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'unknown_category' WHEN claim = '' THEN 'blank_claim' WHEN c > 1 THEN 'bad_confidence' WHEN bad > 0 THEN 'unsupplied_evidence' END AS reason, n AS n_cited,
            CASE WHEN c >= 0.8 AND n >= 2 THEN 'high' WHEN c >= 0.5 AND n >= 1 THEN 'moderate' ELSE 'low' END AS level FROM j""",
    "analysis_spans": "WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), r AS (SELECT item_id, w, unnest([1, 2, 3]) AS len FROM b), s AS (SELECT item_id, w, len, unnest(range(0, greatest(len(w) - len + 1, 0))) AS start FROM r) SELECT item_id, start::INT AS start, len::INT AS len, array_to_string(w[start + 1 : start + len], chr(10)) AS text FROM s",
    "contrastive_failures": f"""WITH i AS (SELECT item_id, {sql.toks(sql.norm('text'))} AS w, text FROM benchmark), v AS (SELECT item_id, w, text, unnest(['a', 'e', 't']) AS variant_id FROM i), n AS (SELECT item_id, variant_id, w, {sql.norm("replace(text, variant_id, '#')")} AS t FROM v)
        SELECT item_id AS case_id, variant_id, (CASE WHEN len(list_filter(w[1:2], lambda x: contains(t, x))) = len(w[1:2]) THEN 0 ELSE 1 END + CASE WHEN len(list_filter(w[4:5], lambda x: contains(t, x))) > 0 THEN 0 ELSE 1 END)::BIGINT AS failed FROM n""",
    "blind_pairs": "WITH b AS (SELECT item_id AS case_id, text, (row_number() OVER (ORDER BY item_id) - 1) % 2 = 0 AS f FROM benchmark) SELECT case_id, sha256(CASE WHEN f THEN text ELSE '> ' || text END) AS a_sha, sha256(CASE WHEN f THEN '> ' || text ELSE text END) AS b_sha, f AS a_is_first FROM b",
    "hybrid_retrieval": f"WITH {HYBRID} SELECT * FROM hybrid",
    "memory_contexts": f"WITH {HYBRID}, l AS (SELECT query_id, string_agg(text || ' => ' || text, chr(10) ORDER BY rank) AS c FROM hybrid JOIN benchmark ON entry_id = item_id GROUP BY 1) SELECT query_id, sha256(c) AS context_sha, length(c)::INT AS n_chars FROM l",
    "identifiers": """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND p_partkey % 4 > 0 THEN 'para-' || p_partkey % 4 END AS ordinal, lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-' || trim(regexp_replace(p_name, '[^\\p{L}\\p{N}]+', '_', 'g'), '_') AS stem,
        left(regexp_replace(p_type, '[^A-Za-z0-9_-]', '', 'g'), 64) AS label, p_partkey % 4 IN (0, 2) AS secret, p_partkey % 3 IN (0, 2) AS sensitive, p_partkey % 2 = 0 AS digest, CASE WHEN p_partkey % 7 >= 5 THEN 'high' WHEN p_partkey % 7 >= 2 THEN 'moderate' ELSE 'low' END AS confidence FROM part""",
    "first_proposals": "SELECT o_orderkey, o_custkey, o_orderdate, (o_orderkey % 2)::INT AS part FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey % 2, o_orderkey) = 1",
    "merged_notes": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'new' END AS note FROM supplier",
    "review_summary": f"""WITH r AS ({sql.ORACLES['ledger_reconcile']}) SELECT kind, count(*) AS items, count(*) FILTER (availability = 'active' AND status = 'pending') AS "open", count(*) FILTER (availability = 'obsolete') AS obsolete, round(avg((status <> 'pending')::INT::DOUBLE), 6) AS decided FROM r GROUP BY 1""",
}
