"""Queries of manuscripts, packages, alignment, proposals and packets, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import scan, text
from folium.operators import align, evaluation, matching, memory, packets, speakers
from folium.plans import reviews, sql
from folium.sources import packages
from folium.sources import text as source


def _read(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _manuscripts(spark, d) -> DataFrame:
    """Conversations as Markdown books: a user's turn begins a chapter, an assistant's ends a scene."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    turns = _read(spark, d, "conversations").select("conv_id", "turn", "role", clean.alias("t")).filter("t <> ''")
    part = F.when(F.col("role") == "user", F.concat(F.lit("# Chapter "), F.col("turn").cast("string"), F.lit("\n\n"), "t", F.lit("\n\n"))).otherwise(F.concat(F.col("t"), F.lit("\n\n***\n\n")))
    body = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "").alias("b"))
    return body.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit('---\ntitle: "Conversation '), F.col("conv_id").cast("string"), F.lit('"\nAuthor: A. Writer\n---\nBefore it all.\n\n'), "b").alias("text"))


def manuscript_metadata(spark, d):
    found = _manuscripts(spark, d).select("doc_id", source.frontmatter(F.col("text")).alias("m"))
    return found.select("doc_id", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("author")).alias("author"), F.size("m").alias("entries"))


def manuscript_blocks(spark, d):
    return source.segment(source.blocks(_manuscripts(spark, d)))


def manuscript_chapters(spark, d):
    return source.chapters(manuscript_blocks(spark, d))


def manuscript_book(spark, d):
    """The flat form of each book."""
    return source.book_blocks(manuscript_blocks(spark, d))


def manuscript_paragraphs(spark, d):
    """Blocks between blank lines of each book's text."""
    return _manuscripts(spark, d).select("doc_id", F.posexplode(text.split_paragraphs(F.col("text"))).alias("pos", "paragraph"))


def _packed(books: DataFrame) -> DataFrame:
    return packages.members(books.select(F.col("doc_id").cast("string").alias("path"), "content"))


def epub_round_trip(spark, d):
    """Books written as EPUB packages and read again."""
    return packages.epub_blocks(_packed(packages.epub_books(manuscript_chapters(spark, d), "en")))


def epub_facts(spark, d):
    """Package metadata and the reading order of books written as EPUB packages."""
    archive = _packed(packages.epub_books(manuscript_chapters(spark, d), "en", "A. Writer"))
    manifest, spine = packages.epub_items(archive)
    pages = spine.join(manifest, (spine["path"] == manifest["path"]) & (spine["idref"] == manifest["id"])).groupBy(spine["path"].alias("path")).agg(F.count(F.lit(1)).alias("pages"), F.max_by("member", "position").alias("last_page"))
    return packages.epub_metadata(archive).join(pages, "path").select("path", "title", "creator", "language", F.length("identifier").alias("identifier_chars"), "pages", "last_page")


def package_entries(spark, d):
    """Package files made of documents (text as description, language and source as subjects, every third an archived work), merged into what is known of them."""
    t, n = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    escaped = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    origin = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see https://WWW.archiveofourown.org/works/00"), n, F.lit("/chapters/1"))).otherwise("mirror-archiveofourown.org/works/7")
    xml = F.concat(F.lit('<package><metadata><dc:identifier id="a">urn:doc:'), n, F.lit("</dc:identifier><dc:source>"), origin, F.lit("</dc:source><source/><dc:date> 2001 </dc:date><dc:description>"), escaped, F.lit("</dc:description><subject>"), F.col("source"), F.lit("</subject><dc:subject>"), F.col("lang"), F.lit("</dc:subject><subject>\n"), F.col("lang"), F.lit("</subject></metadata></package>"))
    known = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("epub_date"), F.lit("1999"), F.lit("source_url"), F.lit("local")))
    m = packages.merge_package_metadata(known, xml)
    rows = _read(spark, d, "documents").select("doc_id", m.alias("m"))
    value = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select("doc_id", F.size("m").alias("entries"), F.sha2(value("epub_description"), 256).alias("description_sha"), *[value(k).alias(k) for k in ("epub_identifier", "epub_date", "epub_subjects", "source_site", "source_url", "ao3_work_id")])


def docx_round_trip(spark, d):
    """Books written as DOCX packages and read again."""
    return packages.docx_blocks(_packed(packages.docx_books(manuscript_chapters(spark, d), "en")))


MANUSCRIPT_SQL = """
WITH m AS (SELECT conv_id AS doc_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY doc_id ORDER BY turn) AS section FROM m),
r AS (SELECT doc_id, section, turn, t, coalesce(sum((role <> 'user')::INT) OVER (PARTITION BY doc_id, section ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY doc_id, section) AS head FROM s
    UNION ALL SELECT DISTINCT doc_id, 0, -1, 'Before it all.', 0, NULL FROM m),
seg AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY section)::INT AS chapter, head, dense_rank() OVER (PARTITION BY doc_id, section ORDER BY cut)::INT AS scene, row_number() OVER (PARTITION BY doc_id, section, cut ORDER BY turn)::INT AS paragraph, t AS text FROM r),
par AS (SELECT doc_id, chapter, 'Chapter ' || coalesce(head, chapter) AS title, scene, paragraph, text FROM seg),
scenes AS (SELECT doc_id, chapter, title, scene, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS body, count(*) AS n FROM par GROUP BY ALL),
chap AS (SELECT doc_id, chapter, title, string_agg(body, chr(10) || chr(10) || '***' || chr(10) || chr(10) ORDER BY scene) AS content, sum(n)::BIGINT AS n_paragraphs FROM scenes GROUP BY ALL),
flat AS (SELECT doc_id, chapter, 0 AS scene, 0 AS paragraph, 'heading' AS kind, title AS text FROM chap UNION ALL SELECT doc_id, chapter, scene, 0, 'scene_break', '***' FROM scenes WHERE scene > 1 UNION ALL SELECT doc_id, chapter, scene, paragraph, 'paragraph', text FROM par)"""


def speaker_packets(spark, d) -> DataFrame:
    """Evidence of paragraphs of speech as chapters of their conversation."""
    paragraphs, profiles, aliases = reviews._dialogue(spark, d)
    number = F.split("paragraph", "-")
    rows = paragraphs.select(F.col("paragraph").alias("unit_id"), F.get(number, F.lit(0)).alias("book"), F.get(number, F.lit(1)).cast("bigint").alias("position"), "text")
    chapters = rows.select("unit_id", "book", "position", F.concat(F.lit("Conversation "), "book").alias("document_title"), F.concat(F.lit("Turn "), F.col("position").cast("string")).alias("title"), "text")
    found = matching.known_profiles(rows, profiles, aliases, "unit_id")
    who = found.select("unit_id", "name", F.concat(F.lit("Character: "), "name").alias("context"))
    own = _read(spark, d, "supplier").select(F.col("s_name").alias("a"), F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") + 1).cast("string"), 9, "0")).alias("b"))
    pairs = matching.relationships_present(found, own, "unit_id").select("unit_id", "a", "b", F.concat(F.lit("Relationship: "), "a", F.lit(" ↔ "), "b").alias("context"))
    said = speakers.speaker_context(speakers.attribute(paragraphs, profiles, aliases)).select(F.col("paragraph").alias("unit_id"), "context")
    notes = rows.filter("position % 3 = 1").select("unit_id", F.lit(0).alias("position"), F.concat(F.lit(" keep the tone of "), "unit_id").alias("line"))
    return packets.chapter_candidates(chapters, who, pairs, said, reviewed=notes)


def chapter_evidence(spark, d):
    return speaker_packets(spark, d).select("unit_id", "id", "kind", "authority", F.sha2("text", 256).alias("text_sha"), "relevance", F.array_join("evidence_ids", ",").alias("evidence"))


LIMITS = (900, 4, 300)


def chapter_packets(spark, d):
    """The evidence of each paragraph within a budget."""
    return memory.pack_context(speaker_packets(spark, d), most_chars=LIMITS[0], most_items=LIMITS[1], item_chars=LIMITS[2])


def candidate_fingerprints(spark, d):
    return packets.candidates_fingerprint(speaker_packets(spark, d))


def packet_fingerprints(spark, d):
    rows = reviews._dialogue(spark, d)[0].select(F.col("paragraph").alias("unit_id"), F.sha2("text", 256).alias("source_fp"))
    return packets.packet_fingerprint(chapter_packets(spark, d), rows, "canon", LIMITS)


def _evidence(namespace: str, *parts: str) -> str:
    return f"'{namespace}-' || sha256('{namespace}' || " + " || ".join(f"chr(31) || {p}" for p in parts) + ")"


EVIDENCE_SQL = reviews.SPEAKERS + f""",
ctx AS ({reviews.CONTEXT_SQL[len(reviews.SPEAKERS):]}),
ch2 AS (SELECT paragraph AS unit_id, string_split(paragraph, '-')[1] AS book, string_split(paragraph, '-')[2]::BIGINT AS position, t FROM par),
near2 AS (SELECT unit_id, lag(unit_id) OVER w AS p, lead(unit_id) OVER w AS n, 'Turn ' || lag(position) OVER w AS pt, 'Turn ' || lead(position) OVER w AS nt, lag(right(t, 900)) OVER w AS tail, lead(left(t, 900)) OVER w AS head FROM ch2 WINDOW w AS (PARTITION BY book ORDER BY position)),
normed AS (SELECT unit_id, ' ' || {sql.norm('t')} || ' ' AS nt FROM ch2),
meet AS (SELECT DISTINCT unit_id, s_name AS name, s_suppkey FROM normed JOIN supplier ON contains(nt, ' ' || {sql.norm('s_name')} || ' ') OR contains(nt, ' sup' || s_suppkey || ' ')),
pairs2 AS (SELECT x.unit_id, x.name AS a, y.name AS b FROM meet x JOIN meet y ON x.unit_id = y.unit_id AND y.s_suppkey = x.s_suppkey + 1),
texts AS (SELECT unit_id, 'chapter-metadata' AS ns, 'reference' AS kind, 'deterministic' AS authority, 'document_title=Conversation ' || book || chr(10) || 'chapter_title=Turn ' || position AS text, unit_id AS x1, NULL AS x2, 1.0::DOUBLE AS relevance, '' AS evidence, 'document/chapter identity for the current translation unit' AS reason FROM ch2
    UNION ALL SELECT unit_id, 'previous-chapter', 'local_continuity', 'deterministic', 'PREVIOUS CHAPTER CONTINUITY — source evidence from ' || pt || ':' || chr(10) || tail, p, NULL, 0.82, p, 'bounded tail of the immediately preceding source chapter' FROM near2 WHERE trim(tail) <> ''
    UNION ALL SELECT unit_id, 'next-chapter', 'local_continuity', 'deterministic', 'NEXT CHAPTER CONTINUITY — source evidence from ' || nt || ':' || chr(10) || head, n, NULL, 0.74, n, 'bounded head of the immediately following source chapter' FROM near2 WHERE trim(head) <> ''
    UNION ALL SELECT unit_id, 'character-canon', 'character', 'canonical', 'Character: ' || name, name, NULL, 1.0, '', 'canonical character is present in the current source unit' FROM meet
    UNION ALL SELECT unit_id, 'relationship-canon', 'relationship', 'canonical', 'Relationship: ' || a || ' ↔ ' || b, a, b, 1.0, '', 'both endpoints of a canonical relationship are present in the current unit' FROM pairs2
    UNION ALL SELECT paragraph, 'speaker-map', 'character', 'deterministic', context, paragraph, NULL, 0.94, paragraph, 'high-precision explicit quote-speaker evidence; unresolved dialogue is omitted' FROM ctx
    UNION ALL SELECT unit_id, 'reviewed-literary', 'translation_decision', 'human_approved', 'REVIEWED LITERARY FINDING — human-approved context:' || chr(10) || 'keep the tone of ' || unit_id, unit_id, '0', 1.0, unit_id, 'approved or edited literary-review finding scoped to this chapter' FROM ch2 WHERE position % 3 = 1),
cand AS (SELECT unit_id, ns || '-' || sha256(ns || chr(31) || x1 || CASE WHEN x2 IS NULL THEN '' ELSE chr(31) || x2 END || chr(31) || text) AS id, kind, authority, text, reason, relevance, evidence FROM texts)"""


def _pack_sql(most_chars: int, most_items: int, item_chars: int) -> str:
    """Items of ``cand`` (unit_id, id, kind, authority, text, reason, relevance) within a budget, one step for each item in order."""
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY CASE authority WHEN 'human_approved' THEN 5 WHEN 'canonical' THEN 4 WHEN 'deterministic' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END DESC,
    CASE kind WHEN 'translation_decision' THEN 95 WHEN 'character' THEN 90 WHEN 'relationship' THEN 85 WHEN 'local_continuity' THEN 80 WHEN 'scene_summary' THEN 75 WHEN 'reference' THEN 35 ELSE 0 END DESC, relevance DESC, id) AS o FROM cand WHERE trim(text) <> ''),
once AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY unit_id, id ORDER BY o) = 1),
turn_of AS (SELECT unit_id, id, kind, CASE WHEN length(trim(text)) > {item_chars} THEN left(trim(text), {item_chars}) || ' …' ELSE trim(text) END AS body, length(trim(text)) > {item_chars} AS cut, length(kind) + length(authority) + length(id) + length(trim(reason)) + 39 AS head, row_number() OVER (PARTITION BY unit_id ORDER BY o) AS i FROM once),
pack AS (SELECT unit_id, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, NULL::VARCHAR AS id, NULL::VARCHAR AS kind, NULL::VARCHAR AS text, false AS cut FROM (SELECT DISTINCT unit_id FROM turn_of)
    UNION ALL SELECT unit_id, i, CASE WHEN fits THEN used + fixed + length(piece) ELSE used END, CASE WHEN fits THEN n + 1 ELSE n END, CASE WHEN fits THEN id END, kind, piece, cut OR length(body) > room FROM (
        SELECT *, n < {most_items} AND room > 0 AND trim(left(body, greatest(room, 0))) <> '' AS fits, left(body, greatest(room, 0)) AS piece FROM (
        SELECT p.unit_id, t.i, p.used, p.n, t.id, t.kind, t.body, t.cut, t.head + CASE WHEN p.n > 0 THEN 2 ELSE 0 END AS fixed, {most_chars} - p.used - t.head - CASE WHEN p.n > 0 THEN 2 ELSE 0 END AS room FROM pack p JOIN turn_of t ON t.unit_id = p.unit_id AND t.i = p.i + 1))),
packed AS (SELECT unit_id, n AS position, id, kind, text, cut AS truncated FROM pack WHERE id IS NOT NULL)"""


# a header has 39 characters besides its labels, id and reason: "[", " | ", " | id=", " | relevance=" and five digits, "]" and a line "Reason: " with its ends
PACKETS_SQL = EVIDENCE_SQL.replace("WITH turns", "WITH RECURSIVE turns", 1) + "," + _pack_sql(*LIMITS)
CONTEXT_PACKETS_SQL = (
    "WITH RECURSIVE cand AS (SELECT conv_id AS unit_id, 't' || turn AS id, CASE WHEN role = 'user' THEN 'reference' ELSE 'scene_summary' END AS kind, CASE WHEN turn % 3 = 0 THEN 'canonical' ELSE 'deterministic' END AS authority, text, 'turn' AS reason, 1.0::DOUBLE / (turn + 1) AS relevance FROM conversations),"
    + _pack_sql(1_000, 4, 300)
    + " SELECT * FROM packed"
)


def _seeds(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items as seeds of characters, relationships and terms, with the canon and the chapters that show them."""
    i = F.col("item_id")
    w = F.split("text", " ")
    named = _read(spark, d, "benchmark").select("item_id", F.array_join(F.slice(w, 1, 2), " ").alias("name"), F.array_join(F.slice(w, 4, 2), " ").alias("two"), F.get(w, F.lit(0)).alias("first"))
    key = lambda p: F.concat(F.lit(p), i.cast("string"))
    characters = named.select(key("c-").alias("seed_id"), i.alias("position"), "name", F.element_at(F.array(F.lit("high"), F.lit("moderate"), F.lit("low")), (i % 3 + 1).cast("int")).alias("level"), (i % 9).alias("count"), (i % 4 == 0).alias("approved"))
    other = named.select((i - 1).alias("item_id"), F.col("name").alias("b"))
    pairs = named.join(other, "item_id").select(key("r-").alias("seed_id"), i.alias("position"), F.col("name").alias("a"), "b", (i % 5 + 1).alias("count"), (i % 6 == 0).alias("approved"))
    expression = F.when(i % 5 == 0, F.col("name")).otherwise(F.col("two"))
    terms = named.select(key("t-").alias("seed_id"), i.alias("position"), expression.alias("expression"), F.when(i % 7 == 0, "tr").alias("translation"), F.when(i % 5 == 0, "character_name").otherwise("other").alias("category"))
    aliases = named.filter("item_id % 9 = 1").select(F.col("first").alias("alias"), key("C").alias("canonical"))
    glossary = named.filter("item_id % 8 IN (0, 3)").select(expression.alias("source_term"), F.when(i % 8 == 0, "tr").otherwise("other").alias("preferred_translation"))
    seeds = characters.select("seed_id", "position").unionByName(pairs.select("seed_id", "position")).unionByName(terms.select("seed_id", "position"))
    docs = _read(spark, d, "documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("chapter_id"), (F.col("doc_id") % 13).alias("m"))
    evidence = docs.join(F.broadcast(seeds.withColumn("m", F.col("position") % 13)), "m").select("seed_id", "chapter_id")
    return characters, pairs, terms, aliases, glossary, evidence


def seed_conflicts(spark, d):
    characters, _, terms, aliases, glossary, _ = _seeds(spark, d)
    return packets.seed_conflicts(characters, terms, aliases, glossary)


def initialization_proposal(spark, d):
    characters, pairs, terms, aliases, glossary, evidence = _seeds(spark, d)
    out = packets.proposal(characters, pairs, terms, packets.seed_conflicts(characters, terms, aliases, glossary), evidence, 600)
    return out.select("chapter_id", *[F.array_join(c, ",").alias(c) for c in ("character_seeds", "relationship_seeds", "term_seeds")], F.sha2("context", 256).alias("context_sha"), F.length("context").alias("n_chars"))


SEEDS_SQL = f"""
WITH n AS (SELECT item_id AS i, array_to_string(string_split(text, ' ')[1:2], ' ') AS name, array_to_string(string_split(text, ' ')[4:5], ' ') AS two, string_split(text, ' ')[1] AS first FROM benchmark),
c AS (SELECT 'c-' || i AS seed_id, i, name, ['High', 'Moderate', 'Low'][i % 3 + 1] AS level, i % 9 AS k, i % 4 = 0 AS approved FROM n),
r AS (SELECT 'r-' || x.i AS seed_id, x.i, x.name AS a, y.name AS b, x.i % 5 + 1 AS k, x.i % 6 = 0 AS approved FROM n x JOIN n y ON y.i = x.i + 1),
t AS (SELECT 't-' || i AS seed_id, i, CASE WHEN i % 5 = 0 THEN name ELSE two END AS expression, CASE WHEN i % 7 = 0 THEN 'tr' END AS translation, i % 5 = 0 AS is_name FROM n),
idx AS (SELECT {sql.norm('first')} AS key, max('C' || i) AS canonical FROM n WHERE i % 9 = 1 AND {sql.norm('first')} <> '' GROUP BY 1),
g AS (SELECT {sql.norm('CASE WHEN i % 5 = 0 THEN name ELSE two END')} AS key, min(CASE WHEN i % 8 = 0 THEN 'tr' ELSE 'other' END) AS approved FROM n WHERE i % 8 IN (0, 3) GROUP BY 1),
clash AS (SELECT seed_id, 'character_name' AS kind, name AS inferred, arg_min(canonical, key) AS approved FROM (SELECT seed_id, name, unnest(list_distinct({sql.toks(sql.norm('name'))})) AS key FROM c WHERE NOT approved) JOIN idx USING (key) GROUP BY ALL
    UNION ALL SELECT seed_id, 'terminology', coalesce(translation, ''), g.approved FROM t JOIN g ON g.key = {sql.norm('expression')} WHERE translation IS DISTINCT FROM g.approved),
ev AS (SELECT seed_id, 'd-' || doc_id AS chapter_id FROM (SELECT seed_id, i FROM c UNION ALL SELECT seed_id, i FROM r UNION ALL SELECT seed_id, i FROM t) s JOIN documents ON doc_id % 13 = s.i % 13),
names AS (SELECT DISTINCT {sql.norm('name')} AS key FROM c WHERE approved),
lines AS (SELECT chapter_id, 1 AS section, i, '- character candidate: ' || name || ' (' || level || ', ' || k || ' occurrences)' AS line FROM ev JOIN c USING (seed_id) WHERE NOT approved AND seed_id NOT IN (SELECT seed_id FROM clash)
    UNION ALL SELECT chapter_id, 2, i, '- co-occurrence: ' || a || ' ↔ ' || b || ' (' || k || ' interactions; relationship type unknown)' FROM ev JOIN r USING (seed_id) WHERE NOT approved
    UNION ALL SELECT chapter_id, 3, i, '- terminology candidate: ' || expression FROM (SELECT chapter_id, seed_id, i, expression, row_number() OVER (PARTITION BY chapter_id ORDER BY i, seed_id) AS o FROM ev JOIN t USING (seed_id) WHERE translation IS NULL AND NOT (is_name AND {sql.norm('expression')} IN (SELECT key FROM names))) WHERE o <= 12),
ctx AS (SELECT chapter_id, left('{packets.SEEDS_HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY section, i, line), 600) AS context FROM lines GROUP BY chapter_id),
ids AS (SELECT chapter_id, coalesce(string_agg(seed_id, ',' ORDER BY i) FILTER (seed_id[1] = 'c'), '') AS character_seeds, coalesce(string_agg(seed_id, ',' ORDER BY i) FILTER (seed_id[1] = 'r'), '') AS relationship_seeds, coalesce(string_agg(seed_id, ',' ORDER BY i) FILTER (seed_id[1] = 't'), '') AS term_seeds
    FROM (SELECT DISTINCT chapter_id, seed_id, split_part(seed_id, '-', 2)::BIGINT AS i FROM ev) GROUP BY chapter_id)"""


STATUSES = ("acceptable", "unacceptable", "unknown")


def governance_blocks(spark, d):
    """Customers as profiles whose answers follow from their keys; some are missing."""
    k = F.col("c_custkey")
    pick = lambda step: F.when(k % (step + 2) != 0, F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(k / step) % 3 + 1).cast("int")))
    profile = _read(spark, d, "customer").select("c_custkey", pick(3).alias("terms"), pick(5).alias("privacy"), pick(7).alias("cost"), pick(11).alias("retention"))
    return evaluation.governance(profile, ["terms", "privacy", "cost", "retention"], ("c_custkey",))


GOVERNANCE_SQL = """
SELECT c_custkey, item, status, coalesce(status, 'unknown') <> 'acceptable' AS blocks FROM (SELECT c_custkey, item, CASE WHEN c_custkey % (step + 2) <> 0 THEN ['acceptable', 'unacceptable', 'unknown'][(c_custkey // step) % 3 + 1] END AS status FROM customer, (VALUES ('terms', 3), ('privacy', 5), ('cost', 7), ('retention', 11)) v(item, step))
"""


#: Latin letters as Arabic-script ones, some of them with joiners, stretched letters, digits and blanks; the same expression in both dialects.
SCRIPT = """replace(replace(replace(replace(replace(replace(replace(translate(replace(replace(lower(text), 'the', 'می '), 'in', '٣'), 'abcdefghijklmopqrstuvwxyz', 'ابپتثجچحخدذرزسشصضطظعغفقكيه'), 'ان', 'ـ'), 'تث', '‌'), ' ط', '‌ '), 'ث,', ' ،'), 'رث', '‌‌'), '.', ' .'), 'ه ', 'ك  ')"""


def _script(spark, d) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("unit_id"), F.expr(SCRIPT).alias("target"))


def persian_polish(spark, d):
    t = F.col("target")
    return _script(spark, d).select(F.col("unit_id").alias("id"), F.sha2(text.polish_persian(t), 256).alias("polished_sha"), text.contains_persian_letters(t).alias("persian"), F.length(text.polish_persian(t)).alias("n_chars"))


def persian_typography(spark, d):
    found = _script(spark, d).select("unit_id", F.explode(scan.typography(F.col("target"))).alias("f"))
    return found.select("unit_id", "f.kind", "f.char_index", "f.suggestion")


SCRIPT_SQL = f"""
WITH s AS (SELECT item_id AS id, {SCRIPT} AS t FROM benchmark),
ch AS (SELECT id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM s),
near AS (SELECT *, lag(c) OVER w AS p, lag(c, 2) OVER w AS pp, lead(c) OVER w AS n, coalesce(lag(c, 4) OVER w, '') || coalesce(lag(c, 3) OVER w, '') || coalesce(lag(c, 2) OVER w, '') || coalesce(lag(c, 1) OVER w, '') AS back FROM ch WINDOW w AS (PARTITION BY id ORDER BY i)),
kinds AS (SELECT id, i, c, CASE WHEN contains('يىك', c) THEN 'arabic_letter_variant' WHEN contains('٠١٢٣٤٥٦٧٨٩', c) THEN 'arabic_digit_variant' WHEN c = 'ـ' THEN 'kashida' WHEN c = '‌' AND p = '‌' THEN 'duplicate_zwnj'
    WHEN c = '‌' AND (p IS NULL OR regexp_matches(p, '^[\\s،؛؟!?,.:;)\\]}}»…]$') OR n IS NULL OR regexp_matches(n, '^[\\s،؛؟!?,.:;)\\]}}»…]$')) THEN 'invalid_zwnj' WHEN c = ' ' AND p = ' ' AND coalesce(pp, '') <> ' ' THEN 'multiple_spaces'
    WHEN c = ' ' AND regexp_matches(coalesce(n, ''), '^[،؛؟!?,.:;)\\]}}»…]$') THEN 'space_before_punctuation' WHEN c = ' ' AND regexp_matches(back, '(^|\\s)(می|نمی)$') THEN 'prefix_spacing' END AS kind FROM near),
mapped AS (SELECT id, i, translate(c, 'يىك٠١٢٣٤٥٦٧٨٩', 'ییک۰۱۲۳۴۵۶۷۸۹') AS c FROM ch WHERE c <> 'ـ'),
around AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS n FROM mapped WINDOW w AS (PARTITION BY id ORDER BY i)),
polished AS (SELECT id, string_agg(c, '' ORDER BY i) AS t FROM around WHERE NOT (c = '‌' AND (p IS NULL OR p = '‌' OR regexp_matches(p, '^[\\s،؛؟!?,.:;)\\]}}»…]$') OR n IS NULL OR regexp_matches(n, '^[\\s،؛؟!?,.:;)\\]}}»…]$'))) GROUP BY id)"""


def embedding_alignment(spark, d):
    """Each label's vectors, even against odd ids, in units of twelve a side, aligned in blocks of up to three by three."""
    v = _read(spark, d, "embeddings").withColumn("side", F.when(F.col("vec_id") % 2 == 0, "source").otherwise("target"))
    n = F.row_number().over(Window.partitionBy("label", "side").orderBy("vec_id")) - 1
    unit = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("n") / 12).cast("string"))
    segments = v.withColumn("n", n).select(unit.alias("unit_id"), "side", (F.col("n") % 12).alias("position"), "embedding")
    return align.align(align.segment_spans(segments)).withColumn("similarity", F.round("similarity", 9))


def chrf_scores(spark, d):
    c = _read(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    pairs = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source")).join(a, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(align.chrf(F.col("output"), F.col("source")), 6).alias("chrf"))


CHRF_SQL = """
WITH p AS (SELECT u.conv_id, u.turn, a.text AS h, u.text AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
s AS (SELECT conv_id, turn, side, string_split(regexp_replace(t, '\\s+', '', 'g'), '') AS c, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM (SELECT conv_id, turn, 'h' AS side, h AS t FROM p UNION ALL SELECT conv_id, turn, 'r', r FROM p)),
g AS (SELECT conv_id, turn, side, 'c' || n AS k, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i : i + n - 1], ''))) AS g FROM s, (VALUES (1), (2), (3), (4), (5), (6)) x(n)
    UNION ALL SELECT conv_id, turn, side, 'w' || n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], chr(31)))) FROM s, (VALUES (1), (2)) x(n)),
f AS (SELECT conv_id, turn, side, k, g, count(*) AS n FROM g GROUP BY ALL),
tot AS (SELECT conv_id, turn, k, sum(n) FILTER (side = 'h') AS nh, sum(n) FILTER (side = 'r') AS nr FROM f GROUP BY ALL),
hit AS (SELECT x.conv_id, x.turn, x.k, sum(least(x.n, y.n)) AS hit FROM f x JOIN f y ON x.side = 'h' AND y.side = 'r' AND x.conv_id = y.conv_id AND x.turn = y.turn AND x.k = y.k AND x.g = y.g GROUP BY ALL),
score AS (SELECT conv_id, turn, k, CASE WHEN coalesce(hit, 0) = 0 THEN 0.0::DOUBLE ELSE 5 * (hit::DOUBLE / nh) * (hit::DOUBLE / nr) / (4 * (hit::DOUBLE / nh) + hit::DOUBLE / nr) END AS f FROM tot LEFT JOIN hit USING (conv_id, turn, k) WHERE nh > 0 AND nr > 0)
SELECT conv_id, turn, coalesce(round(100.0 * avg(f), 6), 0.0) AS chrf FROM p LEFT JOIN score USING (conv_id, turn) GROUP BY conv_id, turn
"""

QUERIES = (
    manuscript_metadata, manuscript_blocks, manuscript_chapters, manuscript_book, manuscript_paragraphs, epub_round_trip, epub_facts, package_entries, docx_round_trip, chapter_evidence, chapter_packets, candidate_fingerprints, packet_fingerprints,
    seed_conflicts, initialization_proposal, governance_blocks, persian_polish, persian_typography, embedding_alignment, chrf_scores,
)

#: Lines of documents in blocks; sections without a paragraph are no chapters.
SECTIONS_SQL = """
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS pos, trim(unnest(a), ' ') AS t FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS a FROM documents)),
k AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN t IN ('***', '---', '* * *') THEN 'scene_break' WHEN regexp_matches(t, '^#{1,6} ') OR (strlen(t) <= 120 AND regexp_matches(t, '^(?i:chapter|part|book) |^(فصل|بخش) ')) THEN 'heading' ELSE 'paragraph' END AS kind FROM l),
g AS (SELECT *, sum((kind <> 'paragraph' OR coalesce(prev, 'blank') <> 'paragraph')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS part, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k)),
p AS (SELECT doc_id, section, part, sum(length(t)) + count(*) - 1 AS n FROM g WHERE kind = 'paragraph' GROUP BY ALL)
SELECT doc_id, count(DISTINCT section)::INT AS chapters, count(*) AS paragraphs, sum(n)::BIGINT AS n_chars FROM p GROUP BY doc_id
"""

#: Quotes by marks and by lines that a dash begins, over whole documents.
QUOTED_SQL = """
WITH par AS (SELECT doc_id, text AS t FROM documents WHERE regexp_matches(text, '["“”‘’«»—]')),
ch AS (SELECT doc_id, unnest(range(length(t))) AS i, unnest(string_split(t, '')) AS c FROM par),
even AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM ch WHERE c = '"'),
marks(style, rank, o, e) AS (VALUES ('curly_double', 2, '“', '”'), ('curly_single', 3, '‘', '’'), ('guillemets', 4, '«', '»')),
ends AS (SELECT style, rank, doc_id, i, coalesce(lag(i) OVER (PARTITION BY style, doc_id ORDER BY i), -1) AS before FROM ch JOIN marks ON c = e),
begins AS (SELECT style, doc_id, i FROM ch JOIN marks ON c = o),
paired AS (SELECT x.doc_id, x.i + 1 AS qs, y.i AS qe, 'straight_double' AS style, 1 AS rank FROM even x JOIN even y ON x.doc_id = y.doc_id AND y.r = x.r + 1 AND x.r % 2 = 1
    UNION ALL SELECT e.doc_id, min(b.i) + 1, e.i, e.style, e.rank FROM ends e JOIN begins b ON b.style = e.style AND b.doc_id = e.doc_id AND b.i > e.before AND b.i < e.i GROUP BY e.doc_id, e.i, e.style, e.rank),
lines AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ls FROM (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS k FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM par))),
dashes AS (SELECT doc_id, ls + length(line) - length(regexp_replace(line, '^\\s*—\\s*', '')) AS qs, ls + length(line) AS qe, 'leading_dash' AS style, 5 AS rank FROM lines l WHERE regexp_matches(line, '^\\s*—\\s*\\S') AND NOT EXISTS (SELECT 1 FROM paired p WHERE p.doc_id = l.doc_id AND p.qs >= l.ls AND p.qe <= l.ls + length(l.line))),
once AS (SELECT * FROM (SELECT * FROM paired UNION ALL SELECT * FROM dashes) QUALIFY row_number() OVER (PARTITION BY doc_id, qs, qe ORDER BY rank) = 1)
SELECT doc_id, qs::INT AS start, qe::INT AS "end", style, t[qs + 1 : qe] AS quote FROM once JOIN par USING (doc_id)
"""

#: 64-bit FNV-1a over the UTF-8 bytes, in 128-bit integers.
FNV_SQL = """
SELECT item_id, lpad(lower(to_hex((list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(strlen(text)), lambda i: ('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2])::INT::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616))::UBIGINT)), 16, '0') AS fnv FROM benchmark
"""

ORACLES = {
    "document_segments": SECTIONS_SQL, "quoted_spans": QUOTED_SQL, "fnv_fingerprint": FNV_SQL, "manuscript_metadata": MANUSCRIPT_SQL + " SELECT DISTINCT doc_id, 'Conversation ' || doc_id AS title, 'A. Writer' AS author, 2 AS entries FROM m",
    "manuscript_blocks": MANUSCRIPT_SQL + " SELECT * FROM par", "manuscript_chapters": MANUSCRIPT_SQL + " SELECT *, strlen(content)::BIGINT AS n_bytes FROM chap",
    "manuscript_book": MANUSCRIPT_SQL + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, scene, paragraph)::INT AS position, kind, text FROM flat",
    "manuscript_paragraphs": MANUSCRIPT_SQL + """, b AS (SELECT doc_id, -2 AS turn, 0 AS o, '--- title: "Conversation ' || doc_id || '" Author: A. Writer --- Before it all.' AS paragraph FROM (SELECT DISTINCT doc_id FROM m)
        UNION ALL SELECT doc_id, turn, 0, '# Chapter ' || turn FROM m WHERE role = 'user' UNION ALL SELECT doc_id, turn, 1, t FROM m UNION ALL SELECT doc_id, turn, 2, '***' FROM m WHERE role <> 'user')
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY turn, o) - 1)::INT AS pos, paragraph FROM b""",
    "epub_round_trip": MANUSCRIPT_SQL + " SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, scene, paragraph)::INT AS block, CASE WHEN kind = 'heading' THEN 'heading' ELSE 'paragraph' END AS kind, (kind = 'heading')::INT AS level, text FROM flat",
    "epub_facts": MANUSCRIPT_SQL + " SELECT doc_id::VARCHAR AS path, doc_id::VARCHAR AS title, 'A. Writer' AS creator, 'en' AS language, 75 AS identifier_chars, count(*) AS pages, 'OEBPS/text/chapter-' || lpad(count(*)::VARCHAR, 5, '0') || '.xhtml' AS last_page FROM chap GROUP BY doc_id",
    "package_entries": """
        WITH x AS (SELECT doc_id, left(trim(regexp_replace(coalesce(text, ''), '[\\s\\v\\x{85}\\p{Z}]+', ' ', 'g'), ' '), 16384) AS body, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR END AS work, lang, source FROM documents)
        SELECT doc_id, (4 + (body <> '')::INT + 3 * (work IS NOT NULL)::INT + (work IS NULL AND doc_id % 2 = 0)::INT)::INT AS entries, sha256(nullif(body, '')) AS description_sha, 'urn:doc:' || doc_id AS epub_identifier, CASE WHEN doc_id % 2 = 0 THEN '1999' ELSE '2001' END AS epub_date,
            CASE WHEN lang = source THEN lang ELSE lang || ' | ' || source END AS epub_subjects, CASE WHEN work IS NOT NULL THEN 'archiveofourown.org' END AS source_site, CASE WHEN work IS NOT NULL THEN 'https://archiveofourown.org/works/' || work WHEN doc_id % 2 = 0 THEN 'local' END AS source_url, work AS ao3_work_id FROM x""",
    "docx_round_trip": MANUSCRIPT_SQL + ", x AS (SELECT * FROM flat UNION ALL SELECT DISTINCT doc_id, -1, 0, 0, 'title', doc_id::VARCHAR FROM m) SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, scene, paragraph)::INT AS block, CASE WHEN kind = 'heading' THEN 'heading' ELSE 'paragraph' END AS kind, (kind = 'heading')::INT AS level, text FROM x",
    "chapter_evidence": EVIDENCE_SQL + " SELECT unit_id, id, kind, authority, sha256(text) AS text_sha, relevance, evidence FROM cand", "chapter_packets": PACKETS_SQL + " SELECT * FROM packed",
    "candidate_fingerprints": EVIDENCE_SQL + " SELECT unit_id, sha256(string_agg(sha256(id || chr(31) || kind || chr(31) || authority || chr(31) || trim(text) || chr(31) || reason || chr(31) || printf('%.6f', relevance) || chr(31) || evidence), chr(30) ORDER BY id, kind)) AS fingerprint FROM cand GROUP BY unit_id",
    "packet_fingerprints": PACKETS_SQL + f", items AS (SELECT unit_id, string_agg(sha256(position || chr(31) || id || chr(31) || kind || chr(31) || text || chr(31) || truncated), chr(30) ORDER BY position) AS items FROM packed GROUP BY unit_id) SELECT paragraph AS unit_id, sha256(paragraph || chr(31) || sha256(t) || chr(31) || 'canon' || chr(31) || '{','.join(map(str, LIMITS))}' || chr(31) || coalesce(items, '')) AS fingerprint FROM par LEFT JOIN items ON unit_id = paragraph",
    "seed_conflicts": SEEDS_SQL + " SELECT * FROM clash", "initialization_proposal": SEEDS_SQL + " SELECT chapter_id, character_seeds, relationship_seeds, term_seeds, sha256(coalesce(context, '')) AS context_sha, length(coalesce(context, ''))::INT AS n_chars FROM ids LEFT JOIN ctx USING (chapter_id)",
    "governance_blocks": GOVERNANCE_SQL, "persian_polish": SCRIPT_SQL + " SELECT id, sha256(p.t) AS polished_sha, regexp_matches(s.t, '[\\p{Arabic}]') AS persian, length(p.t)::INT AS n_chars FROM s JOIN polished p USING (id)",
    "persian_typography": SCRIPT_SQL + " SELECT id AS unit_id, kind, i::INT AS char_index, CASE WHEN kind IN ('arabic_letter_variant', 'arabic_digit_variant') THEN translate(c, 'يىك٠١٢٣٤٥٦٧٨٩', 'ییک۰۱۲۳۴۵۶۷۸۹') WHEN kind = 'prefix_spacing' THEN '‌' WHEN kind = 'multiple_spaces' THEN ' ' ELSE '' END AS suggestion FROM kinds WHERE kind IS NOT NULL",
    "chrf_scores": CHRF_SQL, "context_packets": CONTEXT_PACKETS_SQL,
}
