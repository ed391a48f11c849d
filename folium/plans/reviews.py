"""Queries of speakers and of promotion to the canon, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.operators import canon, speakers
from folium.sources import versions
from folium.sources.shared import shared_dir


def _read(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: A turn as a paragraph with speech, in one of twelve forms; the same expression in both dialects.
DIALOGUE = """CASE (conv_id + turn) % 12
    WHEN 0 THEN '"' || s || '," ' || a || ' said.'
    WHEN 1 THEN a || ' asked ' || b || ', "' || s || '?"'
    WHEN 2 THEN '“' || s || ',” said ' || b2 || ', while ' || a || ' replied softly.'
    WHEN 3 THEN '— ' || s || chr(10) || a || ' whispered «' || z || '» quietly.'
    WHEN 4 THEN 'She said, "' || s || '" and ' || a || ' left. "' || z || '"'
    WHEN 5 THEN '"' || s || '" "' || z || '" ' || a || ' cried.'
    WHEN 6 THEN a || ' said. Then it rained. "' || s || '"'
    WHEN 7 THEN '"' || s || '?" ' || a || ' asked ' || b || '.'
    WHEN 8 THEN '"' || s || '" ' || repeat('x ', 46 + turn % 4) || a2 || ' said.'
    WHEN 9 THEN '‘' || s || '’ answered ' || a2 || '. "' || b2 || ' said ' || z || '" it ended.'
    WHEN 10 THEN s || ' ' || a || ' said ' || z
    ELSE 'He said "' || s || ' and “' || z || '” ' || a || ' added' END"""


def _dialogue(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as paragraphs; suppliers are the characters, with a short name each."""
    pick = lambda step: F.expr(f"(conv_id * {step} + turn) % 10 + 1")
    turns = _read(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z ]", "")).alias("s"), F.trim(F.regexp_replace(F.substring("text", 41, 30), "[^A-Za-z ]", "")).alias("z"), pick(7).alias("i"), pick(3).alias("j"))
    supplier = lambda n: F.concat(F.lit("Supplier#"), F.lpad(F.col(n).cast("string"), 9, "0"))
    named = turns.withColumns({"a": supplier("i"), "b": supplier("j"), "a2": F.concat(F.lit("Sup"), F.col("i").cast("string")), "b2": F.concat(F.lit("Sup"), F.col("j").cast("string"))})
    paragraphs = named.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("paragraph"), F.expr(DIALOGUE).alias("text"))
    who = _read(spark, d, "supplier")
    return paragraphs, who.select(F.col("s_name").alias("name")), who.select(F.col("s_name").alias("canonical_name"), F.concat(F.lit("Sup"), F.col("s_suppkey").cast("string")).alias("alias"))


def speaker_cues(spark, d):
    return speakers.attribute(*_dialogue(spark, d))


def speaker_contexts(spark, d):
    return speakers.speaker_context(speaker_cues(spark, d))


def lexical_tokens(spark, d):
    return speakers.lexical_tokens(_dialogue(spark, d)[0])


def paragraph_quotes(spark, d):
    return speakers.quote_rows(_dialogue(spark, d)[0])


SPEECH_SQL = f"""
WITH turns AS (SELECT conv_id, turn, trim(regexp_replace(substring(text, 1, 40), '[^A-Za-z ]', '', 'g')) AS s, trim(regexp_replace(substring(text, 41, 30), '[^A-Za-z ]', '', 'g')) AS z, (conv_id * 7 + turn) % 10 + 1 AS i, (conv_id * 3 + turn) % 10 + 1 AS j FROM conversations),
named AS (SELECT *, 'Supplier#' || lpad(i::VARCHAR, 9, '0') AS a, 'Supplier#' || lpad(j::VARCHAR, 9, '0') AS b, 'Sup' || i AS a2, 'Sup' || j AS b2 FROM turns),
par AS (SELECT conv_id || '-' || turn AS paragraph, {DIALOGUE} AS t FROM named),
ch AS (SELECT paragraph, unnest(range(length(t))) AS i, unnest(string_split(t, '')) AS c FROM par),
even AS (SELECT paragraph, i, row_number() OVER (PARTITION BY paragraph ORDER BY i) AS r FROM ch WHERE c = '"'),
marks(style, o, e) AS (VALUES ('curly_double', '“', '”'), ('curly_single', '‘', '’'), ('guillemets', '«', '»')),
ends AS (SELECT style, paragraph, i, coalesce(lag(i) OVER (PARTITION BY style, paragraph ORDER BY i), -1) AS before FROM ch JOIN marks ON c = e),
begins AS (SELECT style, paragraph, i FROM ch JOIN marks ON c = o),
paired AS (SELECT x.paragraph, x.i + 1 AS qs, y.i AS qe, 'straight_double' AS style FROM even x JOIN even y ON x.paragraph = y.paragraph AND y.r = x.r + 1 AND x.r % 2 = 1
    UNION ALL SELECT e.paragraph, min(b.i) + 1, e.i, e.style FROM ends e JOIN begins b ON b.style = e.style AND b.paragraph = e.paragraph AND b.i > e.before AND b.i < e.i GROUP BY e.paragraph, e.i, e.style),
lines AS (SELECT paragraph, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY paragraph ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS ls FROM (SELECT paragraph, unnest(string_split(t, chr(10))) AS line, unnest(range(length(t) + 1)) AS k FROM par) WHERE line IS NOT NULL),
dashes AS (SELECT paragraph, ls + length(line) - length(regexp_replace(line, '^\\s*—\\s*', '')) AS qs, ls + length(line) AS qe, 'leading_dash' AS style FROM lines l
    WHERE regexp_matches(line, '^\\s*—\\s*\\S') AND NOT EXISTS (SELECT 1 FROM paired p WHERE p.paragraph = l.paragraph AND p.qs >= l.ls AND p.qe <= l.ls + length(l.line))),
quotes AS (SELECT paragraph, (row_number() OVER (PARTITION BY paragraph ORDER BY qs, qe) - 1)::INT AS quote_index, qs, qe, style, t[qs + 1 : qe] AS quote FROM (SELECT * FROM paired UNION ALL SELECT * FROM dashes) JOIN par USING (paragraph)),
flagged AS (SELECT paragraph, i, c, regexp_matches(c, '[\\p{{L}}\\p{{N}}''’-]') AS lex FROM ch),
runs AS (SELECT paragraph, min(i)::INT AS ts, (max(i) + 1)::INT AS te, string_agg(c, '' ORDER BY i) AS raw FROM (SELECT *, i - row_number() OVER (PARTITION BY paragraph ORDER BY i) AS g FROM flagged WHERE lex) GROUP BY paragraph, g),
tok AS (SELECT *, (row_number() OVER (PARTITION BY paragraph ORDER BY ts) - 1)::INT AS n FROM (SELECT *, trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM runs) WHERE norm <> '')"""

TOKENS_SQL = SPEECH_SQL + """
SELECT paragraph, n, raw, norm, ts AS "start", te AS "end", (SELECT min(i)::INT FROM ch WHERE ch.paragraph = tok.paragraph AND ch.i >= te AND c IN ('.', '!', '?', '؟')) AS stop FROM tok"""

QUOTES_SQL = SPEECH_SQL + """
SELECT paragraph, quote_index, qs::INT AS "start", qe::INT AS "end", style, quote FROM quotes"""

SPEAKERS = SPEECH_SQL + """,
verbs AS (SELECT unnest(string_split('say says said ask asks asked reply replies replied answer answers answered whisper whispers whispered murmur murmurs murmured mutter mutters muttered shout shouts shouted yell yells yelled cry cries cried exclaim exclaims exclaimed add adds added observe observes observed call calls called', ' ')) AS verb),
pat AS (SELECT s_name AS canonical, s_name AS mention, false AS alias, ['supplier', lpad(s_suppkey::VARCHAR, 9, '0')] AS w FROM supplier UNION ALL SELECT s_name, 'Sup' || s_suppkey, true, ['sup' || s_suppkey] FROM supplier),
listed AS (SELECT paragraph, list(norm ORDER BY n) AS norms, list(ts ORDER BY n) AS s, list(te ORDER BY n) AS e, list(raw ORDER BY n) AS raws FROM tok GROUP BY paragraph),
spot AS (SELECT paragraph, n, k FROM tok, (VALUES (1), (2)) x(k)),
hit AS (SELECT l.paragraph, p.canonical, p.mention, p.alias, len(p.w) AS size, l.s[n + 1] AS ms, l.e[n + k] AS me, n, k, l.norms, l.s, l.e, l.raws FROM spot JOIN listed l USING (paragraph) JOIN pat p ON p.w = l.norms[n + 1 : n + k]),
said AS (SELECT *, norms[n + k + 1] IN (SELECT verb FROM verbs) AS fore, CASE WHEN n > 0 THEN norms[n] IN (SELECT verb FROM verbs) ELSE false END AS aft FROM hit h
    WHERE NOT EXISTS (SELECT 1 FROM quotes q WHERE q.paragraph = h.paragraph AND h.ms >= q.qs AND h.me <= q.qe)),
cue AS (SELECT paragraph, canonical, mention, alias, size, ms, me, coalesce(fore, false) AS subj, CASE WHEN coalesce(fore, false) THEN s[n + k + 1] ELSE s[n] END AS vs, CASE WHEN coalesce(fore, false) THEN e[n + k + 1] ELSE e[n] END AS ve,
    CASE WHEN coalesce(fore, false) THEN mention || ' ' || raws[n + k + 1] ELSE raws[n] || ' ' || mention END AS evidence FROM said WHERE fore OR aft),
pro AS (SELECT t.paragraph, t.ts AS ms, t.te AS me, coalesce(l.norms[t.n + 2] IN (SELECT verb FROM verbs), false) AS subj, CASE WHEN t.n > 0 THEN l.norms[t.n] IN (SELECT verb FROM verbs) ELSE false END AS obj FROM tok t JOIN listed l USING (paragraph)
    WHERE t.norm IN ('he', 'she', 'they', 'i', 'we', 'you') AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.paragraph = t.paragraph AND t.ts >= q.qs AND t.te <= q.qe)),
near AS (SELECT q.quote_index, c.* FROM quotes q JOIN cue c USING (paragraph) WHERE (c.me <= q.qs AND q.qs - c.me <= 96 AND c.subj
        AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.paragraph = q.paragraph AND ch.i >= c.ve AND ch.i < q.qs AND ch.c IN ('.', '!', '?', '؟'))
        AND NOT EXISTS (SELECT 1 FROM quotes o WHERE o.paragraph = q.paragraph AND o.quote_index <> q.quote_index AND o.qs >= c.me AND o.qe <= q.qs))
    OR (c.ms >= q.qe AND c.ms - q.qe <= 96 AND NOT EXISTS (SELECT 1 FROM quotes o WHERE o.paragraph = q.paragraph AND o.quote_index <> q.quote_index AND o.qs >= q.qe AND o.qe <= c.ms))),
mute AS (SELECT DISTINCT q.paragraph, q.quote_index FROM quotes q JOIN pro c USING (paragraph) WHERE (c.me <= q.qs AND q.qs - c.me <= 96 AND c.subj AND NOT EXISTS (SELECT 1 FROM quotes o WHERE o.paragraph = q.paragraph AND o.quote_index <> q.quote_index AND o.qs >= c.me AND o.qe <= q.qs))
    OR (c.ms >= q.qe AND c.ms - q.qe <= 96 AND (c.subj OR c.obj) AND NOT EXISTS (SELECT 1 FROM quotes o WHERE o.paragraph = q.paragraph AND o.quote_index <> q.quote_index AND o.qs >= q.qe AND o.qe <= c.ms))),
left_over AS (SELECT * FROM near n WHERE subj OR NOT EXISTS (SELECT 1 FROM near m WHERE m.paragraph = n.paragraph AND m.quote_index = n.quote_index AND m.subj AND m.vs = n.vs)),
who AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paragraph, quote_index, canonical ORDER BY size DESC, mention, alias, ms) AS r FROM left_over) WHERE r = 1),
heard AS (SELECT paragraph, quote_index, count(*) AS people, any_value(canonical) AS canonical, any_value(mention) AS mention, any_value(alias) AS alias, any_value(evidence) AS evidence, string_agg(canonical, ' | ' ORDER BY lower(canonical)) AS everyone FROM who GROUP BY ALL),
answer AS (SELECT q.paragraph, q.quote_index, q.qs::INT AS "start", q.qe::INT AS "end", q.style, q.quote, CASE WHEN people = 1 THEN canonical END AS speaker, CASE WHEN people = 1 THEN h.mention END AS mention,
    CASE WHEN people = 1 AND h.alias THEN 'explicit_alias_speech_verb' WHEN people = 1 THEN 'explicit_name_speech_verb' WHEN people > 1 THEN 'ambiguous_explicit_candidates' WHEN m.paragraph IS NOT NULL THEN 'pronoun_speech_verb_unresolved' ELSE 'no_speaker_cue' END AS method,
    CASE WHEN people = 1 THEN h.evidence WHEN people > 1 THEN everyone END AS evidence
    FROM quotes q LEFT JOIN heard h USING (paragraph, quote_index) LEFT JOIN mute m USING (paragraph, quote_index))"""

CONTEXT_SQL = SPEAKERS + """
SELECT paragraph, 'SPEAKER MAP — deterministic explicit evidence only; unresolved dialogue is omitted:' || chr(10) || string_agg('- "' || trim(quote) || '" → ' || speaker || ' (' || method || ')', chr(10) ORDER BY quote_index) AS context
FROM answer WHERE speaker IS NOT NULL GROUP BY paragraph"""


def _promotion(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as reviewed items of all kinds, customers as the canon, and resolutions for two thirds of the items; some of them aren't allowed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 40 == 39, canon.LITERARY).when(k % 4 < 2, canon.TERMINOLOGY).when(k % 4 == 2, canon.RELATIONSHIP).otherwise(canon.CHARACTER)
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    o = _read(spark, d, "orders").withColumn("kind", kind)
    subject = F.when(F.col("kind") == canon.TERMINOLOGY, text("Term ", c)).when(F.col("kind") == canon.RELATIONSHIP, F.when(k % 8 == 2, text("Person ", c)).otherwise(text("person ", c + 1))).when(F.col("kind") == canon.CHARACTER, text("Person ", c)).otherwise(text("tone ", c))
    partner = F.when(F.col("kind") == canon.RELATIONSHIP, F.when(k % 8 == 2, text("Person ", c + 1)).otherwise(text("Person ", c))).when(F.col("kind") == canon.LITERARY, F.lit("tone"))
    aliases = F.when((F.col("kind") == canon.CHARACTER) & (k % 16 == 7), F.array(text("Nick ", F.floor(c / 2)), text("person ", c + 3), text("NICK ", F.floor(c / 2)))).when((F.col("kind") == canon.CHARACTER) & (k % 16 != 15), F.array(text("Nick ", F.floor(c / 2))))
    aliases = F.coalesce(aliases, F.array().cast("array<string>"))
    rank = F.substring("o_orderpriority", 1, 1)
    notes = F.when(F.col("kind") == canon.RELATIONSHIP, F.array(rank, F.when(k % 3 == 0, " ").otherwise(F.col("o_orderstatus")), F.lit(""))).when(F.col("kind") == canon.CHARACTER, F.array(rank, F.when(k % 5 == 0, "").otherwise(F.col("o_orderstatus")))).otherwise(F.array(rank, F.col("o_orderstatus")))
    status = F.when(k % 37 == 0, "applied").when(F.col("o_orderstatus") == "P", "pending").when(k % 2 == 0, "edited").otherwise("approved")
    items = o.select(k.alias("item_id"), "kind", (k % 3 + 1).cast("int").alias("revision"), status.alias("status"), F.when(k % 23 == 0, "obsolete").otherwise("active").alias("availability"), subject.alias("subject"), partner.alias("partner"), aliases.alias("aliases"), notes.alias("notes"), k.alias("o"), c.alias("c"))
    main = F.when(F.col("kind") == canon.CHARACTER, canon.PROFILE).when(F.col("kind") == canon.RELATIONSHIP, canon.CONTRADICTION).otherwise(canon.TRANSLATION)
    target = F.when(F.col("kind") == canon.RELATIONSHIP, canon.pair_target(F.col("subject"), F.col("partner"))).otherwise(F.col("subject"))
    ways = F.element_at(F.array(*map(F.lit, (canon.KEEP, canon.USE, canon.MERGE, canon.CANCEL, canon.USE, canon.KEEP))), (F.pmod(F.floor(F.col("o") / 4), F.lit(6)) + 1).cast("int"))
    given = items.filter("o % 3 <> 0").select(canon.conflict_id(F.col("item_id"), F.col("revision"), main, target).alias("conflict_id"), ways.alias("resolution"))
    clash = items.filter((F.col("kind") == canon.CHARACTER) & (F.col("o") % 5 < 3)).select("item_id", "revision", "o", F.explode("aliases").alias("alias"))
    given = given.unionByName(clash.select(canon.conflict_id(F.col("item_id"), F.col("revision"), canon.ALIAS, F.col("alias")).alias("conflict_id"), F.when(F.col("o") % 5 == 0, canon.CANCEL).otherwise(canon.KEEP).alias("resolution")))
    who = _read(spark, d, "customer")
    n = F.col("c_custkey")
    none = F.lit(None).cast("string")
    row = lambda kind, subject, partner, aliases, notes, position: (F.lit(kind).alias("kind"), subject.alias("subject"), partner.alias("partner"), aliases.alias("aliases"), F.array(*notes).alias("notes"), position.cast("long").alias("position"))
    empty = F.array().cast("array<string>")
    old = who.filter("c_custkey % 3 = 0").select(*row(canon.CHARACTER, text("Person ", n), none, F.when(n % 2 == 0, F.array(text("nick ", F.floor(n / 2)), text("Old ", n))).otherwise(empty), (F.lit("1"), F.when(n % 4 == 0, " ").otherwise("O")), n))
    old = old.unionByName(who.filter("c_custkey % 5 = 2").select(*row(canon.RELATIONSHIP, text("PERSON ", n + 1), text("Person ", n), empty, (F.lit("2"), F.lit("F"), F.lit("")), n)))
    old = old.unionByName(who.filter("c_custkey % 4 = 1").select(*row(canon.TERMINOLOGY, text("term ", n), none, empty, (F.lit("3"), F.lit("O")), n * 2)))
    old = old.unionByName(who.filter("c_custkey % 20 = 1").select(*row(canon.TERMINOLOGY, text("Term ", n), none, empty, (F.lit("4"), F.lit("F")), n * 2 + 1)))
    old = old.unionByName(who.filter("c_custkey % 20 = 9").select(*row(canon.TERMINOLOGY, text("TERM ", n), none, empty, (F.lit("3"), F.lit("O")), n * 2 + 1)))
    return items.drop("o", "c"), old, given


def _flat(value: str) -> Column:
    """A value in one line: names, aliases and notes."""
    parts = (F.col(f"{value}.subject"), F.coalesce(f"{value}.partner", F.lit("")), F.coalesce(F.array_join(f"{value}.aliases", ","), F.lit("")), F.coalesce(F.array_join(f"{value}.notes", ";"), F.lit("")))
    return F.when(F.col(value).isNotNull(), F.concat_ws("|", *parts))


def promotion_events(spark, d):
    """Operations and conflicts of promoting all approved and edited items, in the order of their ids."""
    events = canon.plan(*_promotion(spark, d))
    return events.select("item_id", "what", "action", "target", _flat("before").alias("before"), _flat("after").alias("after"), "conflict_id", "conflict", "severity", F.when(F.col("allowed").isNotNull(), F.array_join("allowed", ",")).alias("allowed"), "resolution", "refused")


def promotion_outcomes(spark, d):
    """What becomes of every item, those that nobody approved included."""
    items, old, given = _promotion(spark, d)
    return canon.outcomes(canon.plan(items, old, given, items), items)


def promoted_canon(spark, d):
    """The canon with the items that can be promoted, committed to a versioned table, twice, and read back from it."""
    items, old, given = _promotion(spark, d)
    chosen = items.filter(F.col("status").isin("approved", "edited") & (F.col("kind") != canon.LITERARY))
    events = versions.stored(canon.promotable(versions.stored(canon.plan(items, old, given)), chosen))
    store = versions.Store(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/canon-{uuid.uuid4().hex}")
    store.commit("start", None, {"canon": old})
    facts = canon.summary(events, store.read("canon")).first()
    for _ in range(2):  # the second time changes nothing
        store.commit(facts["plan_id"], {"canon": facts["canon_fingerprint"]}, {"canon": lambda: canon.apply(events, store.read("canon"))})
    return store.read("canon").select("kind", "subject", "partner", F.array_join("aliases", ",").alias("aliases"), F.array_join("notes", ";").alias("notes"))


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _flat_sql(subject: str, partner: str, aliases: str, notes: str) -> str:
    return f"{subject} || '|' || {partner} || '|' || {aliases} || '|' || array_to_string({notes}, ';')"


def _conflict_sql(kind: str, target: str) -> str:
    return f"'conflict-' || sha256(item_id || chr(0) || revision || chr(0) || {kind} || chr(0) || {target})"


#: The fold once more: a row for each step of each part, whose state is the canon so far.
PROMOTION_SQL = f"""
WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, substring(o_orderpriority, 1, 1) AS p,
    CASE WHEN k % 40 = 39 THEN 'literary' WHEN k % 4 < 2 THEN 'terminology' WHEN k % 4 = 2 THEN 'relationship' ELSE 'character' END AS kind FROM orders),
items AS (SELECT k AS item_id, kind, (k % 3 + 1)::INT AS revision, CASE WHEN k % 37 = 0 THEN 'applied' WHEN s = 'P' THEN 'pending' WHEN k % 2 = 0 THEN 'edited' ELSE 'approved' END AS status, k % 23 = 0 AS obsolete,
    CASE kind WHEN 'terminology' THEN 'Term ' || c WHEN 'relationship' THEN CASE WHEN k % 8 = 2 THEN 'Person ' || c ELSE 'person ' || (c + 1) END WHEN 'character' THEN 'Person ' || c ELSE 'tone ' || c END AS subject,
    CASE WHEN kind = 'relationship' THEN 'Person ' || CASE WHEN k % 8 = 2 THEN c + 1 ELSE c END WHEN kind = 'literary' THEN 'tone' END AS partner,
    CASE WHEN kind <> 'character' OR k % 16 = 15 THEN [] WHEN k % 16 = 7 THEN ['Nick ' || c // 2, 'person ' || (c + 3), 'NICK ' || c // 2] ELSE ['Nick ' || c // 2] END::VARCHAR[] AS aliases,
    CASE kind WHEN 'relationship' THEN [p, CASE WHEN k % 3 = 0 THEN ' ' ELSE s END, ''] WHEN 'character' THEN [p, CASE WHEN k % 5 = 0 THEN '' ELSE s END] ELSE [p, s] END AS notes,
    CASE WHEN k % 3 <> 0 THEN ['keep_canon', 'use_reviewed_proposal', 'merge', 'cancel_promotion', 'use_reviewed_proposal', 'keep_canon'][(k // 4) % 6 + 1] END AS way,
    CASE WHEN k % 5 = 0 THEN 'cancel_promotion' WHEN k % 5 < 3 THEN 'keep_canon' END AS alias_way FROM o),
ready AS (SELECT * FROM items WHERE status IN ('approved', 'edited') AND kind <> 'literary' AND NOT obsolete),
t_items AS (SELECT *, {_key('subject')} AS part, row_number() OVER (PARTITION BY {_key('subject')} ORDER BY item_id) AS i FROM ready WHERE kind = 'terminology'),
t_canon AS (SELECT 'term ' || c_custkey AS subject, '3' AS tr, 'O' AS cx, c_custkey * 2 AS pos FROM customer WHERE c_custkey % 4 = 1
    UNION ALL SELECT 'Term ' || c_custkey, '4', 'F', c_custkey * 2 + 1 FROM customer WHERE c_custkey % 20 = 1 UNION ALL SELECT 'TERM ' || c_custkey, '3', 'O', c_custkey * 2 + 1 FROM customer WHERE c_custkey % 20 = 9),
t_base AS (SELECT part, list({{'s': subject, 'tr': tr, 'cx': cx}} ORDER BY pos) FILTER (subject IS NOT NULL) AS ent FROM (SELECT DISTINCT part FROM t_items) LEFT JOIN (SELECT *, {_key('subject')} AS part FROM t_canon) USING (part) GROUP BY part),
t_rec AS (SELECT part, 0::BIGINT AS i, coalesce(ent, []) AS ent, NULL::BIGINT AS item_id, NULL::INT AS revision, NULL::VARCHAR AS subject, false AS cf, false AS split, NULL::VARCHAR AS way, NULL::VARCHAR AS taken, NULL::VARCHAR AS act, NULL::STRUCT(s VARCHAR, tr VARCHAR, cx VARCHAR) AS b, NULL::STRUCT(s VARCHAR, tr VARCHAR, cx VARCHAR) AS a FROM t_base
    UNION ALL SELECT part, i, CASE WHEN act IS NULL OR (len(ent) = 1 AND {_key('b.tr')} = {_key('a.tr')} AND b.cx = a.cx) THEN ent ELSE [a] END, item_id, revision, subject, cf, split, way, taken, act, b, a FROM (
        SELECT *, CASE WHEN b IS NULL THEN 'insert' WHEN NOT cf OR taken = 'keep_canon' THEN 'keep_canon' WHEN taken = 'use_reviewed_proposal' THEN 'replace' END AS act, CASE WHEN taken = 'keep_canon' THEN b ELSE v END AS a FROM (
        SELECT *, CASE WHEN cf AND (way IN ('use_reviewed_proposal', 'cancel_promotion') OR (way = 'keep_canon' AND NOT split)) THEN way END AS taken FROM (
        SELECT *, b IS NOT NULL AND (split OR {_key('b.tr')} <> {_key('v.tr')} OR b.cx <> v.cx) AS cf FROM (
        SELECT r.part, x.i, r.ent, x.item_id, x.revision, x.subject, x.way, r.ent[1] AS b, len(list_distinct(list_transform(r.ent, lambda e: e.tr))) > 1 AS split, {{'s': x.subject, 'tr': x.notes[1], 'cx': x.notes[2]}} AS v
        FROM t_rec r JOIN t_items x ON x.part = r.part AND x.i = r.i + 1))))),
r_items AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY item_id) AS i FROM (SELECT *, least({_key('subject')}, {_key('partner')}) || '↔' || greatest({_key('subject')}, {_key('partner')}) AS part FROM ready WHERE kind = 'relationship')),
r_canon AS (SELECT least('person ' || c_custkey, 'person ' || (c_custkey + 1)) || '↔' || greatest('person ' || c_custkey, 'person ' || (c_custkey + 1)) AS part, {{'s': 'PERSON ' || (c_custkey + 1), 'p': 'Person ' || c_custkey, 'n': ['2', 'F', '']}} AS v FROM customer WHERE c_custkey % 5 = 2),
r_rec AS (SELECT part, 0::BIGINT AS i, v AS b, v AS st, NULL::BIGINT AS item_id, NULL::INT AS revision, NULL::VARCHAR AS target, false AS cf, NULL::VARCHAR AS way, NULL::VARCHAR AS act, v AS a FROM (SELECT DISTINCT part FROM r_items) LEFT JOIN r_canon USING (part)
    UNION ALL SELECT part, i, b, CASE WHEN act IS NULL THEN b ELSE a END, item_id, revision, target, cf, way, act, a FROM (
        SELECT *, CASE WHEN b IS NULL THEN 'insert' WHEN NOT cf OR way = 'keep_canon' THEN 'keep_canon' WHEN way = 'use_reviewed_proposal' THEN 'replace' WHEN way = 'merge' THEN 'merge' END AS act,
            CASE WHEN b IS NULL OR (cf AND way = 'use_reviewed_proposal') THEN v WHEN cf AND way = 'merge' THEN {{'s': b.s, 'p': b.p, 'n': list_transform([1, 2, 3], lambda j: CASE WHEN trim(b.n[j]) = '' THEN v.n[j] WHEN trim(v.n[j]) = '' OR b.n[j] = v.n[j] THEN b.n[j] ELSE trim(b.n[j]) || '; ' || trim(v.n[j]) END)}} ELSE b END AS a FROM (
        SELECT *, b IS NOT NULL AND b.n <> v.n AS cf FROM (
        SELECT r.part, x.i, r.st AS b, x.item_id, x.revision, x.subject || '↔' || x.partner AS target, x.way, {{'s': x.subject, 'p': x.partner, 'n': x.notes}} AS v FROM r_rec r JOIN r_items x ON x.part = r.part AND x.i = r.i + 1)))),
c_items AS (SELECT *, {_key('subject')} AS sk, list_transform(aliases, lambda x: {{'a': x, 'k': lower(x)}}) AS mine FROM ready WHERE kind = 'character'),
c_canon AS (SELECT 'Person ' || c_custkey AS subject, 'person ' || c_custkey AS sk, ['1', CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'O' END] AS notes, CASE WHEN c_custkey % 2 = 0 THEN ['nick ' || c_custkey // 2, 'Old ' || c_custkey] ELSE [] END::VARCHAR[] AS aliases, c_custkey AS pos FROM customer WHERE c_custkey % 3 = 0),
edges AS (SELECT sk AS a, unnest(list_append(list_transform(aliases, lambda x: lower(x)), sk)) AS b FROM (SELECT sk, aliases FROM c_items UNION ALL SELECT sk, aliases FROM c_canon)),
both_ways AS (SELECT DISTINCT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
part_of AS (SELECT a AS sk, min(b) AS part FROM reach GROUP BY a),
c_seq AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY item_id) AS i FROM c_items JOIN part_of USING (sk)),
c_base AS (SELECT part, list({{'k': sk, 's': subject, 'n': notes}} ORDER BY pos) AS prof, flatten(list(list_transform(aliases, lambda x: {{'o': sk, 'a': x, 'k': lower(x)}}) ORDER BY pos)) AS ali FROM c_canon JOIN part_of USING (sk) GROUP BY part),
c_rec AS (SELECT part, 0::BIGINT AS i, coalesce(prof, []) AS prof, coalesce(ali, []) AS ali, NULL::BIGINT AS item_id, NULL::INT AS revision, NULL::VARCHAR AS subject, NULL::VARCHAR AS sk, false AS ident, NULL::VARCHAR AS owner, false AS differ, NULL::VARCHAR AS way, NULL::VARCHAR AS act, NULL::VARCHAR AS b, NULL::VARCHAR AS a, []::STRUCT(a VARCHAR, k VARCHAR, o VARCHAR, w VARCHAR, n VARCHAR)[] AS clash, false AS fin
    FROM (SELECT DISTINCT part FROM c_seq) LEFT JOIN c_base USING (part)
    UNION ALL SELECT part, i, CASE WHEN NOT fin THEN prof WHEN me IS NULL THEN list_append(prof, {{'k': sk, 's': fs, 'n': fn}}) ELSE list_transform(prof, lambda p: CASE WHEN p.k = sk THEN {{'k': sk, 's': fs, 'n': fn}} ELSE p END) END,
        CASE WHEN NOT fin OR list_sort(list_transform(acc, lambda x: x.k)) = list_sort(list_transform(cur, lambda x: x.k)) THEN ali ELSE list_concat(list_filter(ali, lambda x: x.o <> sk), list_transform(acc, lambda x: {{'o': sk, 'a': x.a, 'k': x.k}})) END,
        item_id, revision, subject, sk, ident, owner, differ, way, act, b, {_flat_sql('fs', "''", "array_to_string(list_transform(acc, lambda x: x.a), ',')", 'fn')}, clash, fin FROM (
        SELECT *, go AND len(list_filter(clash, lambda x: x.w IS NULL OR x.w = 'cancel_promotion')) = 0 AS fin FROM (
        SELECT *, CASE WHEN go THEN list_filter(cand, lambda x: x.o IS NOT NULL AND x.o <> sk) ELSE [] END AS clash, list_filter(cand, lambda x: x.o IS NULL OR x.o = sk) AS acc FROM (
        SELECT *, list_transform(list_filter(fa, lambda x, j: x.k <> sk AND list_position(list_transform(fa, lambda y: y.k), x.k) = j), lambda x: {{'a': x.a, 'k': x.k,
            'o': CASE WHEN len(list_filter(prof, lambda p: p.k = x.k)) > 0 THEN x.k ELSE list_filter(ali, lambda y: y.k = x.k)[1].o END,
            'w': CASE WHEN list_contains(aliases, x.a) THEN alias_way END,
            'n': coalesce(list_filter(prof, lambda p: p.k = CASE WHEN len(list_filter(prof, lambda q: q.k = x.k)) > 0 THEN x.k ELSE list_filter(ali, lambda y: y.k = x.k)[1].o END)[1].s, '')}}) AS cand FROM (
        SELECT *, NOT ident AND (NOT differ OR coalesce(way, 'cancel_promotion') <> 'cancel_promotion') AS go,
            CASE WHEN me IS NULL THEN 'insert' WHEN NOT differ OR way = 'keep_canon' THEN 'keep_canon' WHEN way = 'use_reviewed_proposal' THEN 'replace' ELSE way END AS act,
            CASE WHEN me IS NULL OR (differ AND way = 'use_reviewed_proposal') THEN subject ELSE me.s END AS fs,
            CASE WHEN me IS NULL OR (differ AND way = 'use_reviewed_proposal') THEN notes WHEN differ AND way = 'merge' THEN list_transform([1, 2], lambda j: CASE WHEN trim(me.n[j]) = '' THEN notes[j] ELSE me.n[j] END) ELSE me.n END AS fn,
            CASE WHEN me IS NULL OR (differ AND way = 'use_reviewed_proposal') THEN mine WHEN differ AND way = 'merge' THEN list_concat(held, mine) ELSE held END AS fa,
            CASE WHEN me IS NOT NULL THEN {_flat_sql('me.s', "''", "array_to_string(list_transform(cur, lambda x: x.a), ',')", 'me.n')} END AS b FROM (
        SELECT *, own IS NOT NULL AND own <> sk AS ident, list_filter(prof, lambda p: p.k = own)[1].s AS owner,
            me IS NOT NULL AND (list_sort(list_distinct(list_transform(mine, lambda x: x.k))) <> list_sort(list_transform(cur, lambda x: x.k)) OR me.n <> notes) AS differ FROM (
        SELECT *, CASE WHEN me IS NOT NULL THEN sk ELSE list_filter(ali, lambda x: x.k = sk)[1].o END AS own, list_transform(cur, lambda x: {{'a': x.a, 'k': x.k}}) AS held FROM (
        SELECT r.part, x.i, r.prof, r.ali, x.item_id, x.revision, x.subject, x.sk, x.notes, x.aliases, x.mine, x.way, x.alias_way, list_filter(r.prof, lambda p: p.k = x.sk)[1] AS me, list_filter(r.ali, lambda y: y.o = x.sk) AS cur
        FROM c_rec r JOIN c_seq x ON x.part = r.part AND x.i = r.i + 1)))))))),
events AS (SELECT item_id, 'conflict' AS what, NULL AS action, subject AS target, {_flat_sql('b.s', "''", "''", '[b.tr, b.cx]')} AS before, NULL AS after, {_conflict_sql("'GlossaryTranslation'", 'subject')} AS conflict_id, 'GlossaryTranslation' AS conflict, 'blocking' AS severity,
        CASE WHEN split THEN 'use_reviewed_proposal,cancel_promotion' ELSE 'keep_canon,use_reviewed_proposal,cancel_promotion' END AS allowed, taken AS resolution, way IS NOT NULL AND taken IS NULL AS refused FROM t_rec WHERE cf
    UNION ALL SELECT item_id, 'operation', act, 'glossary:' || part, {_flat_sql('b.s', "''", "''", '[b.tr, b.cx]')}, {_flat_sql('a.s', "''", "''", '[a.tr, a.cx]')}, NULL, NULL, NULL, NULL, NULL, false FROM t_rec WHERE act IS NOT NULL
    UNION ALL SELECT item_id, 'conflict', NULL, target, {_flat_sql('b.s', 'b.p', "''", 'b.n')}, NULL, {_conflict_sql("'RelationshipContradiction'", 'target')}, 'RelationshipContradiction', 'blocking', 'keep_canon,use_reviewed_proposal,merge,cancel_promotion', way, false FROM r_rec WHERE cf
    UNION ALL SELECT item_id, 'operation', act, 'relationship:' || part, {_flat_sql('b.s', 'b.p', "''", 'b.n')}, {_flat_sql('a.s', 'a.p', "''", 'a.n')}, NULL, NULL, NULL, NULL, NULL, false FROM r_rec WHERE act IS NOT NULL
    UNION ALL SELECT item_id, 'conflict', NULL, subject, {_flat_sql('owner', "''", 'subject', "['']")}, NULL, {_conflict_sql("'CharacterIdentity'", 'subject')}, 'CharacterIdentity', 'blocking', 'cancel_promotion', NULL, false FROM c_rec WHERE ident
    UNION ALL SELECT item_id, 'conflict', NULL, subject, b, NULL, {_conflict_sql("'CharacterProfile'", 'subject')}, 'CharacterProfile', 'blocking', 'keep_canon,use_reviewed_proposal,merge,cancel_promotion', way, false FROM c_rec WHERE differ
    UNION ALL SELECT item_id, 'conflict', NULL, x.a, {_flat_sql('x.n', "''", 'x.a', "['']")}, NULL, {_conflict_sql("'CharacterAliasCollision'", 'x.a')}, 'CharacterAliasCollision', 'blocking', 'keep_canon,cancel_promotion', x.w, false FROM (SELECT item_id, revision, unnest(clash) AS x FROM c_rec)
    UNION ALL SELECT item_id, 'operation', act, 'character:' || sk, b, a, NULL, NULL, NULL, NULL, NULL, false FROM c_rec WHERE fin
    UNION ALL SELECT item_id, 'conflict', NULL, item_id::VARCHAR, NULL, NULL, {_conflict_sql("'StaleProposal'", 'item_id')}, 'StaleProposal', 'blocking', 'cancel_promotion', NULL, false FROM items WHERE status IN ('approved', 'edited') AND kind <> 'literary' AND obsolete)"""

EVENTS_SQL = PROMOTION_SQL + """
SELECT * FROM events"""

OUTCOMES_SQL = PROMOTION_SQL + """
SELECT item_id, CASE WHEN status = 'applied' THEN 'applied' WHEN obsolete THEN 'blocked' WHEN status = 'pending' THEN 'refused' WHEN kind = 'literary' THEN 'blocked' WHEN bool_or(coalesce(e.refused, false)) THEN 'refused'
    WHEN bool_or(coalesce(e.resolution = 'cancel_promotion', false)) THEN 'cancelled' WHEN bool_or(coalesce(e.severity = 'blocking' AND e.resolution IS NULL, false)) THEN 'blocked' ELSE 'promoted' END AS outcome
FROM items LEFT JOIN events e USING (item_id) GROUP BY item_id, status, obsolete, kind"""

#: The last state of every part, and the canon rows that no item touches.
CANON_SQL = PROMOTION_SQL + f"""
, t_end AS (SELECT part, arg_max(a, item_id) AS a FROM t_rec WHERE act IS NOT NULL GROUP BY part), r_end AS (SELECT part, arg_max(a, item_id) AS a FROM r_rec WHERE act IS NOT NULL GROUP BY part), c_end AS (SELECT sk, arg_max(a, item_id) AS a FROM c_rec WHERE fin GROUP BY sk)
SELECT 'terminology' AS kind, a.s AS subject, NULL AS partner, NULL AS aliases, a.tr || ';' || a.cx AS notes FROM t_end
UNION ALL SELECT 'terminology', subject, NULL, '', tr || ';' || cx FROM t_canon WHERE {_key('subject')} NOT IN (SELECT part FROM t_end)
UNION ALL SELECT 'relationship', a.s, a.p, NULL, array_to_string(a.n, ';') FROM r_end UNION ALL SELECT 'relationship', v.s, v.p, '', array_to_string(v.n, ';') FROM r_canon WHERE part NOT IN (SELECT part FROM r_end)
UNION ALL SELECT 'character', string_split(a, '|')[1], NULL, string_split(a, '|')[3], string_split(a, '|')[4] FROM c_end UNION ALL SELECT 'character', subject, NULL, array_to_string(aliases, ','), array_to_string(notes, ';') FROM c_canon WHERE sk NOT IN (SELECT sk FROM c_end)"""

QUERIES = (speaker_cues, speaker_contexts, lexical_tokens, paragraph_quotes, promotion_events, promotion_outcomes, promoted_canon)
ORACLES = {
    "speaker_cues": SPEAKERS + " SELECT * FROM answer", "speaker_contexts": CONTEXT_SQL, "lexical_tokens": TOKENS_SQL, "paragraph_quotes": QUOTES_SQL,
    "promotion_events": EVENTS_SQL, "promotion_outcomes": OUTCOMES_SQL, "promoted_canon": CANON_SQL,
}
