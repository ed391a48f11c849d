"""DuckDB SQL for the registered queries; columns have the names that the queries give them."""

from __future__ import annotations

from folium.functions.text import CONTRACTIONS, NAME_STOPWORDS, NEGATION_STARTS, NEGATIONS
from folium.operators.quality import LEAKS

quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(x: str) -> str:
    out = f"replace(lower({x}), '’', '''')"
    for a, b in CONTRACTIONS:
        out = f"replace({out}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return f"trim(regexp_replace(translate({out}, 'يىك', 'ییک'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


def negated(x: str) -> str:
    starts = " OR ".join(f"starts_with(x, '{s}')" for s in NEGATION_STARTS)
    return f"len(list_filter({toks(x)}, lambda x: x IN ({quoted(NEGATIONS)}) OR {starts})) > 0"


def words(x: str) -> str:
    edge = r"^[^\p{L}\p{N}''’-]+|[^\p{L}\p{N}''’-]+$"
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\s+'), lambda x: regexp_replace(x, '{edge}', '', 'g')), lambda x: x <> '')"


def simil(a: str, b: str) -> str:
    ta, tb = f"list_distinct({toks(a)})", f"list_distinct({toks(b)})"
    both = f"len(list_intersect({ta}, {tb}))"
    jac = f"coalesce({both}::DOUBLE / nullif(len({ta}) + len({tb}) - {both}, 0), 0)"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, ({jac} + CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.2::DOUBLE ELSE 0 END) "
        f"* CASE WHEN ({negated(a)}) = ({negated(b)}) THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END) END"
    )


LINES = "lines AS (SELECT doc_id, source, lang, unnest(range(0, len(a)))::INT AS pos, unnest(a) AS line FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS a FROM documents))"
CONVENTIONS = "array_to_string(list_filter([CASE WHEN regexp_matches(trim(line), '^[\"“]') THEN 'double_quotes' END, CASE WHEN regexp_matches(trim(line), '^[''‘]') THEN 'single_quotes' END, CASE WHEN regexp_matches(trim(line), '^[—-]') THEN 'leading_dash' END, CASE WHEN regexp_matches(trim(line), '[«»]') THEN 'guillemets' END], lambda x: x IS NOT NULL), ',')"
FACTS = f"""{LINES}, facts AS (SELECT doc_id, source, lang, pos, length(line) AS n_chars, len({words('line')})::INT AS n_words, greatest(len(regexp_extract_all(line, '[.!?؟]')), 1)::INT AS n_sentences, {CONVENTIONS} AS conventions,
    {CONVENTIONS} <> '' AS is_dialogue FROM lines WHERE trim(line) <> '')"""


def profile(by: str) -> str:
    return f"""WITH {FACTS}, marks AS (SELECT {by}, string_agg(DISTINCT m, ',' ORDER BY m) AS conventions FROM (SELECT {by}, unnest(string_split(conventions, ',')) AS m FROM facts) WHERE m <> '' GROUP BY ALL)
    SELECT {by}, count(*) AS n_paragraphs, sum(n_chars)::BIGINT AS n_chars, sum(n_words)::BIGINT AS n_words, sum(n_sentences)::BIGINT AS n_sentences, coalesce(round(sum(n_words)::DOUBLE / nullif(sum(n_sentences), 0), 6), 0) AS sentence_words,
        round(avg(is_dialogue::INT::DOUBLE), 6) AS dialogue_density, round(1 - avg(is_dialogue::INT::DOUBLE), 6) AS prose_density, coalesce(any_value(marks.conventions), '') AS conventions
    FROM facts LEFT JOIN marks USING ({by}) GROUP BY {by}"""


HTML = "html"
HTML = f"regexp_replace({HTML}, '</?(p|div|br|h[1-6]|li)(\\s[^>]*)?/?>', chr(10), 'gi')"
HTML = f"regexp_replace({HTML}, '<[^>]*>', '', 'g')"
for _a, _b in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "''''"), ("&#39;", "''''"), ("&amp;", "'&'")):
    HTML = f"replace({HTML}, '{_a}', {_b})"
HTML = f"array_to_string(list_filter(list_transform(string_split({HTML}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"

PHRASE_TOKENS = f"list_filter(list_transform({words('text')}, lambda y: {norm('y')}), lambda y: y <> '')"
CONF = "CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'moderate' ELSE 'low' END"
TERMS = f"terms AS (SELECT item_id, trim(array_to_string(({toks(norm('text'))})[3:4], ' ')) AS term FROM benchmark)"
HITS = f"{TERMS}, hits AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, ' ' || {norm('text')} || ' ' AS t FROM documents) d JOIN terms ON term <> '' AND contains(t, ' ' || term || ' '))"
PAIRS = "pairs AS (SELECT q.conv_id, q.turn, q.text AS source, a.text AS output FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"
DENSE = lambda x: f"length(regexp_replace({x}, '\\s+', '', 'g'))"
BLOCKS = lambda x: f"len(list_filter(string_split({x}, chr(10) || chr(10)), lambda x: trim(x) <> ''))"
NUMBERED = """first AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5),
second AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5)"""
LEDGER = """old AS (SELECT o_orderpriority AS kind, o_orderkey AS subject_key, o_orderstatus AS old_fp, 1 AS revision, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, o_orderkey % 7 <> 0 AS was_active FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderpriority AS kind, o_orderkey AS subject_key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS new_fp, o_orderkey % 11 = 0 AS canonical FROM orders WHERE o_orderkey % 4 <> 0)"""
REVIEWS = "reviews AS (SELECT event_id % 500 AS case_id, user_id AS reviewer_id, CASE event_type WHEN 'click' THEN 'system-a' WHEN 'view' THEN 'system-b' WHEN 'error' THEN 'defer' ELSE 'tie' END AS preferred FROM events)"
ANCHORS = f"""items AS (SELECT item_id, {toks(norm('text'))} AS w, text FROM benchmark),
anchors AS (SELECT item_id AS case_id, 'a1' AS anchor_id, 'terms' AS dimension, 'all_present' AS mode, w[1:2] AS vals FROM items UNION ALL SELECT item_id, 'a2', 'voice', 'any_present', ['zzz', w[5]] FROM items UNION ALL SELECT item_id, 'a3', 'voice', 'all_absent', [w[-1]] FROM items),
outputs AS (SELECT item_id AS case_id, {norm("CASE WHEN item_id % 3 = 0 THEN replace(text, 'e', 'o') ELSE text END")} AS t FROM benchmark WHERE item_id % 7 <> 0),
results AS (SELECT case_id, anchor_id, dimension, t IS NOT NULL AND CASE mode WHEN 'all_present' THEN len(list_filter(vals, lambda x: contains(t, x))) = len(vals) WHEN 'any_present' THEN len(list_filter(vals, lambda x: contains(t, x))) > 0 ELSE len(list_filter(vals, lambda x: contains(t, x))) = 0 END AS passed FROM anchors LEFT JOIN outputs USING (case_id))"""


#: The state machine of a reviewed item, written out: open items take any verdict, closed ones only go back.
REPLAY = """WITH RECURSIVE d AS (SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, ['approve', 'edit', 'reject', 'defer', 'reopen', 'apply'][1 + (event_id // 7) % 6] AS action,
        event_id % 13 <> 0 AND event_id % 17 <> 0 AS sound, event_id % 4 <> 0 AS has_value FROM events),
    s AS (SELECT DISTINCT item_id, 0::BIGINT AS k, 'pending' AS status, 0 AS applied, 0 AS invalid FROM d UNION ALL
        SELECT item_id, k, coalesce(to_, status), applied + (to_ IS NOT NULL)::INT, invalid + (to_ IS NULL)::INT FROM (SELECT s.item_id, d.k, s.status, s.applied, s.invalid,
            CASE WHEN NOT sound THEN NULL
                WHEN status IN ('pending', 'deferred') AND action = 'approve' THEN 'approved' WHEN status IN ('pending', 'deferred') AND action = 'edit' AND has_value THEN 'edited'
                WHEN status IN ('pending', 'deferred') AND action = 'reject' THEN 'rejected' WHEN status = 'pending' AND action = 'defer' THEN 'deferred'
                WHEN status IN ('approved', 'edited', 'rejected') AND action = 'reopen' THEN 'pending' END AS to_
            FROM s JOIN d ON d.item_id = s.item_id AND d.k = s.k + 1))
    SELECT item_id, status, applied, invalid FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC) = 1"""


def gate() -> str:
    n = norm("output")
    leaks = ", ".join(f"CASE WHEN contains({n}, '{m}') THEN 'leak:{m}' END" for m in LEAKS)
    ratio = f"{DENSE('output')}::DOUBLE / nullif({DENSE('source')}, 0)"
    both = "trim(source) <> '' AND trim(output) <> ''"
    two = lambda x: f"trim(array_to_string(({toks(norm(x))})[2:3], ' '))"
    return f"""WITH {PAIRS}, terms AS (SELECT st, min(pt) AS pt FROM (SELECT {two('source')} AS st, {two('output')} AS pt FROM pairs WHERE conv_id % 3 = 0) WHERE st <> '' GROUP BY st),
    lacking AS (SELECT conv_id, turn, list_sort(list('term:' || st)) AS terms FROM (SELECT conv_id, turn, ' ' || {norm('source')} || ' ' AS s, ' ' || {norm('output')} || ' ' AS o FROM pairs) JOIN terms ON contains(s, ' ' || st || ' ') AND pt <> '' AND NOT contains(o, ' ' || pt || ' ') GROUP BY ALL),
    g AS (SELECT conv_id, turn,
        list_filter([CASE WHEN trim(source) = '' THEN 'empty_source' END, CASE WHEN trim(output) = '' THEN 'empty_output' END, {leaks}, CASE WHEN {both} AND {ratio} < 0.20 THEN 'truncated' END], lambda x: x IS NOT NULL) AS b,
        list_filter([CASE WHEN {both} AND {ratio} > 5.0 THEN 'expanded' END, CASE WHEN {both} AND {BLOCKS('source')} >= 4 AND {BLOCKS('output')} * 2 < {BLOCKS('source')} THEN 'paragraphs_collapsed' END], lambda x: x IS NOT NULL) || coalesce(terms, []) AS w FROM pairs LEFT JOIN lacking USING (conv_id, turn))
    SELECT conv_id, turn, array_to_string(b, ',') AS blocking, array_to_string(w, ',') AS warnings, round(greatest(0::DOUBLE, 1::DOUBLE - len(b) * 0.5::DOUBLE - len(w) * 0.1::DOUBLE), 6) AS score, len(b) = 0 AS passes FROM g"""


def scores() -> str:
    size = f"least(greatest(len({toks('s')}) * 2, 4), 24)"
    win = f"list_max(list_transform(range(1, greatest(len({toks('q')}) - {size}, 0) + 2), lambda i: {simil('array_to_string((' + toks('q') + ')[i : i + ' + size + ' - 1], chr(32))', 's')}))"
    whole = f"greatest({simil('q', 's')}, list_max(list_transform(parts, lambda p: {simil('p', 's')})))"
    src = f"CASE WHEN len({toks('q')}) > {size} THEN greatest({whole}, {win}) ELSE {whole} END"
    return f"""q AS (SELECT item_id AS query_id, {norm('text')} AS q, list_transform(regexp_split_to_array(text, '[.!?…;:\\n\\r]'), lambda y: {norm('y')}) AS parts FROM benchmark WHERE item_id % 20 = 0),
    m AS (SELECT item_id AS entry_id, text AS source, text AS translation, {norm('text')} AS s FROM benchmark),
    scores AS (SELECT query_id, entry_id, source, translation, round(least(1.0::DOUBLE, {src} + CASE WHEN q = s THEN 0.3::DOUBLE ELSE 0 END), 6) AS score FROM q, m WHERE q <> '')"""


ORACLES: dict[str, str] = {
    "normalize_text": f"WITH n AS (SELECT doc_id, {norm('text')} AS t, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g'), '\\s+', ' ', 'g')) AS i FROM documents) SELECT doc_id, sha256(t) AS normalized_sha, len({toks('t')})::INT AS n_tokens, {negated('t')} AS negated, sha256(i) AS identity_sha FROM n",
    "similarity_pairs": f"WITH n AS (SELECT item_id, {norm('text')} AS t FROM benchmark) SELECT a, round({simil('ta', 'tb')}, 6) AS similarity FROM (SELECT x.item_id AS a, x.t AS ta, y.t AS tb FROM n x JOIN n y ON y.item_id = x.item_id + 1)",
    "paragraph_facts": f"WITH {FACTS} SELECT doc_id, pos, n_words, n_sentences, conventions, is_dialogue FROM facts",
    "observed_profile": profile("lang"),
    "chapter_map": profile("source, doc_id"),
    "chapter_samples": f"""WITH c AS ({profile('source, doc_id')}), r AS (SELECT source AS book, doc_id AS position, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS l, row_number() OVER (PARTITION BY source ORDER BY dialogue_density DESC, doc_id) AS t, dialogue_density AS d FROM c)
        SELECT book, position, array_to_string(list_filter([CASE WHEN i = 0 THEN 'first' END, CASE WHEN i = n // 2 THEN 'middle' END, CASE WHEN i = n - 1 THEN 'last' END, CASE WHEN l = 1 THEN 'longest' END, CASE WHEN t = 1 AND d > 0 THEN 'dialogue' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r WHERE reasons <> ''""",
    "chapter_sessions": "WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS session FROM conversations) SELECT conv_id, session, count(*) AS n_turns, min(turn) AS first_turn, sum(length(text))::BIGINT AS n_chars FROM s GROUP BY ALL",
    "html_pages": f"SELECT page_id, sha256({HTML}) AS text_sha, length({HTML})::INT AS n_chars FROM pages",
    "recurring_phrases": f"""WITH t AS (SELECT doc_id, {PHRASE_TOKENS} AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM t),
        k AS (SELECT phrase, doc_id, count(*) AS c FROM g WHERE len(list_filter(string_split(phrase, ' '), lambda x: x NOT IN ({quoted(NAME_STOPWORDS)}))) > 0 GROUP BY ALL),
        a AS (SELECT phrase, sum(c)::BIGINT AS n, count(*) AS n_docs, min(doc_id) AS first_doc, array_to_string(list_sort(list(doc_id))[1:8], ',') AS evidence FROM k GROUP BY phrase)
        SELECT *, {CONF} AS confidence FROM a WHERE n >= 3""",
    "cooccurrence": f"""WITH {LINES}, m AS (SELECT DISTINCT doc_id, pos, name FROM (SELECT doc_id, pos, unnest(regexp_extract_all(line, '[A-Z][a-z]{{5,}}')) AS name FROM lines WHERE trim(line) <> '')), o AS (SELECT name FROM m GROUP BY name HAVING count(DISTINCT doc_id) >= 5), k AS (SELECT doc_id * 1000000 + pos AS unit, name FROM m JOIN o USING (name))
        SELECT x.name AS a, y.name AS b, count(*) AS n, array_to_string(list_sort(list(x.unit))[1:8], ',') AS evidence FROM k x JOIN k y ON x.unit = y.unit AND x.name < y.name GROUP BY ALL HAVING n >= 2""",
    "merged_names": """WITH f AS (SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1), w AS (SELECT unnest(string_split(lower(p_name), ' ')) AS name FROM part), s AS (SELECT name, count(*) AS n FROM w GROUP BY 1), u AS (SELECT * FROM f UNION ALL SELECT * FROM s),
        l AS (SELECT name AS full_, unnest(list_distinct(string_split(name, ' '))) AS name FROM u WHERE contains(name, ' ')), h AS (SELECT u.name, min(full_) AS full_ FROM u JOIN l USING (name) WHERE NOT contains(u.name, ' ') GROUP BY u.name HAVING count(*) = 1)
        SELECT coalesce(full_, u.name) AS name, sum(n)::BIGINT AS n, coalesce(string_agg(DISTINCT CASE WHEN full_ IS NOT NULL THEN u.name END, ',' ORDER BY CASE WHEN full_ IS NOT NULL THEN u.name END), '') AS aliases FROM u LEFT JOIN h ON u.name = h.name GROUP BY 1""",
    "glossary_hits": f"WITH {HITS} SELECT * FROM hits",
    "documents_with_terms": f"WITH {HITS} SELECT lang, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM hits WHERE hits.doc_id = d.doc_id) GROUP BY lang",
    "documents_without_terms": f"WITH {HITS} SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.doc_id = d.doc_id) GROUP BY lang",
    "memory_scores": f"WITH {scores()} SELECT * FROM scores WHERE score >= 0.12",
    "memory_best": f"WITH {scores()} SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, strlen(source), entry_id)::INT AS rank FROM scores WHERE score >= 0.12 QUALIFY rank <= 3",
    "fused_ranking": f"""WITH {NUMBERED}, j AS (SELECT coalesce(f.query_id, s.query_id) AS query_id, coalesce(f.item_id, s.item_id) AS item_id, f.rank::INT AS first_rank, s.rank::INT AS second_rank FROM first f FULL JOIN second s ON f.query_id = s.query_id AND f.item_id = s.item_id),
        k AS (SELECT *, round(coalesce(1::DOUBLE / (60 + first_rank), 0) + coalesce(1::DOUBLE / (60 + second_rank), 0), 9) AS score FROM j)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank NULLS LAST, second_rank NULLS LAST, item_id)::INT AS fused_rank FROM k""",
    "ranking_metrics": f"""WITH {NUMBERED}, truth AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS gain FROM orders),
        top AS (SELECT f.*, coalesce(gain, 0) AS gain FROM first f LEFT JOIN truth USING (query_id, item_id) WHERE rank <= 3),
        found AS (SELECT query_id, count(CASE WHEN gain > 0 THEN 1 END) AS hits, count(DISTINCT CASE WHEN gain > 0 THEN item_id END) AS dh, min(CASE WHEN gain > 0 THEN rank END) AS f, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg FROM top GROUP BY 1),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item_id) AS place FROM truth),
        ideal AS (SELECT query_id, sum(CASE WHEN place <= 3 THEN (pow(2, gain) - 1) / log2(place + 1) ELSE 0 END) AS best, count(CASE WHEN gain > 0 THEN 1 END) AS rel FROM placed GROUP BY 1)
        SELECT query_id, coalesce(round(hits::DOUBLE / 3, 6), 0) AS precision, coalesce(round(dh::DOUBLE / nullif(rel, 0), 6), 0) AS recall, coalesce(round(1::DOUBLE / f, 6), 0) AS reciprocal_rank, coalesce(round(dcg / nullif(best, 0), 6), 0) AS ndcg FROM ideal LEFT JOIN found USING (query_id)""",
    "knn_cosine": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(q.e, b.e), 6) AS cosine FROM v q, v b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id) SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour)::INT AS rank FROM s QUALIFY rank <= 5",
    "neighbor_context": "SELECT conv_id, turn, right(lag(text) OVER w, 90) AS previous_tail, left(lead(text) OVER w, 90) AS next_head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "paragraph_groups": """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
        g AS (SELECT conv_id, turn, k, n AS used, 1 AS g FROM r WHERE k = 1 UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN g.used > 0 AND g.used + 2 + r.n > 600 OR g.used = 0 THEN r.n ELSE g.used + 2 + r.n END, g.g + CASE WHEN g.used > 0 AND g.used + 2 + r.n > 600 THEN 1 ELSE 0 END FROM g JOIN r ON r.conv_id = g.conv_id AND r.k = g.k + 1)
        SELECT conv_id, turn, g::BIGINT AS "group" FROM g""",
    "quality_gate": gate(),
    "native_review": f"""WITH {PAIRS}, f AS (SELECT concat_ws(':', conv_id, turn) AS unit_id, unnest(list_filter([CASE WHEN trim(output) = '' THEN {{'kind': 'empty_target', 'severity': 'critical', 'confidence': 1.0::DOUBLE}} END,
        CASE WHEN trim(output) <> '' AND {DENSE('source')} >= 80 AND {DENSE('output')}::DOUBLE / nullif({DENSE('source')}, 0) < 0.25 THEN {{'kind': 'possible_omission', 'severity': 'major', 'confidence': 0.72::DOUBLE}} END,
        CASE WHEN trim(output) <> '' AND {DENSE('source')} >= 80 AND {DENSE('output')}::DOUBLE / nullif({DENSE('source')}, 0) > 3.2 THEN {{'kind': 'possible_addition', 'severity': 'minor', 'confidence': 0.68::DOUBLE}} END,
        CASE WHEN trim(output) <> '' AND {BLOCKS('source')} >= 3 AND {BLOCKS('output')} < {BLOCKS('source')} * 0.5 THEN {{'kind': 'paragraphs_collapsed', 'severity': 'major', 'confidence': 0.82::DOUBLE}} END], lambda x: x IS NOT NULL)) AS f FROM pairs)
        SELECT unit_id, f.kind AS kind, f.severity AS severity, f.confidence AS confidence, sha256(unit_id || chr(31) || f.kind) AS finding_id FROM f""",
    "consistency_audit": f"""WITH r AS (SELECT lower(trim(p_brand)) AS key, {norm('p_type')} AS value, count(*) AS c, min(p_partkey) AS f FROM part GROUP BY ALL)
        SELECT key, string_agg(value, ',' ORDER BY value) AS variants, sum(c)::BIGINT AS n, array_to_string(list_sort(list(f))[1:5], ',') AS locations, count(*) <= 1 AS stable FROM r GROUP BY key""",
    "consistency_score": f"WITH g AS (SELECT lower(trim(c_name)) AS k, count(DISTINCT {norm('c_mktsegment')}) <= 1 AS stable FROM customer GROUP BY 1) SELECT coalesce(round(avg(stable::INT::DOUBLE), 6), 1) AS score, count(*) FILTER (stable) AS stable_groups, count(*) FILTER (NOT stable) AS conflicts FROM g",
    "glossary_conflicts": f"""WITH r AS (SELECT DISTINCT {norm('p_name')} AS term, p_type AS translation FROM part), l AS (SELECT term, list_sort(list(translation)) AS a FROM r GROUP BY term HAVING count(*) > 1)
        SELECT term, translation, array_to_string(list_filter(a, lambda x: x <> translation), ',') AS alternatives FROM (SELECT term, unnest(a) AS translation, a FROM l)""",
    "memory_conflicts": f"SELECT p_partkey, p_name AS source, p_brand AS translation, f AS first_translation FROM (SELECT *, first_value(p_brand) OVER (PARTITION BY {norm('p_name')} ORDER BY p_partkey) AS f FROM part) WHERE p_brand <> f".replace("p_name AS source, p_brand AS translation", "p_name, p_brand"),
    "claim_disagreement": "WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 7 >= 5 THEN 'high' WHEN doc_id % 7 >= 2 THEN 'moderate' ELSE 'low' END AS confidence FROM documents), c AS (SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source) SELECT doc_id, source, CASE WHEN n > 1 AND confidence = 'high' THEN 'moderate' ELSE confidence END AS confidence, greatest(n - 1, 0) AS contradicting FROM d JOIN c USING (source)",
    "anchor_report": f"""WITH {ANCHORS} SELECT CASE WHEN g = 1 THEN 'case' WHEN g = 2 THEN 'dimension' ELSE 'total' END AS scope, coalesce(case_id::VARCHAR, dimension, '') AS key, anchors, passed, coalesce(round(passed::DOUBLE / nullif(anchors, 0), 6), 1) AS rate
        FROM (SELECT case_id, dimension, grouping(case_id, dimension) AS g, count(*) AS anchors, count(*) FILTER (passed) AS passed FROM results GROUP BY GROUPING SETS ((case_id), (dimension), ()))""",
    "submission_problems": """WITH e AS (SELECT item_id AS case_id FROM benchmark), a AS (SELECT case_id FROM e WHERE case_id % 5 <> 0 UNION ALL SELECT case_id FROM e WHERE case_id % 11 = 3 UNION ALL SELECT case_id + 100000 FROM e WHERE case_id < 4)
        SELECT DISTINCT case_id, 'missing' AS problem FROM e WHERE case_id NOT IN (SELECT case_id FROM a) UNION ALL SELECT DISTINCT case_id, 'unknown' FROM a WHERE case_id NOT IN (SELECT case_id FROM e) UNION ALL SELECT case_id, 'duplicate' FROM a GROUP BY case_id HAVING count(*) > 1""",
    "preference_dossier": f"""WITH {REVIEWS}, c AS (SELECT case_id, count(*) FILTER (preferred <> 'defer') AS n, count(DISTINCT CASE WHEN preferred <> 'defer' THEN preferred END) AS k FROM reviews GROUP BY 1)
        SELECT (SELECT count(*) FROM c) AS cases, (SELECT count(*) FROM c WHERE n >= 2) AS multi_reviewed, (SELECT count(*) FROM c WHERE n >= 2 AND k = 1) AS unanimous, (SELECT count(*) FROM c WHERE n >= 2 AND k > 1) AS disagreements, count(*) AS reviews, count(*) FILTER (preferred = 'tie') AS ties, count(*) FILTER (preferred = 'defer') AS deferrals FROM reviews""",
    "system_preferences": f"WITH {REVIEWS} SELECT preferred, count(*) AS n FROM reviews WHERE preferred NOT IN ('tie', 'defer') GROUP BY preferred",
    "telemetry": "SELECT event_type, count(*) AS requests, sum(length(props))::BIGINT AS input_tokens, sum(user_id % 100)::BIGINT AS output_tokens, sum(event_id)::BIGINT AS latency_ms FROM events GROUP BY 1",
    "ledger_reconcile": f"""WITH {LEDGER}, j AS (SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.subject_key, n.subject_key) AS subject_key, old_fp, new_fp, revision, status, was_active, canonical FROM old o FULL JOIN new n ON o.kind = n.kind AND o.subject_key = n.subject_key),
        c AS (SELECT *, CASE WHEN new_fp IS NOT NULL THEN NOT canonical WHEN kind IN ('1-URGENT', '5-LOW') THEN false ELSE was_active END AS active FROM j WHERE old_fp IS NOT NULL OR NOT canonical)
        SELECT kind, subject_key, CASE WHEN old_fp IS NULL THEN 'added' WHEN new_fp IS NULL THEN 'kept' WHEN old_fp = new_fp THEN 'unchanged' ELSE 'changed' END AS change, old_fp IS NOT NULL AND was_active AND NOT active AS newly_obsolete,
            (CASE WHEN old_fp IS NULL THEN 1 WHEN new_fp <> old_fp THEN revision + 1 ELSE revision END)::INT AS revision, CASE WHEN old_fp IS NULL OR new_fp <> old_fp THEN 'pending' ELSE status END AS status,
            CASE WHEN active THEN 'active' ELSE 'obsolete' END AS availability, coalesce(new_fp, old_fp) AS fp FROM c""",
    "obsolete_sweep": f"WITH {LEDGER} SELECT kind, count(*) AS n FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.kind = old.kind AND new.subject_key = old.subject_key) GROUP BY kind",
    "latest_revision": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "history_retention": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "decision_replay": REPLAY,
    "review_queue": "SELECT doc_id AS item_id, toxic = 1 AS conflicted, quality AS confidence FROM labels ORDER BY conflicted DESC, confidence, doc_id LIMIT 50",
    "pilot_targets": """WITH r AS (SELECT doc_id AS chapter, CASE WHEN toxic = 1 THEN 'risk' WHEN quality = 0 THEN 'weak' ELSE 'routine' END AS reason, CASE WHEN toxic = 1 THEN 100 WHEN quality = 0 THEN 60 ELSE 20 END AS priority FROM documents JOIN labels USING (doc_id))
        SELECT chapter, max(priority) AS priority, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY chapter ORDER BY priority DESC, chapter LIMIT 12""",
    "promotion_plan": """WITH i AS (SELECT o_orderkey AS item_id, o_custkey AS subject_key, o_orderpriority AS value FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'P'), c AS (SELECT o_custkey AS subject_key, min(o_orderpriority) AS cv FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1),
        v AS (SELECT i.*, cv, count(DISTINCT value) OVER (PARTITION BY i.subject_key) AS k FROM i LEFT JOIN c USING (subject_key)), f AS (SELECT *, CASE WHEN k > 1 THEN 'competing_items' WHEN cv IS NOT NULL AND cv <> value THEN 'canon_differs' END AS conflict FROM v)
        SELECT item_id, subject_key, CASE WHEN conflict IS NOT NULL THEN 'blocked' WHEN cv = value THEN 'unchanged' ELSE 'insert' END AS operation, conflict FROM f""",
    "canon_upsert": """WITH o AS (SELECT lower(p_name) AS term, min(p_brand) AS old FROM part WHERE p_partkey % 4 <> 1 GROUP BY 1), n AS (SELECT lower(p_name) AS term, max(p_brand) AS new FROM part WHERE p_partkey % 4 <> 2 GROUP BY 1)
        SELECT term, coalesce(new, old) AS value, CASE WHEN old IS NULL THEN 'inserted' WHEN new IS NULL THEN 'kept' WHEN old = new THEN 'unchanged' ELSE 'replaced' END AS outcome FROM o FULL JOIN n USING (term)""",
    "chapter_work_list": "SELECT doc_id, sha256(text) AS source_fp FROM documents WHERE doc_id % 2 <> 0 OR doc_id % 10 = 0",
    "rule_violations": "SELECT doc_id, rule FROM (SELECT doc_id, unnest(list_filter([CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'text_present' END, CASE WHEN NOT coalesce(length(text) = n_chars, false) THEN 'count_matches' END, CASE WHEN NOT coalesce(n_chars >= 20, false) THEN 'long_enough' END], lambda x: x IS NOT NULL)) AS rule FROM documents)",
    "status_summary": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
    "evidence_fingerprint": "SELECT doc_id, sha256(doc_id || chr(31) || lang || chr(31) || text) AS evidence_id FROM documents",
    "document_freshness": "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM documents",
    "export_readiness": "SELECT o_custkey, count(*) AS chapters, count(*) FILTER (o_orderstatus = 'F') AS done, bool_and(o_orderstatus = 'F') AS ready FROM orders GROUP BY 1",
    "finding_counts": "WITH c AS (SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n DESC, first_seen, event_type)::INT AS rank FROM c",
    "context_lines": "WITH l AS (SELECT conv_id, turn, left(trim(text, ' '), 40) AS line FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS r FROM l WHERE line <> '') SELECT conv_id, string_agg(line, chr(10) ORDER BY r) AS context FROM r WHERE r <= 3 GROUP BY 1",
    "present_entries": "SELECT p_partkey, array_to_string(list_filter(['Metal', 'steel', 'BLUE', 'green', 'red'], lambda e: contains(lower(p_name), lower(e)))[1:2], ',') AS entries FROM part",
    "relationship_refs": "WITH e AS (SELECT s_nationkey AS name, s_suppkey AS ref FROM supplier UNION SELECT 24 - s_nationkey, s_suppkey FROM supplier) SELECT name, string_agg(ref::VARCHAR, ',' ORDER BY ref) AS refs FROM e GROUP BY 1",
}
