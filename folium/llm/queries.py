"""The registered queries of this subpackage; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import decontam, licenses, lm, packing, periods, phrases, pii, quality, rules, simhash, suffixes, toxicity, urls
from folium.llm.common import crc_mod, labelled_texts, read_table

Query = Callable[[SparkSession, str], DataFrame]


def toxicity_threshold() -> float:
    """Documents at or above this score count as toxic."""
    return 0.7


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, rows: int) -> DataFrame:
    """Texts of labelled documents outside the held-out third, about ``rows`` at most."""
    labels = read_table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 3) != 1)
    return labelled_texts(docs, labels, "doc_id", "text", label, rows)


def _scored(spark: SparkSession, sf_dir: str, operator, label: str, threshold: float) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = operator.train(labelled(spark, docs, sf_dir, label, operator.FIT_ROWS), label=label)
    return operator.score(docs, model, name="score").select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", toxicity_threshold())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 0.5)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    return lm.score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"), words=4, radius=4)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(pii.labelled_table(spark)), base="base", spans="all")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    of_kind = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list for the pages at hand: every domain seen (without www, m, blog) is blocked on one day, and two in three are allowed again later; one whole zone is blocked for a while."""
    domain = F.regexp_replace(urls.host_of(F.col("url")), r"^(www|m|blog)\.", "")
    domains = pages.select(domain.alias("domain")).filter("domain <> ''").distinct().withColumn("n", F.crc32(F.encode("domain", "UTF-8")))
    start = F.lit("2024-01-01").cast("date")
    blocked = domains.select("domain", F.lit("block").alias("action"), F.date_add(start, F.pmod("n", F.lit(300)).cast("int")).alias("since"))
    allowed = domains.filter("pmod(n, 3) > 0").select("domain", F.lit("allow").alias("action"), F.date_add(start, (F.pmod("n", F.lit(300)) + 20 + F.pmod("n", F.lit(41))).cast("int")).alias("since"))
    zone = pages.sparkSession.createDataFrame([("example.net", "block", "2024-03-01"), ("example.net", "allow", "2024-04-15")], "domain string, action string, since string")
    return blocked.unionByName(allowed).unionByName(zone.withColumn("since", F.col("since").cast("date")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch date, so the query dates them by rule: a day of 2024 for each page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7, F.lit(366)).cast("int"))
    return urls.judge(pages.withColumn("fetched", fetched), dated_entries(pages), ["page_id"])


OP5_SQL = """
WITH hosts AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + ((page_id * 7) % 366)::INT AS fetched,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^.*@', ''), '\\.*(:[0-9]*)?$', '') AS host FROM pages),
crc AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\\.', '') AS domain FROM hosts WHERE host <> ''),
bits AS (SELECT domain, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(domain) + 1), lambda i: ascii(domain[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM crc),
domains AS (SELECT domain, xor(c, 4294967295) AS n FROM bits),
entries AS (SELECT domain, 'block' AS action, DATE '2024-01-01' + (n % 300)::INT AS since FROM domains
    UNION ALL SELECT domain, 'allow', DATE '2024-01-01' + (n % 300 + 20 + n % 41)::INT FROM domains WHERE n % 3 > 0
    UNION ALL VALUES ('example.net', 'block', DATE '2024-03-01'), ('example.net', 'allow', DATE '2024-04-15')),
days AS (SELECT domain, since, max(action) AS action FROM entries GROUP BY ALL),
parts AS (SELECT *, string_split(host, '.') AS p FROM hosts),
probes AS (SELECT page_id, url, fetched, host, unnest(list_transform(range(1, len(p) + 1), lambda i: {'labels': len(p) - i + 1, 'domain': array_to_string(p[i:], '.')})) AS s FROM parts),
held AS (SELECT q.page_id, q.url, q.fetched, q.labels, q.domain, d.action FROM (SELECT page_id, url, fetched, s.labels AS labels, s.domain AS domain FROM probes) q ASOF JOIN days d ON q.domain = d.domain AND q.fetched >= d.since),
best AS (SELECT page_id, url, fetched, arg_max(domain, labels) AS matched_domain, arg_max(action, labels) AS action FROM held GROUP BY ALL)
SELECT h.page_id, h.url, h.fetched, h.host, b.matched_domain, b.action, coalesce(b.action, 'allow') = 'block' AS blocked
FROM hosts h LEFT JOIN best b ON h.page_id IS NOT DISTINCT FROM b.page_id AND h.url IS NOT DISTINCT FROM b.url AND h.fetched IS NOT DISTINCT FROM b.fetched
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("doc_key")


#: Every window of an item's length that shares a shingle with it, without a count bound or fingerprints.
OP8_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
docs AS (SELECT row_number() OVER () AS r, doc_id, w FROM d WHERE w <> ['']),
items AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
it AS (SELECT row_number() OVER () AS i, item_id, len(w) AS m, least(len(w), 5) AS width, len(w) - least(len(w), 5) + 1 AS k, w FROM items WHERE w <> ['']),
ish AS (SELECT i, width, unnest(list_transform(range(0, k), lambda x: array_to_string(w[x + 1 : x + width], ' '))) AS s FROM it),
dsh AS (SELECT r, len(w) - width + 1 AS n, width, unnest(range(0, len(w) - width + 1)) AS pos, unnest(list_transform(range(0, len(w) - width + 1), lambda x: array_to_string(w[x + 1 : x + width], ' '))) AS s FROM docs, (SELECT DISTINCT width FROM it) WHERE len(w) >= width),
hit AS (SELECT DISTINCT r, i, n, pos FROM dsh JOIN ish USING (width, s)),
win AS (SELECT DISTINCT r, i, unnest(range(greatest(pos - k + 1, 0), least(pos, greatest(n - k, 0)) + 1)) AS start FROM hit JOIN it USING (i)),
wsh AS (SELECT win.r, win.i, win.start, dsh.s, count(*) AS c FROM win JOIN it USING (i) JOIN dsh ON dsh.r = win.r AND dsh.width = it.width AND dsh.pos >= win.start AND dsh.pos < win.start + it.k GROUP BY ALL),
tot AS (SELECT r, i, start, sum(c) AS total FROM wsh GROUP BY ALL),
bag AS (SELECT i, s, count(*) AS c FROM ish GROUP BY ALL),
common AS (SELECT r, i, start, sum(least(wsh.c, bag.c)) AS shared FROM wsh JOIN bag USING (i, s) GROUP BY ALL),
scored AS (SELECT r, i, start, shared::DOUBLE / (total + k - shared) AS similarity FROM common JOIN tot USING (r, i, start) JOIN it USING (i)),
best AS (SELECT r, i, max(similarity) AS similarity FROM scored WHERE similarity >= 0.8 GROUP BY ALL)
SELECT doc_id, item_id, m::INT AS item_words, round(b.similarity, 6) AS similarity, (SELECT min(start)::INT FROM scored s WHERE s.r = b.r AND s.i = b.i AND s.similarity = b.similarity) AS word_start
FROM best b JOIN it USING (i) JOIN docs USING (r)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = rules.apply_rules(docs, rules=rules.counted_rules(), name="kept", facts=rules.digest, rejected=failed)
    return out.withColumn("base_failed", failed).drop("text", "n_lines")


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT r, doc_id, t, len(w) AS n, coalesce(len(array_to_string(w, '')), 0) AS chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda x: w[x : x + 4])) AS g FROM d WHERE len(w) >= 5),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_rep FROM rep, range(0, 5) AS x(k) GROUP BY r),
g AS (SELECT doc_id, t, n, chars, symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS dup, coalesce(n_rep, 0) AS n_rep FROM f LEFT JOIN cov USING (r)),
v AS (SELECT *, n < 10 OR 100 * n_rep > 20 * n AS failed FROM g)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words, failed AS base_failed,
    NOT failed AND NOT (symbols * 10 > n * 3 OR len(regexp_extract_all(t, '!!')) * 10 > n * 3 OR dup * 10 > n_lines * 5 OR chars < n * 2 OR chars > n * 20 OR NOT regexp_matches(t, '\\p{L}')) AS kept
FROM v
"""


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    cut = suffixes.without_repeats(docs, ["doc_id", "n_bytes"])
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


#: Every phrase counted, frequent words or not; HUGEINT products.
OP12_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
pieces AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(p) AS p FROM d)),
words AS (SELECT id, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM pieces),
next AS (SELECT lang, w AS x, lead(w, 1) OVER o AS y, lead(w, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, [x] AS g, 1 AS k, count(*) AS f FROM next GROUP BY lang, x UNION ALL SELECT lang, [x, y], 2, count(*) FROM next WHERE y IS NOT NULL GROUP BY lang, x, y
    UNION ALL SELECT lang, [x, y, z], 3, count(*) FROM next WHERE z IS NOT NULL GROUP BY lang, x, y, z),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT c.lang, c.g, c.k, c.f AS a, x.cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
    FROM cand c JOIN (VALUES (1), (2)) x(cut) ON x.cut < c.k JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : x.cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[x.cut + 1 :]),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM cuts) WHERE o = 1),
longer AS (SELECT lang, g[1 : 2] AS g, f FROM cand WHERE k = 3 UNION ALL SELECT lang, g[2 : 3], f FROM cand WHERE k = 3),
around AS (SELECT lang, g, max(f) AS f FROM longer GROUP BY ALL),
kept AS (SELECT low.lang, array_to_string(low.g, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN around USING (lang, g) WHERE around.f IS NULL OR 100 * around.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.periodic_runs(periods.with_planted_period(docs, "doc_id"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    top = found.withColumn("_top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.col2")).alias("start"), F.col("_top.length").alias("length"), (-F.col("_top.col3")).alias("period"),
        F.expr("1000 * _top.length div -_top.col3").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    found = (op1_toxicity, op2_license_scan, op3_lm_scoring, op4_pii, op5_url_filter, op6_packing, op7_simhash_groups, op8_decontamination, op9_quality_classifier, op10_quality_rules, op11_suffix_array_dedup, op12_collocations, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op5_url_filter": OP5_SQL, "op8_decontamination": OP8_SQL, "op10_quality_rules": OP10_SQL, "op12_collocations": OP12_SQL}
