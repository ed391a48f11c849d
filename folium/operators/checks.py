"""Validators of nested input: an input is refused for its first failure in document order.

Each level of an input (its head, its cases, a case's anchors) becomes rows with
a path that sorts as the document reads; rules of a level apply in their order,
and the least path of an input's failures is the answer. Inputs with very many
parts are rows like any other. A condition that is null counts as broken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.ids import is_sha256_hex

Rules = list[tuple[str, Column]]
# Schema versions that are read, and the most dimensions of a case.
CORPUS_SCHEMA, SUBMISSION_SCHEMA, SCORECARD_SCHEMA, LEDGER_SCHEMA, BLIND_SCHEMAS, MOST_DIMENSIONS = 1, 1, 1, 1, (1, 2), 4


def given(*names: str) -> Column:
    """All of the texts are there and not blank."""
    return reduce(lambda a, b: a & b, [F.trim(F.coalesce(F.col(n), F.lit(""))) != "" for n in names])


def first_of(*by: str, order: str = "pos") -> Column:
    """Whether a row is the first with its key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1


def failing(rows: DataFrame, key: str, path: list[Column | int], rules: Rules) -> DataFrame:
    """(key, path, rule): rows that break a rule, with the first one that they break."""
    flagged = rows.withColumns({f"__{i}": F.coalesce(ok, F.lit(False)) for i, (_, ok) in enumerate(rules)})
    rule = F.coalesce(*[F.when(~F.col(f"__{i}"), F.lit(name)) for i, (name, _) in enumerate(rules)])
    place = F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("int") for p in path])
    return flagged.select(F.col(key).alias("key"), place.alias("path"), rule.alias("rule")).filter("rule IS NOT NULL")


def refused(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, rule, path) of the inputs that fail, each with its first failure."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("key").agg(F.min(F.struct("path", "rule")).alias("x")).select(F.col("key").alias(key), "x.rule", "x.path")


def _parts(rows: DataFrame, key: list[str], items: str, position: str = "pos") -> DataFrame:
    return rows.select(*key, F.posexplode(items).alias(position, "x")).select(*key, position, "x.*")


def corpus_failures(corpora: DataFrame, key: str = "corpus") -> DataFrame:
    """Evaluation corpora (schema_version, corpus_id, title, source_language, target_language, rights_safe, owner, license, creation_note, cases).

    A case has id, title, source, reference, dimensions, anchors (id,
    dimension, values) and variants (id, translation, degradation, description).
    """
    head = failing(corpora, key, [-1, 0, 0], [
        ("schema", F.col("schema_version") == CORPUS_SCHEMA), ("identity", given("corpus_id", "title")), ("languages", given("source_language", "target_language")),
        ("rights", F.col("rights_safe")), ("provenance", given("owner", "license", "creation_note")), ("no_cases", F.size(F.coalesce("cases", F.array().cast(corpora.schema["cases"].dataType))) > 0),
    ])
    cases = _parts(corpora, [key], "cases")
    size = F.size("dimensions")
    whole = failing(cases, key, [F.col("pos"), 0, 0], [("duplicate_case", first_of(key, "id")), ("case_fields", given("id", "title", "source", "reference")), ("dimensions", size.between(1, MOST_DIMENSIONS))])
    anchors = _parts(cases.withColumnRenamed("pos", "case").withColumnRenamed("dimensions", "wanted"), [key, "case", "wanted"], "anchors")
    anchor_rules = [
        ("empty_anchor", given("id") & (F.size("values") > 0)), ("anchor_dimension", F.array_contains("wanted", F.col("dimension"))),
        ("anchor_value", F.forall("values", lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")), ("duplicate_anchor", first_of(key, "case", "id")),
    ]
    variants = _parts(cases.withColumnRenamed("pos", "case").withColumnRenamed("dimensions", "wanted"), [key, "case", "wanted"], "variants")
    variant_rules = [("incomplete_variant", given("id", "translation", "description")), ("variant_dimension", F.array_contains("wanted", F.col("degradation"))), ("duplicate_variant", first_of(key, "case", "id"))]
    return refused([head, whole, failing(anchors, key, [F.col("case"), 1, F.col("pos")], anchor_rules), failing(variants, key, [F.col("case"), 2, F.col("pos")], variant_rules)], key)


def submission_failures(submissions: DataFrame, key: str = "submission") -> DataFrame:
    """Submissions (schema_version, corpus_id, system_id, outputs of case_id and translation)."""
    head = failing(submissions, key, [-1], [("schema", F.col("schema_version") == SUBMISSION_SCHEMA), ("identity", given("corpus_id", "system_id"))])
    outputs = _parts(submissions, [key], "outputs")
    return refused([head, failing(outputs, key, [F.col("pos")], [("output_fields", given("case_id", "translation")), ("duplicate_output", first_of(key, "case_id"))])], key)


def scorecard_failures(scorecards: DataFrame, cases: DataFrame, key: str = "scorecard") -> DataFrame:
    """Scorecards (schema_version, case_id, reviewer_id, overall, ratings of dimension and score) of cases (case_id, dimensions): scores are 1 to 5, every dimension of the case is rated once and no other."""
    known = scorecards.join(cases.select("case_id", F.col("dimensions").alias("wanted"), F.lit(True).alias("known")), "case_id", "left")
    rated = F.transform("ratings", lambda r: r["dimension"])
    head = failing(known, key, [-1], [("schema", F.col("schema_version") == SCORECARD_SCHEMA), ("case", F.col("known")), ("reviewer", given("reviewer_id")), ("overall", F.col("overall").between(1, 5))])
    rows = _parts(known, [key, "wanted"], "ratings")
    each = failing(rows, key, [F.col("pos")], [("rating_dimension", F.array_contains("wanted", F.col("dimension"))), ("rating_score", F.col("score").between(1, 5)), ("duplicate_rating", first_of(key, "dimension"))])
    lacking = failing(known, key, [1 << 30], [("missing_rating", F.size(F.array_except("wanted", rated)) == 0)])
    return refused([head, each, lacking], key)


def ledger_failures(ledgers: DataFrame, key: str = "ledger") -> DataFrame:
    """Review ledgers (schema_version, manuscript_id, items).

    An item has id, kind, proposed_kind, original_kind, proposal_id,
    original_proposal_id, subject_key, revision, fingerprint, status and
    reviewed (kind, subject), which approved, edited and applied items need.
    """
    head = failing(ledgers, key, [-1], [("schema", F.col("schema_version") == LEDGER_SCHEMA), ("manuscript", given("manuscript_id"))])
    items = _parts(ledgers, [key], "items").withColumns({"reviewed_kind": F.col("reviewed.kind"), "reviewed_subject": F.col("reviewed.subject")})
    open_ = ~F.coalesce(F.col("status").isin("approved", "edited", "applied"), F.lit(False))
    rules = [
        ("duplicate_item", first_of(key, "id")), ("kind", (F.col("kind") == F.col("proposed_kind")) & (F.col("kind") == F.col("original_kind"))),
        ("identity", (F.col("proposal_id") == F.col("original_proposal_id")) & given("subject_key", "fingerprint") & (F.col("revision") > 0)),
        ("unreviewed", open_ | F.col("reviewed").isNotNull()), ("reviewed_kind", open_ | (F.col("reviewed_kind") == F.col("kind"))), ("reviewed_value", open_ | given("reviewed_subject")),
    ]
    return refused([head, failing(items, key, [F.col("pos")], rules)], key)


def _bound(schema: Column, digest: Column, second: int = 2) -> Rules:
    """A second-schema input names the bundle by a SHA-256, a first-schema one doesn't."""
    return [("schema", schema.isin(*BLIND_SCHEMAS)), ("digest_missing", (schema != second) | digest.isNotNull()), ("digest_form", (schema != second) | is_sha256_hex(digest)), ("digest_unbound", (schema != 1) | digest.isNull())]


def reveal_key_failures(keys: DataFrame, key: str = "reveal") -> DataFrame:
    """Reveal keys (schema_version, bundle_sha256, corpus_id, system_one, system_two, assignments of case_id, a_system, b_system)."""
    rules = _bound(F.col("schema_version"), F.col("bundle_sha256"))
    rules += [("corpus", given("corpus_id")), ("systems", given("system_one", "system_two")), ("one_system", F.col("system_one") != F.col("system_two")), ("no_assignments", F.size("assignments") > 0)]
    rows = _parts(keys, [key, "system_one", "system_two"], "assignments")
    known = lambda c: F.col(c).isin(F.col("system_one"), F.col("system_two"))
    each = [("duplicate_case", first_of(key, "case_id")), ("same_candidates", F.col("a_system") != F.col("b_system")), ("unknown_system", known("a_system") & known("b_system"))]
    return refused([failing(keys, key, [-1], rules), failing(rows, key, [F.col("pos")], each)], key)


def blind_ledger_failures(ledgers: DataFrame, key: str = "review") -> DataFrame:
    """Blind-review ledgers (schema_version, bundle_sha256, corpus_id, bundle_fingerprint, reviewer, cases of case_id, decision, reason): a pending case has no reason, any other has one."""
    rules = _bound(F.col("schema_version"), F.col("bundle_sha256")) + [("identity", given("corpus_id", "bundle_fingerprint", "reviewer")), ("no_cases", F.size("cases") > 0)]
    pending = F.col("decision") == "pending"
    each = [("duplicate_case", first_of(key, "case_id")), ("pending_reason", ~pending | F.col("reason").isNull()), ("missing_reason", pending | given("reason"))]
    return refused([failing(ledgers, key, [-1], rules), failing(_parts(ledgers, [key], "cases"), key, [F.col("pos")], each)], key)


# Bounds of a review record.
REVIEWER_CHARS, NOTE_CHARS, FINDINGS, FINDING_CHARS = 200, 4_000, 16, 2_000


def review_submission_failures(submissions: DataFrame, key: str = "submission") -> DataFrame:
    """Reviews of a target (reviewer, note, outcome, source_chars, target_chars, findings of severity, source_start, source_end, target_start, target_end, note).

    A clear target has no findings; one accepted as it is has a note or a
    finding, but no critical one; one that needs revision has a warning or a
    critical finding. A finding has a span inside its text or a note.
    """
    none = F.array().cast(submissions.schema["findings"].dataType)
    rows = submissions.withColumn("findings", F.coalesce("findings", none))
    n, outcome = F.size("findings"), F.col("outcome")
    has = lambda *levels: F.exists("findings", lambda f: F.coalesce(f["severity"].isin(*levels), F.lit(False)))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    head = failing(rows, key, [-1], [
        ("reviewer", F.length(blank("reviewer")).between(1, REVIEWER_CHARS)), ("note_length", F.length(F.coalesce("note", F.lit(""))) <= NOTE_CHARS), ("too_many_findings", n <= FINDINGS),
        ("clear_with_findings", (outcome != "clear") | (n == 0)), ("accepted_without_reason", (outcome != "accepted_as_is") | (n > 0) | (blank("note") != "")),
        ("accepted_critical", (outcome != "accepted_as_is") | ~has("critical")), ("revision_without_warning", (outcome != "needs_revision") | has("warning", "critical")),
    ])
    each = _parts(rows.withColumnRenamed("note", "whole_note"), [key, "source_chars", "target_chars"], "findings")
    span = lambda s: F.col(f"{s}_start").isNull() | ((F.col(f"{s}_start") < F.col(f"{s}_end")) & (F.col(f"{s}_end") <= F.col(f"{s}_chars")))
    rules = [("finding_length", F.length(F.coalesce("note", F.lit(""))) <= FINDING_CHARS), ("source_span", span("source")), ("target_span", span("target")), ("empty_finding", F.col("source_start").isNotNull() | F.col("target_start").isNotNull() | (blank("note") != ""))]
    return refused([head, failing(each, key, [F.col("pos")], rules)], key)
