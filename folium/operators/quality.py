"""Quality gates, consistency audits and validation of proposed findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.ids import sha256
from folium.functions.scan import persian_letters, typography
from folium.functions.text import block_paragraphs, contains_phrase, dense_chars, normalize_case_insensitive

# Phrases of a prompt that must not stand in an output.
LEAKS = ("project context", "passage", "glossary preserve these decisions", "translation memory use as style continuity evidence not as mandatory wording")


def gate(rows: DataFrame, source: str = "source", output: str = "output", terms: DataFrame | None = None, unit: str = "unit_id") -> DataFrame:
    """``rows`` with blocking, warnings (arrays of codes), score and passes.

    Blocking (0.5 each): an empty side, a leaked prompt phrase, under a fifth
    of the source's characters. Warnings (0.1 each): over five times as many,
    under half of four or more paragraphs, or (with ``terms`` of source_term
    and preferred_translation, and a ``unit`` that tells rows apart) a term of
    the source whose preferred wording the output lacks. Nulls count as empty.
    """
    if terms is not None:
        lacking = missing_terms(rows, terms, unit, source, output).groupBy(unit).agg(F.array_sort(F.collect_set(F.concat(F.lit("term:"), "source_term"))).alias("lacking_terms"))
        rows = rows.join(lacking, unit, "left")
    s, o = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(output), F.lit(""))
    empty_s, empty_o = F.trim(s) == "", F.trim(o) == ""
    both, n = ~empty_s & ~empty_o, normalize_case_insensitive(o)
    ratio = F.try_divide(dense_chars(o).cast("double"), dense_chars(s))
    code = lambda when, name: F.when(when, F.lit(name))
    blocking = F.array_compact(F.array(code(empty_s, "empty_source"), code(empty_o, "empty_output"), *[code(F.contains(n, F.lit(m)), f"leak:{m}") for m in LEAKS], code(both & (ratio < 0.20), "truncated")))
    collapsed = both & (block_paragraphs(s) >= 4) & (block_paragraphs(o) * 2 < block_paragraphs(s))
    warnings = F.array_compact(F.array(code(both & (ratio > 5.0), "expanded"), code(collapsed, "paragraphs_collapsed")))
    if terms is not None:
        warnings = F.concat(warnings, F.coalesce("lacking_terms", F.array().cast("array<string>")))
    out = rows.withColumns({"blocking": blocking, "warnings": warnings}).drop("lacking_terms")
    score = F.greatest(F.lit(0.0), 1.0 - F.size("blocking") * 0.5 - F.size("warnings") * 0.1)
    return out.withColumns({"score": F.round(score, 6), "passes": F.size("blocking") == 0})


def missing_terms(rows: DataFrame, terms: DataFrame, unit: str = "unit_id", source: str = "source", output: str = "output") -> DataFrame:
    """(unit_id, source_term): terms that the source holds and whose preferred wording the output lacks."""
    from folium.operators.matching import phrase_hits

    hits = phrase_hits(rows, terms.withColumn("term_id", F.col("source_term")), unit, source, "term_id", "source_term")
    wanted = hits.join(terms, hits["term_id"] == terms["source_term"]).join(rows.select(unit, output), unit)
    o, preferred = normalize_case_insensitive(F.coalesce(F.col(output), F.lit(""))), normalize_case_insensitive(F.col("preferred_translation"))
    return wanted.filter((preferred != "") & ~contains_phrase(o, preferred)).select(unit, "source_term").distinct()


def review(rows: DataFrame, unit: str = "unit_id", source: str = "source", target: str = "target") -> DataFrame:
    """Findings (unit_id, kind, severity, confidence, finding_id): empty targets, character and paragraph ratios, unbalanced length.

    An empty target is critical and ends the review of its unit.
    """
    s, t = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    ratio = F.try_divide(dense_chars(t).cast("double"), dense_chars(s))
    long_ = dense_chars(s) >= 80
    ps, pt = block_paragraphs(s), block_paragraphs(t)
    finding = lambda when, kind, severity, confidence: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    empty = F.trim(t) == ""
    found = F.array_compact(
        F.array(
            finding(empty, "empty_target", "critical", 1.0),
            finding(~empty & long_ & (ratio < 0.25), "possible_omission", "major", 0.72),
            finding(~empty & long_ & (ratio > 3.2), "possible_addition", "minor", 0.68),
            finding(~empty & (ps >= 3) & (pt < ps * 0.5), "paragraphs_collapsed", "major", 0.82),
        )
    )
    out = rows.select(F.col(unit).alias("unit_id"), F.explode(found).alias("f")).select("unit_id", "f.*")
    return out.withColumn("finding_id", sha256(F.col("unit_id"), F.col("kind")))


def typography_findings(rows: DataFrame, unit: str = "unit_id", text: str = "target") -> DataFrame:
    """(unit_id, kind, n, first_index, suggestion) of Persian typography; texts without such letters are left out."""
    found = rows.filter(persian_letters(F.col(text))).select(F.col(unit).alias("unit_id"), F.explode(typography(F.col(text))).alias("f")).select("unit_id", "f.*")
    return found.groupBy("unit_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("char_index").alias("first_index"), F.min_by("suggestion", "char_index").alias("suggestion"))


def observed_values(observations: DataFrame, key: str, value: str, location: str) -> DataFrame:
    """(key, value, n, first): one row for each trimmed lower-case key and normalised value (null: empty); null keys are left out."""
    rows = observations.select(F.lower(F.trim(F.col(key))).alias("key"), normalize_case_insensitive(F.coalesce(F.col(value), F.lit(""))).alias("value"), F.col(location).alias("location")).filter("key IS NOT NULL")
    return rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("location").alias("first"))


def audit_consistency(observations: DataFrame, key: str, value: str, location: str, evidence: int = 20, listed: int = 1000) -> DataFrame:
    """(key, variants, n, locations, n_variants, stable): groups of observations by key and their normalised values.

    ``variants`` lists the first ``listed`` values in order, ``locations`` the
    first ``evidence`` first locations; ``observed_values`` has every value of
    every key as a row, so no key's values have to fit in one row.
    """
    values = observed_values(observations, key, value, location)
    totals = values.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_variants"))
    nth = lambda by: F.row_number().over(Window.partitionBy("key").orderBy(*by))
    names = values.select("key", "value", nth(["value"]).alias("r")).filter(F.col("r") <= listed).groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("variants"))
    places = values.select("key", "first", nth([F.asc_nulls_last("first"), "value"]).alias("r")).filter(F.col("r") <= evidence).groupBy("key").agg(F.array_sort(F.collect_list("first")).alias("locations"))
    return totals.join(names, "key").join(places, "key").select("key", "variants", "n", "locations", "n_variants", (F.col("n_variants") <= 1).alias("stable"))


def consistency_score(audit: DataFrame) -> DataFrame:
    """One row: share of stable groups (1 without groups), and the number of both kinds."""
    return audit.agg(F.coalesce(F.round(F.avg(F.col("stable").cast("double")), 6), F.lit(1.0)).alias("score"), F.count_if("stable").alias("stable_groups"), F.count_if(~F.col("stable")).alias("conflicts"))


def term_conflicts(glossary: DataFrame, term: str = "source_term", translation: str = "preferred_translation", listed: int = 1000) -> DataFrame:
    """(term, translation, alternatives, n_alternatives): terms with more than one translation, one row for each.

    ``alternatives`` holds the first ``listed`` other translations in order;
    all of them are rows of the same term.
    """
    rows = glossary.select(normalize_case_insensitive(F.col(term)).alias("term"), F.col(translation).alias("translation")).dropna().distinct()
    several = rows.groupBy("term").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    nth = F.row_number().over(Window.partitionBy("term").orderBy("translation"))
    heads = rows.withColumn("r", nth).filter(F.col("r") <= listed + 1).groupBy("term").agg(F.array_sort(F.collect_list("translation")).alias("all"))
    others = F.slice(F.array_except("all", F.array("translation")), 1, listed)
    return rows.join(several.join(heads, "term"), "term").select("term", "translation", others.alias("alternatives"), (F.col("c") - 1).alias("n_alternatives"))


def memory_conflicts(memory: DataFrame, position: str, source: str = "source", translation: str = "translation") -> DataFrame:
    """(position, source, translation, first_translation) of entries that differ from the first one with their normalised source."""
    w = Window.partitionBy(normalize_case_insensitive(F.col(source))).orderBy(position)
    rows = memory.withColumn("first_translation", F.first(translation).over(w))
    return rows.filter(F.col(translation) != F.col("first_translation")).select(position, source, translation, "first_translation")


def disagreement(findings: DataFrame, by: list[str], claim: str = "claim", level: str = "confidence") -> DataFrame:
    """``findings`` with ``contradicting`` (other claims about the same subject); such high confidence drops to moderate."""
    claims = findings.groupBy(*by).agg(F.count_distinct(claim).alias("claims"))
    out = findings.join(claims, by).withColumn("contradicting", F.greatest(F.col("claims") - 1, F.lit(0)))
    return out.withColumn(level, F.when((F.col("contradicting") > 0) & (F.col(level) == "high"), "moderate").otherwise(F.col(level))).drop("claims")


def validate_findings(findings: DataFrame, supplied: DataFrame, categories: list[str], most_chars: int = 2_000) -> DataFrame:
    """``findings`` with reason (null: valid), n_cited and level.

    ``findings``: unit_id, category, claim, confidence, evidence (array of
    ordinals); ``supplied``: unit_id, ordinal, or unit_id and all its ordinals as
    ``known``. Unknown categories, blank or
    oversize claims, confidence outside 0 to 1 and ordinals that were not
    supplied are reasons to reject.
    """
    lists = supplied if "known" in supplied.columns else supplied.groupBy("unit_id").agg(F.collect_set("ordinal").alias("known"))
    joined = findings.join(lists, "unit_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    odd = F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1)
    reason = (
        F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "unknown_category")
        .when(F.trim(F.coalesce("claim", F.lit(""))) == "", "blank_claim")
        .when(F.length("claim") > most_chars, "oversize_claim")
        .when(odd, "bad_confidence")
        .when(F.size(F.array_except("evidence", "known")) > 0, "unsupplied_evidence")
    )
    n = F.size(F.array_distinct("evidence"))
    level = F.when((F.col("confidence") >= 0.8) & (n >= 2), "high").when((F.col("confidence") >= 0.5) & (n >= 1), "moderate").otherwise("low")
    return joined.withColumns({"reason": reason, "n_cited": n, "level": level}).drop("known")


def _run(segments: Column, k: int):
    return lambda i: F.struct(i.cast("int").alias("start"), F.lit(k).alias("len"), F.array_join(F.slice(segments, i + 1, k), "\n").alias("text"))


def span_specs(segments: Column, most: int = 3) -> Column:
    """All runs of up to ``most`` neighbouring segments as (start, len, text), joined by line ends."""
    n = F.size(segments)
    runs = [F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), _run(segments, k))) for k in range(1, most + 1)]
    empty = F.array().cast("array<struct<start:int,len:int,text:string>>")
    return F.concat(*[F.coalesce(r, empty) for r in runs])
