"""Blind review: recorded decisions with a chain of digests, and the reviews that a reveal key admits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.operators import checks

# Decisions on a pair of candidates.
DECISIONS = ("candidate_a", "candidate_b", "tie", "defer")
CHAIN_START = "0" * 64


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ledger, digest = None, CHAIN_START
    for batch in batches:
        out = []
        for owner, line in zip(batch.column("owner").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if owner != ledger:
                ledger, digest = owner, CHAIN_START
            digest = hashlib.sha256(f"{digest}\x1f{line}".encode()).hexdigest()
            out.append(digest)
        yield batch.append_column("digest", pa.array(out, pa.string()))


def chained(rows: DataFrame, owner: str, order: list[str], columns: list[str], name: str = "digest") -> DataFrame:
    """``rows`` with a digest that covers the row and all rows of its owner before it.

    A row that is changed, left out or moved changes every later digest. Rows
    of an owner stream through one task in order; nothing of them is held.
    Orders are unique; nulls count as empty texts.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    keyed = rows.withColumns({"owner": F.col(owner).cast("string"), "line": line})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields) + ", digest string"
    out = keyed.repartition("owner").sortWithinPartitions("owner", *order).mapInArrow(_chain, schema).drop("owner", "line")
    return out.withColumnRenamed("digest", name)


def recorded(cases: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each case with its decision, records that were refused).

    ``cases``: ledger, case_id; ``records``: ledger, seq, case_id, decision,
    reason, notes. A record of an unknown case or decision, or without a
    reason, is refused; of the others of a case the last one counts, however
    often they are repeated. Cases without one are pending.
    """
    known = records.join(cases.select("ledger", "case_id", F.lit(True).alias("known")), ["ledger", "case_id"], "left")
    why = F.when(F.col("known").isNull(), "unknown_case").when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown_decision").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "missing_reason")
    judged = known.withColumn("refused", why)
    last = judged.filter("refused IS NULL").groupBy("ledger", "case_id").agg(F.max_by(F.struct("decision", F.trim("reason").alias("reason"), "notes", "seq"), F.col("seq")).alias("x")).select("ledger", "case_id", "x.*")
    state = cases.join(last, ["ledger", "case_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
    return state, judged.filter("refused IS NOT NULL").select("ledger", "seq", "case_id", "refused")


def inadmissible(ledgers: DataFrame, keys: DataFrame) -> DataFrame:
    """(review, rule) of the ledgers that can't go into their reveal's dossier, each with the first rule that it breaks.

    ``ledgers``: review, reveal, position and the columns of
    ``checks.blind_ledger_failures``; ``keys``: reveal and those of
    ``checks.reveal_key_failures``. All ledgers of a reveal have the bundle of
    its first one, and a reviewer counts once.
    """
    odd = checks.blind_ledger_failures(ledgers).select("review", F.col("rule").alias("own"))
    bad_key = checks.reveal_key_failures(keys).select("reveal", F.col("rule").alias("key_rule"))
    expected = keys.select("reveal", F.col("corpus_id").alias("key_corpus"), F.col("schema_version").alias("key_schema"), F.col("bundle_sha256").alias("key_sha"), F.array_sort(F.array_distinct(F.transform("assignments", lambda a: a["case_id"]))).alias("expected"))
    first = ledgers.groupBy("reveal").agg(F.min_by("bundle_fingerprint", "position").alias("first_bundle"))
    twice = F.row_number().over(Window.partitionBy("reveal", "reviewer").orderBy("position")) > 1
    rows = ledgers.withColumn("twice", twice).join(odd, "review", "left").join(expected, "reveal", "left").join(first, "reveal", "left").join(bad_key, "reveal", "left")
    ids = F.array_sort(F.array_distinct(F.transform("cases", lambda c: c["case_id"])))
    rule = (
        F.when(F.col("expected").isNull(), "no_key").when(F.col("key_rule").isNotNull(), F.concat(F.lit("key_"), "key_rule")).when(F.col("own").isNotNull(), F.col("own")).when(F.col("corpus_id") != F.col("key_corpus"), "other_corpus")
        .when(F.col("bundle_fingerprint") != F.col("first_bundle"), "other_bundle").when((F.col("key_schema") == 2) & ((F.col("schema_version") != 2) | ~F.col("bundle_sha256").eqNullSafe(F.col("key_sha"))), "unbound")
        .when(F.col("twice"), "reviewer_twice").when(ids != F.col("expected"), "other_cases").when(F.exists("cases", lambda c: c["decision"] == "pending"), "pending")
    )
    return rows.select("review", rule.alias("rule")).filter("rule IS NOT NULL")


def preferences(ledgers: DataFrame, keys: DataFrame) -> DataFrame:
    """(reveal, case_id, reviewer, preferred) of the admissible ledgers: the system behind the candidate, tie or defer; input of ``evaluation.preference_dossier``."""
    fit = ledgers.join(inadmissible(ledgers, keys).select("review"), "review", "left_anti")
    cases = fit.select("reveal", "reviewer", F.explode("cases").alias("c")).select("reveal", "reviewer", "c.case_id", "c.decision")
    who = keys.select("reveal", F.explode("assignments").alias("a")).select("reveal", "a.*")
    chosen = F.when(F.col("decision") == "candidate_a", F.col("a_system")).when(F.col("decision") == "candidate_b", F.col("b_system")).otherwise(F.col("decision"))
    return cases.join(who, ["reveal", "case_id"]).select("reveal", "case_id", "reviewer", chosen.alias("preferred"))
