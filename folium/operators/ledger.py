"""Versioned review ledgers: reconciliation, decisions, merges, promotion plans, work lists and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import normalize_case_insensitive

# The decisions a status admits, and the status they lead to.
TRANSITIONS = (
    ("pending", "approve", "approved"), ("pending", "edit", "edited"), ("pending", "reject", "rejected"), ("pending", "defer", "deferred"),
    ("deferred", "approve", "approved"), ("deferred", "edit", "edited"), ("deferred", "reject", "rejected"),
    ("approved", "reopen", "pending"), ("edited", "reopen", "pending"), ("rejected", "reopen", "pending"),
)


def reconcile(ledger: DataFrame, incoming: DataFrame, keys: list[str], fingerprint: str, owned: list[str] | None = None, kind: str = "kind") -> DataFrame:
    """``keys``, change (added, unchanged, changed, kept), newly_obsolete, revision, status, availability, fingerprint.

    ``ledger`` has keys, fingerprint, revision, status and availability (active
    or obsolete); ``incoming`` has keys, fingerprint and already_canonical. A
    changed item gets the next revision and is pending again; others keep
    their status, whatever their availability. An item is active while it is
    proposed and not canonical yet, and obsolete when it is canonical, or when
    the pass owns its kind (``owned``, or all) and no longer proposes it;
    newly_obsolete tells those that were active before. Canonical proposals
    that the ledger doesn't have are left out. Of several proposals with one
    key the greatest fingerprint counts; a null fingerprint is one like any other.
    """
    old = ledger.select(*keys, F.col(fingerprint).alias("old_fp"), "revision", "status", "availability", F.lit(True).alias("known"))
    new = incoming.groupBy(*keys).agg(F.max(fingerprint).alias("new_fp"), F.bool_and("already_canonical").alias("canonical"), F.lit(True).alias("proposed"))
    out = old.join(new, keys, "full").withColumns({"known": F.coalesce("known", F.lit(False)), "proposed": F.coalesce("proposed", F.lit(False)), "canonical": F.coalesce("canonical", F.lit(False))})
    out = out.filter(F.col("known") | ~F.col("canonical"))
    mine = F.lit(True) if owned is None else F.col(kind).isin(*owned)
    change = F.when(~F.col("known"), "added").when(~F.col("proposed"), "kept").when(F.col("old_fp").eqNullSafe(F.col("new_fp")), "unchanged").otherwise("changed")
    availability = F.when(F.col("proposed"), F.when(F.col("canonical"), "obsolete").otherwise("active")).when(mine, "obsolete").otherwise(F.col("availability"))
    out = out.withColumn("change", change).withColumn("new_availability", availability)
    revision = F.when(F.col("change") == "added", 1).when(F.col("change") == "changed", F.col("revision") + 1).otherwise(F.col("revision"))
    status = F.when(F.col("change").isin("added", "changed"), "pending").otherwise(F.col("status"))
    lost = F.col("known") & (F.col("availability") == "active") & (F.col("new_availability") == "obsolete")
    return out.select(*keys, "change", lost.alias("newly_obsolete"), revision.alias("revision"), status.alias("status"), F.col("new_availability").alias("availability"), F.when(F.col("proposed"), F.col("new_fp")).otherwise(F.col("old_fp")).alias(fingerprint))


def archived(ledger: DataFrame, reconciled: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger rows that a changed proposal replaces, to be appended to the revision table."""
    return ledger.join(reconciled.filter("change = 'changed'").select(*keys), keys, "left_semi")


def replay(decisions: DataFrame, item: str = "item_id", order: str = "seq") -> DataFrame:
    """(item_id, status, applied, invalid): decisions folded in order from 'pending'.

    ``decisions`` has item, seq, action, reviewer, reason, replacement and
    obsolete (whether the item was no longer proposed then). Decisions without
    reviewer or reason, edits without a replacement, decisions on obsolete
    items and those that the status does not admit are counted as invalid and
    change nothing. The decisions of one item are a short list by contract.
    """
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    sound = given("reviewer") & given("reason") & ((F.col("action") != "edit") | given("replacement")) & ~F.coalesce("obsolete", F.lit(False))
    lists = decisions.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("action").alias("action"), sound.alias("sound")))).alias("d"))
    table = F.create_map(*[F.lit(x) for a, b, c in TRANSITIONS for x in (f"{a}:{b}", c)])
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("applied"), F.lit(0).alias("invalid"))

    def step(acc: Column, d: Column) -> Column:
        to = F.when(d["sound"], F.try_element_at(table, F.concat(acc["status"], F.lit(":"), d["action"])))
        ok = to.isNotNull()
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), (acc["applied"] + ok.cast("int")).alias("applied"), (acc["invalid"] + (~ok).cast("int")).alias("invalid"))

    return lists.select(item, F.aggregate("d", start, step).alias("s")).select(item, "s.*")


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return records.withColumn("__r", rank).filter("__r = 1").drop("__r")


def keep_newest(records: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The newest ``most`` records of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]))
    return records.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def review_queue(items: DataFrame) -> list[Column]:
    """Sort order of a queue: conflicted first, then confidence, kind, position, id."""
    return [F.desc("conflicted"), F.asc("confidence"), F.asc("kind"), F.asc("position"), F.asc("item_id")]


def upsert(canon: DataFrame, proposed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, outcome) of a merge by normalised key: inserted, replaced, unchanged or kept."""
    old, new = canon.select(F.lower(F.trim(F.col(key))).alias("k"), F.col(value).alias("old")), proposed.select(F.lower(F.trim(F.col(key))).alias("k"), F.col(value).alias("new"))
    joined = old.join(new, "k", "full")
    outcome = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(F.col("old") == F.col("new"), "unchanged").otherwise("replaced")
    return joined.select(F.col("k").alias(key), F.coalesce("new", "old").alias(value), outcome.alias("outcome"))


def upserts_in_order(proposed: DataFrame, canon: DataFrame, key: str, value: str, position: str = "position", replace: bool = False) -> DataFrame:
    """(position, key, value, outcome): proposals taken in the order of their unique ``position``.

    outcome: invalid (null key), inserted, unchanged (the value that stands
    then), and for another value replaced or, without ``replace``, conflict,
    which changes nothing. ``canon`` has one row a key; values are not null.
    """
    rows = proposed.select(F.col(position).alias("position"), key, value)
    w = Window.partitionBy(key).orderBy("position")
    met = rows.filter(F.col(key).isNotNull()).join(canon.select(key, F.col(value).alias("__had")), key, "left")
    before = F.coalesce(F.lag(value).over(w), "__had") if replace else F.coalesce(F.col("__had"), F.when(F.row_number().over(w) > 1, F.first(value).over(w)))
    outcome = F.when(F.col("__was").isNull(), "inserted").when(F.col("__was") == F.col(value), "unchanged").otherwise("replaced" if replace else "conflict")
    out = met.withColumn("__was", before).select("position", key, value, outcome.alias("outcome"))
    return out.unionByName(rows.filter(F.col(key).isNull()).withColumn("outcome", F.lit("invalid")))


def pair_key(first: Column, second: Column) -> Column:
    """Key of an unordered pair of names, normalised; null for blank or equal ones."""
    a, b = normalize_case_insensitive(first), normalize_case_insensitive(second)
    return F.when((a != "") & (b != "") & (a != b), F.concat(F.least(a, b), F.lit("\n"), F.greatest(a, b)))


def merge_notes(canon: Column, proposed: Column) -> Column:
    """The canon's note unless it is blank."""
    return F.coalesce(F.nullif(F.trim(canon), F.lit("")), proposed)


def promotion_plan(items: DataFrame, canon: DataFrame, key: str = "subject_key", value: str = "value") -> DataFrame:
    """(item_id, subject_key, operation, conflict) of approved or edited items against the canon.

    Items of one key conflict if their values differ; a key that the canon has
    with another value is a conflict too. Others insert or are no-ops.
    """
    ready = items.filter(F.col("status").isin("approved", "edited"))
    values = ready.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    old = canon.select(F.col(key), F.col(value).alias("canon_value"))
    joined = ready.join(values, key).join(old, key, "left")
    conflict = F.when(F.col("low") != F.col("high"), "competing_items").when(F.col("canon_value").isNotNull() & (F.col("canon_value") != F.col(value)), "canon_differs")
    operation = F.when(conflict.isNotNull(), "blocked").when(F.col("canon_value") == F.col(value), "unchanged").otherwise("insert")
    return joined.select("item_id", key, operation.alias("operation"), conflict.alias("conflict"))


def plan_id(plan: DataFrame) -> DataFrame:
    """One row: an order-free fingerprint of the plan and whether anything blocks it."""
    row = F.sha2(F.concat_ws("\x1f", "item_id", "subject_key", "operation"), 256)
    digest = F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)"))
    return plan.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(digest, F.lit(0)).cast("string")), 256).alias("plan_id"), F.coalesce(F.bool_or(F.col("conflict").isNotNull()), F.lit(False)).alias("blocked"))


def resumable(chapters: DataFrame, checkpoints: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chapters whose checkpoint has all their fingerprints, and those still to do."""
    return chapters.join(checkpoints.select(*keys).distinct(), keys, "left_semi"), chapters.join(checkpoints.select(*keys).distinct(), keys, "left_anti")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule (a condition that must hold) that a row breaks; null conditions count as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def status_summary(items: DataFrame, by: str, statuses: list[str], status: str = "status") -> DataFrame:
    """Counts of each status by group, one column each."""
    return items.groupBy(by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct by ``keys``, the first row in ``order`` kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__r", rank).filter("__r = 1").drop("__r")


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Bag union by column name, with the index of the part in ``part``."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
