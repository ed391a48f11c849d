"""Scoring of benchmark submissions, blind comparisons, reviewer preferences and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.text import normalize_case_insensitive
from folium.operators.mining import ranked

DECISIONS = ("a", "b", "tie", "defer")


def anchor_results(outputs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(case_id, anchor_id, dimension, passed) of outputs (case_id, text) against anchors (case_id, anchor_id, dimension, mode, values).

    Modes: all_present, any_present, all_absent; values are sought as substrings
    of the normalised text. A case without output fails every anchor.
    """
    rows = anchors.join(outputs.select("case_id", normalize_case_insensitive(F.col("text")).alias("t")), "case_id", "left")
    has = lambda v: F.contains(F.col("t"), normalize_case_insensitive(v))
    passed = F.when(F.col("mode") == "all_present", F.forall("values", has)).when(F.col("mode") == "any_present", F.exists("values", has)).when(F.col("mode") == "all_absent", ~F.exists("values", has))
    return rows.select("case_id", "anchor_id", "dimension", (F.col("t").isNotNull() & F.coalesce(passed, F.lit(False))).alias("passed"))


def anchor_report(results: DataFrame) -> DataFrame:
    """(scope, key, anchors, passed, rate) by case, by dimension and in total, in one pass of grouping sets."""
    from pyspark.sql.functions import grouping_id

    sets = results.groupingSets([["case_id"], ["dimension"], []], "case_id", "dimension").agg(grouping_id().alias("g"), F.count(F.lit(1)).alias("anchors"), F.count_if("passed").alias("passed"))
    scope = F.when(F.col("g") == 1, "case").when(F.col("g") == 2, "dimension").otherwise("total")
    key = F.coalesce(F.col("case_id").cast("string"), F.col("dimension"), F.lit(""))
    return sets.select(scope.alias("scope"), key.alias("key"), "anchors", "passed", F.coalesce(F.round(F.try_divide(F.col("passed").cast("double"), F.col("anchors")), 6), F.lit(1.0)).alias("rate"))


def contrastive_failures(variants: DataFrame, anchors: DataFrame) -> DataFrame:
    """(case_id, variant_id, failed): variants (case_id, variant_id, text, dimension) and how many anchors of their dimension they fail (0: not told apart)."""
    outputs = variants.select(F.struct("case_id", "variant_id").alias("k"), "case_id", "variant_id", "text", "dimension")
    keyed = anchors.join(outputs, ["case_id", "dimension"]).select("k", "anchor_id", "dimension", "mode", "values").withColumnRenamed("k", "case_id")
    results = anchor_results(outputs.select(F.col("k").alias("case_id"), "text"), keyed)
    counted = results.groupBy("case_id").agg(F.count_if(~F.col("passed")).alias("failed"))
    all_ = outputs.join(counted, outputs["k"] == counted["case_id"], "left").select(outputs["case_id"], "variant_id", F.coalesce("failed", F.lit(0)).alias("failed"))
    return all_


def blind_pairs(cases: DataFrame, first: DataFrame, second: DataFrame, order: str = "case_id") -> DataFrame:
    """(case_id, a, b, a_is_first): outputs (case_id, text) side by side, sides swapped for every second case by an integer ``order``."""
    pairs = ranked(cases.select("case_id", *[c for c in (order,) if c != "case_id"]), order, "i").join(first.select("case_id", F.col("text").alias("x")), "case_id").join(second.select("case_id", F.col("text").alias("y")), "case_id")
    swap = F.pmod("i", F.lit(2)) == 1
    return pairs.select("case_id", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), (~swap).alias("a_is_first"))


def preference_dossier(reviews: DataFrame) -> DataFrame:
    """One row of counts over reviews (case_id, reviewer_id, preferred): per-system wins, ties, deferrals and agreement.

    ``preferred`` is a system, 'tie' or 'defer'. A case with two or more
    decisions (deferrals aside) is unanimous or in disagreement.
    """
    judged = F.col("preferred") != "defer"
    by_case = reviews.groupBy("case_id").agg(F.count_if(judged).alias("n"), F.count_distinct(F.when(judged, F.col("preferred"))).alias("kinds"))
    agreement = by_case.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.expr("n >= 2")).alias("multi_reviewed"), F.count_if(F.expr("n >= 2 AND kinds = 1")).alias("unanimous"), F.count_if(F.expr("n >= 2 AND kinds > 1")).alias("disagreements"))
    counts = reviews.agg(F.count(F.lit(1)).alias("reviews"), F.count_if(F.col("preferred") == "tie").alias("ties"), F.count_if(F.col("preferred") == "defer").alias("deferrals"))
    return agreement.join(counts, F.lit(True))


def system_preferences(reviews: DataFrame) -> DataFrame:
    """(preferred, n) for each system."""
    return reviews.filter(~F.col("preferred").isin("tie", "defer")).groupBy("preferred").agg(F.count(F.lit(1)).alias("n"))


def governance(profile: DataFrame, items: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, item, status, blocks) of wide profiles: anything but 'acceptable' blocks."""
    rows = profile.unpivot([F.col(k) for k in keys], [F.col(i) for i in items], "item", "status")
    return rows.withColumn("blocks", F.coalesce(F.col("status"), F.lit("unknown")) != "acceptable")


def telemetry(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests, token sums and latency sum (decimal, as it may pass a long) of each group."""
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("latency_ms").cast("decimal(20,0)")).alias("latency_ms"))


def pilot_targets(reasons: DataFrame, most: int = 12) -> DataFrame:
    """(chapter, priority, reasons): chapters by their greatest reason priority, at most ``most``, in chapter order."""
    best = reasons.groupBy("chapter").agg(F.max("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return best.orderBy(F.desc("priority"), "chapter").limit(most).orderBy("chapter")
