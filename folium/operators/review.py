"""State of chapters and findings in a review: freshness, readiness to export, counts, and short context lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(current: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Each key of ``current`` as fresh, stale or missing, by its newest counterpart in ``stored``.

    A null fingerprint on either side counts as stale. Keys that ``stored``
    repeats are fresh if any of their rows agrees.
    """
    same = stored.groupBy(key, F.col(fingerprint).alias("__fp")).agg(F.lit(True).alias("__hit"))
    seen = stored.select(key).distinct().withColumn("__seen", F.lit(True))
    hit = same.withColumnRenamed(key, "__key")
    joined = current.select(key, fingerprint).join(seen, key, "left").join(hit, (F.col(key) == F.col("__key")) & (F.col(fingerprint) == F.col("__fp")), "left")
    state = F.when(F.col("__seen").isNull(), "missing").when(F.col("__hit"), "fresh").otherwise("stale")
    return joined.select(key, state.alias("state"))


def export_readiness(chapters: DataFrame, outputs: DataFrame, book: str, chapter: str, fingerprint: str) -> DataFrame:
    """For each book: chapters, those done under the same fingerprint, and whether all are. Books without chapters have no row."""
    done = outputs.select(book, chapter, F.col(fingerprint).alias("__fp")).distinct().withColumn("__done", F.lit(True))
    keyed = chapters.select(book, chapter, F.col(fingerprint).alias("__fp")).distinct()
    state = keyed.join(done, [book, chapter, "__fp"], "left").groupBy(book)
    counts = state.agg(F.count(F.lit(1)).alias("chapters"), F.count_if(F.col("__done")).alias("done"))
    return counts.withColumn("ready", F.col("chapters") == F.col("done"))


def finding_counts(findings: DataFrame, category: str, position: str) -> DataFrame:
    """Findings by category, most frequent first; ties in order of first appearance (``rank`` from 1)."""
    counts = findings.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_seen"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen", category)))


def context_lines(rows: DataFrame, unit: str, position: str, line: Column, most: int = 16, chars: int = 90) -> DataFrame:
    """The first ``most`` lines of each unit, ``chars`` characters of each, joined by newlines; blank lines don't count."""
    kept = rows.select(unit, position, F.left(F.trim(line), F.lit(chars)).alias("__line")).filter("__line <> ''")
    rank = F.row_number().over(Window.partitionBy(unit).orderBy(position, "__line"))
    first = kept.withColumn("__r", rank).filter(F.col("__r") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("__r", "__line")))
    return first.groupBy(unit).agg(F.array_join(F.transform(ordered, lambda x: x["__line"]), "\n").alias("context"))


def present_entries(text: Column, entries: Column, most: int) -> Column:
    """The first ``most`` of an array of entries that occur in the text, case ignored, in the array's order."""
    found = F.filter(entries, lambda e: (F.trim(e) != "") & F.contains(F.lower(text), F.lower(e)))
    return F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, most)


def relationship_refs(relationships: DataFrame, first: str = "a", second: str = "b", ref: str = "ref") -> DataFrame:
    """(name, refs): ids of the relationships that touch each name, in order; both ends count once."""
    ends = relationships.select(F.explode(F.array_distinct(F.array(first, second))).alias("name"), F.col(ref).alias("__ref"))
    return ends.filter("name IS NOT NULL").groupBy("name").agg(F.array_sort(F.collect_set("__ref")).alias("refs"))
