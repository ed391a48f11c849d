"""Packing into optimal length buckets.

A global histogram of all lengths goes through dynamic programming, which
finds the bucket boundaries with the least padding when each document is
padded to its bucket's boundary. The driver holds one row for each distinct
length, so at most as many as the longest document has tokens. Inside a bucket, batches hold as many documents as the
token budget admits. Batches are numbered by a rank that is computed in two
levels (rank within a hash shard, plus the documents of the shards before), so
no bucket is ever sorted as one group. Repeated rows are ranked as one row with
a count and dealt out after that, so a row that stands very often is none either.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import cut, free_name, words_of

BUCKETS, BUDGET = 8, 16_384
SHARD_ROWS = 50_000
#: Copies of a row that are made from one array.
COPIES = 1 << 16


def word_count(text: Column) -> Column:
    """The default length: whitespace-separated words; null and empty texts have 0."""
    return F.size(words_of(text.cast("string")))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend; ``counts`` documents go with each. best[j] is the least
    cost of the first j lengths; ties take the earliest cut, and fewer buckets
    where more don't help. The cost of a bucket satisfies the quadrangle
    inequality, so the best cut never moves back as j grows, and each further
    bucket costs n log n steps by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return []
    top = lengths.astype(np.int64)
    docs, tokens = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(top * counts)))
    best = np.concatenate(([0], top * docs[1:] - tokens[1:]))
    cuts, totals = [np.zeros(n + 1, np.int64)], [best[n]]
    for _ in range(1, min(buckets, n)):
        fixed = best + tokens
        new, cut_at = best.copy(), np.zeros(n + 1, np.int64)
        ranges = [(1, n, 0, n - 1)]
        while ranges:
            a, b, low, high = ranges.pop()
            if a > b:
                continue
            j = (a + b) // 2
            last = min(high, j - 1)
            cost = fixed[low : last + 1] - top[j - 1] * docs[low : last + 1]
            i = int(cost.argmin())
            cut_at[j], new[j] = low + i, cost[i] + top[j - 1] * docs[j] - tokens[j]
            ranges += [(a, j - 1, low, cut_at[j]), (j + 1, b, cut_at[j], high)]
        best = new
        cuts.append(cut_at)
        totals.append(best[n])
    k, j, out = int(np.argmin(totals)), n, []
    while j > 0:
        out.append(int(lengths[j - 1]))
        j = int(cuts[k][j])
        k -= 1
    return out[::-1]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``bucket``, ``bucket_length``, ``batch``, ``slot``.

    Batches of a bucket hold max(1, budget // bucket_length) documents and are
    full but for the bucket's last one; a document longer than the budget has
    a batch of its own. Empty and null texts have length 0. Documents stand in
    the order of their shard, then id and text (nulls first). Repeated rows
    get slots of their own; an empty table gives an empty result.
    """
    name = free_name(docs, "length")
    sized = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")).alias("h"), (word_count(F.col(f"`{text}`")) if length is None else length).cast("bigint").alias(name))
    sized = cut(sized)
    histogram = sized.groupBy(F.col(name).alias("edge")).agg(F.count(F.lit(1)).alias("docs")).orderBy("edge").toPandas()
    edges = boundaries(histogram["edge"].to_numpy(np.int64), histogram["docs"].to_numpy(np.int64), buckets)
    index = F.lit(0)
    top = F.lit(edges[-1] if edges else 0)
    for i, edge in reversed(list(enumerate(edges[:-1]))):
        index, top = F.when(F.col(name) <= edge, i).otherwise(index if i < len(edges) - 2 else F.lit(len(edges) - 1)), F.when(F.col(name) <= edge, edge).otherwise(top)
    shards = max(1, int(histogram["docs"].sum()) // SHARD_ROWS)
    placed = sized.withColumns({"bucket": index.cast("int"), "bucket_length": top.cast("bigint"), "shard": F.pmod(F.col("h"), F.lit(shards)).cast("int")})
    placed = placed.groupBy("bucket", "shard", "id", "h", name, "bucket_length").agg(F.count(F.lit(1)).alias("copies"))
    sizes = placed.groupBy("bucket", "shard").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("bucket", "shard").orderBy("id", "h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("local", F.sum("copies").over(upto) - F.col("copies")).join(offsets, ["bucket", "shard"])
    ranked = ranked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
    ranked = ranked.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + COPIES, "copies") - 1)))
    rank = F.col("offset") + F.col("local") + F.col("copy")
    per = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1))
    return ranked.select(F.col("id").alias(doc_id), F.col(name).alias("n_tokens"), "bucket", "bucket_length", F.floor(rank / per).alias("batch"), (rank % per).cast("int").alias("slot"))
