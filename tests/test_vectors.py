from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folium.operators import memory, vectors


def by_pairs(queries, base, k):
    """The same rows from all pairs."""
    q, b = queries.select(F.col("vec_id").alias("query"), F.col("embedding").alias("x")), base.select(F.col("vec_id").alias("neighbour"), F.col("embedding").alias("y"))
    scored = q.crossJoin(b).filter("query <> neighbour").select("query", "neighbour", F.round(memory.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def rows(df):
    return sorted((r["query"], r["rank"], r["neighbour"], repr(r["cosine"] + 0.0)) for r in df.collect())


@pytest.mark.parametrize("text_ids", [False, True])
def test_nearest_vectors_by_all_pairs(spark, monkeypatch, text_ids):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 40)
    monkeypatch.setattr(vectors, "BASE_ROWS", 170)
    rng = np.random.default_rng(3)
    plain = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    copies = [(300 + i, plain[i % 7][1]) for i in range(200)]  # ties go by id
    odd = [(600, None), (601, [1.0, None, 2.0]), (602, [0.0] * 8), (603, [1.0, 2.0]), (604, [2.0, 4.0]), (605, [float("nan")] + [1.0] * 7), (606, [float("inf")] + [1.0] * 7), (607, []), (608, [1e-30] * 8), (None, [1.0] * 8), (5, [1.0] * 8)]
    df = spark.createDataFrame(plain + copies + odd, "vec_id bigint, embedding array<float>").repartition(3)
    if text_ids:
        df = df.withColumn("vec_id", F.concat(F.lit("é"), F.col("vec_id").cast("string")))
    queries = df.filter(F.crc32(F.col("vec_id").cast("string").cast("binary")) % 4 == 0).unionByName(df.filter(F.col("vec_id").cast("string").rlike("60[0-8]$")))
    for k in (1, 5, 600):
        assert rows(memory.nearest_vectors(queries, df, k)) == rows(by_pairs(queries, df, k))


def test_nearest_vectors_of_nothing_and_of_many_copies(spark):
    one = spark.range(9_000).select(F.col("id").alias("vec_id"), F.expr("array(1f, 2f, cast(id % 2 as float))").alias("embedding"))
    assert memory.nearest_vectors(one.limit(0), one, 3).count() == 0
    assert memory.nearest_vectors(one.filter("vec_id = 4"), one.limit(0), 3).count() == 0
    found = memory.nearest_vectors(one.filter("vec_id % 1000 = 4"), one, 3)
    assert {(r["query"], r["neighbour"]) for r in found.filter("query = 4").collect()} == {(4, 0), (4, 2), (4, 6)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_rounding_is_that_of_spark(spark):
    values = [0.0000005, -0.0000005, 0.1234565, 0.1234564999999999, 0.9999995, 1.0, -0.3333335, 0.2500005, 0.0] + np.random.default_rng(1).uniform(-1, 1, 500).tolist()
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert (vectors.millionths(np.array(values)) / vectors.UNIT).tolist() == [w + 0.0 for w in want]
