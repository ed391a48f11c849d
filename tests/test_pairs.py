from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folium.operators import matching, pairs


def brute(mentions: list[tuple], evidence: int) -> list[tuple]:
    units, held = defaultdict(set), defaultdict(list)
    for unit, name in mentions:
        units[unit].add(name)
    for unit in sorted(units):
        for a in units[unit]:
            for b in units[unit]:
                if a < b:
                    held[a, b].append(unit)
    return sorted((a, b, len(u), u[:evidence]) for (a, b), u in held.items())


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("a", "b", "n", "evidence").collect()))


def shuffled(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("strip, batch, held", [(1_536, 1 << 20, 1 << 26), (3, 1 << 20, 1 << 26), (3, 7, 250)])
def test_cells_count_as_brute_force_does(spark, monkeypatch, strip, batch, held):
    """One strip or several, pairs made in one go or a few at once, few blocks or more; units out of order, negative and at both ends of their kind."""
    monkeypatch.setattr(pairs, "STRIP", strip)
    monkeypatch.setattr(pairs, "HELD", held)
    monkeypatch.setattr(pairs, "PAIRS", batch)
    monkeypatch.setattr(pairs, "ROWS", 11)
    rng = random.Random(7)
    for names, kind in ((1, "bigint"), (23, "bigint"), (40, "int")):
        ends = [-(1 << 63), (1 << 63) - 1] if kind == "bigint" else [-(1 << 31), (1 << 31) - 1]
        units = [*ends, *rng.sample(range(-10_000, 10_000), 90)]
        mentions = [(u, min(int(rng.paretovariate(0.4)) - 1, names - 1)) for u in units for _ in range(rng.choice((1, 5, 30)))]
        lists = spark.createDataFrame(mentions, f"unit {kind}, id int").groupBy("unit").agg(F.collect_set("id").alias("names"))
        for evidence in (1, 3, 8):
            out = pairs.by_cells(lists, names, len(mentions), evidence)
            assert rows(out) == rows(pairs.by_rows(lists, evidence)) == brute(mentions, evidence)
            assert out.schema["evidence"].dataType.elementType.simpleString() == kind


def test_numbers_are_dense(spark):
    got = pairs.numbered(spark.range(0, 900, 3).withColumn("key", F.col("id").cast("string")).drop("id"), "key").collect()
    assert sorted(r["id"] for r in got) == list(range(300)) and len({r["key"] for r in got}) == 300
    assert pairs.numbered(spark.createDataFrame([], "key string"), "key").count() == 0


def test_pairs_of_crowded_units_are_not_shuffled_one_by_one(spark):
    """40 names in each of 200 units are 8,000 mentions and 156,000 pairs."""
    mentions = spark.range(200).select(F.col("id").alias("unit"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("name"), ((F.col("id") * 3 + i * 7) % 60).cast("string")))).alias("name"))
    before = shuffled(spark)
    got = rows(matching.co_occurrence(mentions, "unit", "name"))
    assert got == brute([tuple(r) for r in mentions.collect()], 8)
    assert shuffled(spark) - before < 3 * 8_000


def test_units_that_are_texts_and_rare_pairs_are_rows(spark):
    mentions = [(f"u{u:03}", f"n{(u * i) % 31}") for u in range(60) for i in range(9)] + [(None, "n1"), ("u000", None)]
    got = rows(matching.co_occurrence(spark.createDataFrame(mentions, "unit string, name string"), "unit", "name"))
    assert got == brute([m for m in mentions if None not in m], 8)
    assert matching.co_occurrence(spark.createDataFrame([], "unit bigint, name string"), "unit", "name").count() == 0
