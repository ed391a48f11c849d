"""Decontamination against brute force over all windows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folium.llm import decontam


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(words, width):
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(docs, items, similarity=0.8):
    """Best window (first of equal ones) of every document and item at or over the similarity."""
    out = {}
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            if not v:
                continue
            width = min(5, len(v))
            want = bag(v, width)
            for start in range(max(len(w) - len(v), 0) + 1):
                have = bag(w[start : start + len(v)], width)
                common = sum((want & have).values())
                s = common / (want.total() + have.total() - common)
                if s >= similarity and s > out.get((d, i), (0,))[0]:
                    out[d, i] = (s, start)
    return {k: (round(s, 6), start) for k, (s, start) in out.items()}


def found(spark, docs, items):
    got = decontam.find_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["word_start"]) for r in got.collect()}


def test_all_windows_of_edited_passages(spark):
    """Inserted, dropped, moved, replaced and repeated words around the threshold: recall is 1."""
    rng = np.random.default_rng(8)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    items = [(i, " ".join(draw(int(n)))) for i, n in enumerate([1, 3, 5, 6, 9, 20, 40, 60, 90])] + [(9, " ".join(["again"] * 30)), (10, "!!"), (11, None)]
    docs = []
    for d in range(120):
        words = items[d % 10][1].split()
        for _ in range(int(rng.integers(0, 4))):
            at, kind = int(rng.integers(0, len(words) + 1)), int(rng.integers(0, 4))
            if kind == 0:
                words[at:at] = draw(1)
            elif kind == 1 and len(words) > 1:
                words.pop(min(at, len(words) - 1))
            elif kind == 2 and at < len(words):
                words[at] = draw(1)[0]
            else:
                words = words[at:] + words[:at] if len(words) > 30 and at < 3 else words
        docs.append((d, " ".join(draw(int(rng.integers(0, 30))) + words + draw(int(rng.integers(0, 30))))))
    docs += [(200, None), (201, ""), (202, f"{items[6][1]} x {items[6][1]}"), (203, items[8][1][:-20]), (204, "again " * 500)]
    want = brute(docs, items)
    assert found(spark, docs, items) == want and len(want) > 60 and {len(words_of(dict(items)[i])) for _, i in want} >= {1, 3, 5, 6, 20, 90}


def test_sample_tables_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    near = [(d, t) for d, t in docs if len(t or "") < 20_000]
    assert found(spark, near, items) == brute(near, items)


def test_counters_hold_more_than_sixteen_bits(spark):
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 70_000)
    got = spark.createDataFrame([(h.tolist(),)], "h array<bigint>").select(decontam.simhash("h").alias("f")).first()["f"]
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert got % (1 << 64) == sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(h))


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0.5), (1, "a b c d e f", 0.5), (1, "other", 0.1), (None, "a b c d e f", 0.2)], "doc_id bigint, text string, similarity double")
    items = spark.createDataFrame([(7, "A, b; c d e f!", 1)], "item_id bigint, text string, doc_key int")
    out = decontam.find_matches(docs.withColumn("start", F.lit(1)), items).select("doc_id", "item_id", "similarity").collect()
    assert sorted(map(tuple, out), key=str) == [(1, 7, 1.0), (None, 7, 1.0)]
    kept = decontam.drop_contaminated(docs, items)
    assert [tuple(r) for r in kept.collect()] == [(1, "other", 0.1)] and kept.columns == docs.columns
