"""Periodic runs against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folium.llm import periods, queries
from folium.llm.common import column_bytes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Every stretch of every lag; one with a lesser period is left out."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(words[i + p : j + q] == words[i : j + q - p] for p in range(1, q)):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapse(words, runs):
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_texts():
    rng = random.Random(3)
    out = ["", None, " \n ", "one", "ab " * 11, "ab " * 12, "x y " * 6 + "x", "Ab ab " * 9, "ü é " * 13]
    for t in range(160):
        words = [rng.choice("abcdefgh"[: 2 + t % 7]) for _ in range(rng.randint(0, 80))]
        for _ in range(t % 4):
            a, p = rng.randint(0, len(words)), rng.randint(1, 9)
            words[a:a] = words[a : a + p] * rng.randint(1, 7)
        out.append("\t".join(words))
    return out


@pytest.mark.parametrize("heavy_from", [None, 2])
def test_runs_of_built_texts(spark, monkeypatch, heavy_from):
    texts = made_texts()
    if heavy_from:  # most words by transforms
        monkeypatch.setattr(periods, "border", lambda n: heavy_from)
        monkeypatch.setattr(periods, "HELD", 50)
        ids, first, _ = periods.word_ids(*column_bytes(pa.array(texts)))
        assert periods.runs_of(ids, first) == [brute(WORD.findall(t or "")) for t in texts]
        return
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    for r in periods.periodic_runs(docs).collect():
        words = WORD.findall(texts[r["id"]] or "")
        runs = brute(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapse(words, runs)


def test_counts_of_lags():
    ids = np.random.default_rng(2).zipf(1.5, 3000) % 50
    found, base = periods.lag_matches(ids, np.array([0, 1000, 1000, 3000]))
    for a, b, at in ((0, 1000, 0), (1000, 3000, base[2])):
        own = ids[a:b]
        assert all(found[at + q] == (own[q:] == own[:-q]).sum() for q in range(1, (b - a) // 2 + 1))


@pytest.mark.parametrize("period", [1, 7, 1000, 90_000])
def test_a_long_text_takes_seconds(period):
    n = 200_000
    assert periods.runs_of((np.arange(n) % period).astype(np.int32), np.array([0, n])) == [[(0, n, period)]]
    many = np.arange(n) // 12  # as many runs as can be
    assert len(periods.runs_of(many, np.array([0, n]))[0]) == n // 12


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "a b " * 20, "y"), (3, "a b " * 20, "y"), (3, "a b " * 20, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _words string")
    out = periods.periodic_runs(docs)
    assert out.columns == [*docs.columns, "runs", "collapsed"] and sorted(len(r["runs"]) for r in out.collect()) == [0, 0, 1, 1, 1]
    assert periods.periodic_runs(docs.limit(0)).count() == 0 and periods.with_planted_period(docs, "doc_id").columns == docs.columns
    with pytest.raises(ValueError, match="columns already"):
        periods.periodic_runs(docs.withColumnRenamed("_words", "RUNS"))


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op13_periodic_runs(spark, SF).collect()
    assert len(out) == len(docs)
    planted = 0
    for r in out:
        words, h = WORD.findall(docs[r["doc_id"]] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if len(words) > 1500:
            continue  # brute force is too slow for these; the built texts cover long ones
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 10
