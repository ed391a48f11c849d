"""Removal of repeated spans against brute force, and its edge cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folium.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def brute(texts, span):
    """Counts every string of ``span`` bytes; spans and the bytes left of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append(([(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    texts = [None, "", "x", "a" * 700, "a" * 300, "ab" * 200, "\0" * 90]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(word() for _ in range(rng.randint(0, 12)))]
        texts.append("".join(parts))
    return texts + texts[-3:]


def got(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    rows = sorted(suffixes.without_repeats(docs, ["id"], **options).collect(), key=lambda r: r["id"])
    return [([tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in rows]


@pytest.mark.parametrize("options", [{"span": 200, "gram": 64}, {"span": 30, "gram": 8, "cell_bytes": 5000}, {"span": 30, "gram": 8, "cell_bytes": 3000, "many": 2, "widths": (5, 1)}, {"span": 40, "gram": 40, "many": 0}])
def test_built_texts(spark, options):
    texts = made(options["gram"])
    assert got(spark, texts, **options) == brute(texts, options["span"])


def test_texts_longer_than_a_step(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(2000))
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [noise(suffixes.STEP - 1000) + passage + noise(90_000), noise(500) + passage[300:] + noise(10), noise(suffixes.STEP * 2)]
    assert got(spark, texts) == brute(texts, 200)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_a_collection(seed):
    rng = random.Random(seed)
    strings = ["".join(rng.choice("ab\0é") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["", "abab" * 9]
    raw = [s.encode() for s in strings]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in raw])))
    for span in (1, 5, 9):
        seen = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
        expected = [i + span <= len(b) and seen[b[i : i + span]] > 1 for b in raw for i in range(len(b))]
        assert suffixes.repeats(np.frombuffer(b"".join(raw), np.uint8), offsets, span).tolist() == expected


def test_equal_spans_share_an_anchor():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[3000:3500] = data[1000:1500]
    r = suffixes.regions_of(data, np.array([0, 2500, 5000]), 200, 64)
    assert r.spans.sum() == 2 * (2500 - 199)
    of = {int(f + i): (int(g), int(a - f - i)) for f, n, a, g in zip(r.first, r.spans, r.anchor, r.gram, strict=True) for i in range(n)}
    assert all(of[1000 + i] == of[3000 + i] for i in range(301))


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "short", "y"), (4, "long text " * 40, "z"), (4, "long text " * 40, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    out = {(r["doc_id"], r["key"], bytes(r["kept"])) for r in suffixes.without_repeats(docs, ["doc_id", "key"]).collect()}
    assert out == {(1, "x", b""), (2, None, b""), (3, "y", b"short"), (4, "z", b"")}
    assert suffixes.without_repeats(docs.limit(0), ["doc_id"]).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {r["doc_id"]: x for r, x in zip(rows, brute([r["text"] for r in rows], 200), strict=True)}
    out = queries.op11_suffix_array_dedup(spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        spans, kept = expected[r["doc_id"]]
        assert (r["n_spans"], r["n_removed"], r["kept_sha256"]) == (len(spans), sum(b - a for a, b in spans), hashlib.sha256(kept).hexdigest())
        assert r["n_bytes"] == r["n_removed"] + len(kept)
