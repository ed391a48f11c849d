"""Collocations against counts of all phrases, and their edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folium.llm import phrases, queries
from folium.llm.common import column_bytes

SF = "/root/testdata/sf0.001"


def pieces_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered)) if w]


def brute(rows, most=3, least=10, inside=50, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for words in pieces_of(text):
            f[lang or "und"].update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        around = Counter()
        for g, c in candidates.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        around[g[i:j]] = max(around[g[i:j]], c)
        kept = []
        for g, a in candidates.items():
            if not around[g] or 100 * around[g] < inside * a:
                score, cut = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                kept.append((lang, " ".join(g), a, counts[g[:cut]], counts[g[cut:]], n, score))
        kept.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i, *x[1:]) for i, x in enumerate(kept[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Ünder", "über", "d\x0be", "x\xa0y", "g", "h"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!?", "\r\n"]) for _ in range(rng.randint(0, 40)))
    return [(text(), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" . ", "fr")]


@pytest.mark.parametrize(("most", "block_bytes"), [(3, 1 << 24), (3, 300), (2, 2000), (4, 2000)])
def test_built_texts(spark, most, block_bytes):
    rows = made(most)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert got(phrases.collocations(docs, most=most, block_bytes=block_bytes)) == brute(rows, most)


def test_ranks_and_repeated_rows(spark):
    rows = [("one two three", "en")] * 10_000 + [("one two. two three", "en")] * 5000 + made(9, 50)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(phrases.collocations(docs, least=3, top=7, block_bytes=20_000)) == brute(rows, least=3, top=7)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b " * 30, "en", 5)], "id int, text string, lang string, f int")
    assert got(phrases.collocations(docs)) == brute([("a b " * 30, "en")])
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.filter("id = 1").selectExpr("cast(null as string) text", "lang")).count() == 0


def test_lists_round_trip():
    texts = [t for t, _ in made(1, 60)]
    words, positions = phrases.word_positions(*column_bytes(pa.array(texts)))
    plain = [p for t in texts for p in pieces_of(t)]
    assert words.to_pylist() == [w for p in plain for w in p] and (np.diff(positions) > 1).sum() == len(plain) - 1
    distinct, sizes, gaps = phrases.inverted(words, positions)
    back = phrases.opened(sizes, gaps)
    assert sorted(zip(back, np.repeat(distinct.to_pylist(), sizes), strict=True)) == list(zip(positions, words.to_pylist(), strict=True))


def test_products_past_64_bits(spark):
    big = 10**14 - 3
    row = spark.createDataFrame([(big, [big, big + 1], [big + 2, big])], "f bigint, heads array<bigint>, tails array<bigint>")
    s = row.select(phrases._best_cut(2).alias("x")).first()["x"]
    assert s["score"] == 1000000 * big * big // (big * (big + 2))


def test_query(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op12_collocations(spark, SF)) == brute(rows)
