"""Brute-force and edge-case tests of the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folium.llm import decontam, licenses, lm, packing, pii, quality, queries, rules, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "x"), (2, None, "y"), (3, "", None), (None, "alpha beta", "z"), (4, "same text here", "q"), (4, "same text here", "q"), (5, "w " * 30_000, "long")]
SCHEMA = "doc_id bigint, text string, Score string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_classifiers_keep_rows_and_learn(spark, edge):
    rows = [("you rotten hateful fool " * 3, 1), ("a calm and pleasant day " * 3, 0)] * 30
    for operator, fit_rows in ((toxicity, rows), (quality, [(t.encode(), y) for t, y in rows])):
        model = operator.fit(fit_rows)
        for df, n in ((edge, len(EDGE)), (edge.limit(0), 0)):
            out = operator.score(df, model, name="score_")
            assert out.count() == n and out.columns == [*df.columns, "score_"]
        got = [r["score_"] for r in operator.score(edge, model, name="score_").collect()]
        assert all(0 <= s <= 1 for s in got) and got[1] == got[2] and got[4] == got[5]
    assert toxicity.fit([]).score("x", toxicity.Distinct(20)) == pytest.approx(0.5)


@pytest.mark.parametrize("name", ["op1_toxicity", "op9_quality_classifier"])
def test_held_out_accuracy(spark, name):
    label = "toxic" if name.startswith("op1") else "quality"
    d = SF.replace("0.001", "0.01")
    out = queries.queries()[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("score", label).toPandas()
    pos, neg = out[out[label] == 1]["score"].to_numpy(), out[out[label] == 0]["score"].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean() > 0.8


LOWERED = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def lm_words(t):
    return [*SPACE.findall(LOWERED(t)), None]


def test_lm_counts_and_scores_by_brute_force(spark, docs, monkeypatch):
    import zlib

    learned = []
    weights = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: learned.append(weights(*a)) or learned[-1])
    out = {r["doc_id"]: r for r in queries.op3_lm_scoring(spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts(docs)}
    words = {i: lm_words(t) for i, t in texts(docs).items()}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    begin = object()
    pairs = Counter((v, w) for i, ws in words.items() if not held[i] for v, w in zip([begin, *ws[:-1]], ws))
    context = c | Counter({begin: sum(not h for h in held.values())})
    n, v = sum(c.values()), len(c)

    def mixture(before, w):
        cv = context[before]
        a, u, o = learned[-1][0 if cv == 0 else min(cv.bit_length(), lm.LEVELS - 1)]
        return a * (pairs[before, w] / cv if cv else 0) + u * c[w] / n + o / (v + 1)

    for i, ws in words.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] == pytest.approx(sum(np.log10(mixture(b, w)) for b, w in zip([begin, *ws[:-1]], ws)), rel=1e-9)
    mine = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in mine) > sum(r["base_score"] for r in mine)


def test_lm_tree_changes_no_result(spark, docs):
    part = docs.filter("doc_id < 60").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "x" * 600_000 + " y"), (-2, None), (-3, "")], "doc_id bigint, text string"))
    train = F.col("doc_id") % 3 > 0
    one, deep = (lm.score(part, train, ["doc_id"], **kw).orderBy("doc_id").toPandas() for kw in ({}, {"chunk_bytes": 10_000, "fan": 2}))
    for name in one:
        assert np.allclose(one[name], deep[name], rtol=1e-12), name


def test_lm_edge_values(spark, edge):
    """Null and blank texts are the end token; repeats score alike; other columns may clash."""
    out = lm.score(edge.withColumn("score", F.lit("s")).withColumn("k0", F.lit(1)), F.lit(True), ["doc_id", "k0"]).collect()
    n = {(r["doc_id"], r["n_tokens"], r["n_known"]) for r in out}
    assert n == {(1, 11, 11), (2, 1, 1), (3, 1, 1), (None, 3, 3), (4, 4, 4), (5, 30_001, 30_001)} and len({r["score"] for r in out if r["doc_id"] == 4}) == 1
    none = lm.score(edge, F.lit(False), ["doc_id"]).collect()
    assert all(r["n_known"] == r["train_tokens"] == r["base_score"] == 0 and -1e6 < r["score"] <= 0 for r in none)


def test_lm_edges(spark, edge):
    out = lm.score(edge, F.lit(True), ["doc_id"]).collect()
    assert len(out) == len(EDGE)
    assert lm.score(edge.limit(0), F.lit(True), ["doc_id"]).count() == 0


def base_of(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(x) for x in m.group() if x.isdigit()]
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(x.isdigit() for x in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_pii_base_by_brute_force(spark, docs):
    for r in queries.op4_pii(spark, SF).collect():
        want = base_of(texts_cache(docs)[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]


_cache: dict = {}


def texts_cache(docs):
    return _cache.setdefault("t", texts(docs))


def test_pii_masks(spark, edge):
    crf = pii.train(pii.labelled_table(spark))
    one = spark.createDataFrame([(1, "write to ann@example.com now", 5), (2, None, 0)], "doc_id bigint, text string, pii_spans int")
    assert [tuple(r) for r in pii.mask(one, crf).orderBy("doc_id").collect()] == [(1, "write to [EMAIL] now", 5), (2, None, 0)]
    assert pii.mask(edge, crf).count() == len(EDGE)
    assert pii.find(edge.limit(0), crf).count() == 0


def fingerprint_of(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not w:
        return 0
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(spark, docs):
    want = {i: fingerprint_of(t) for i, t in texts(docs).items()}
    root = {i: i for i in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(want)
    for a in keys:
        for b in keys:
            if a < b and (want[a] ^ want[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_groups(spark, SF).collect()}
    assert got == {i: (f"{want[i]:016x}", find(i)) for i in want}


def test_simhash_keeps_one_of_each(spark, edge):
    kept = simhash.drop_near_duplicates(edge)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]
    assert simhash.drop_near_duplicates(edge.limit(0)).count() == 0


def test_decontamination_edges(spark, edge):
    items = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta."), (2, None), (3, "")], "item_id bigint, text string")
    found = decontam.find_matches(edge, items).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"], r["word_start"]) for r in found] == [(1, 1, 1.0, 0)]
    kept = decontam.drop_contaminated(edge, items)
    assert kept.count() == len(EDGE) - 1 and kept.columns == edge.columns
    assert decontam.find_matches(edge.limit(0), items).count() == 0 and decontam.find_matches(edge, items.limit(0)).count() == 0


def test_licence_edges(spark, edge):
    df = spark.createDataFrame([(1, "Intro line\nReleased under the MIT License!\nmore"), (2, None), (3, "released")], "doc_id bigint, text string")
    out = licenses.scan(df, licenses.template_table(spark)).collect()
    assert {(r["doc_id"], r["license"]) for r in out} == {(1, "MIT")} and max(r["dice"] for r in out) == 1.0
    assert licenses.scan(edge, licenses.template_table(spark)).count() == 0


NOTICES = [
    ("Some parts of the code we ship are released under the MIT License.", "MIT"),
    ("It was written in the spring, and licensed under the MIT License as agreed by all of the authors.", "MIT"),
    ("In the end of the day, of the many files in the tree, this work is licensed under the GNU General Public License, version 3, and the rest of the tree is not.", "GPL-3.0"),
    ("of the and the in the this is free and unencumbered software\nreleased into the public domain of the in the and the", "Unlicense"),
    ("The text of the work: this work is licensed under a Creative Commons\n\nAttribution 4.0 International License. The rest of the text of the work.", "CC-BY-4.0"),
    ("By the terms of the board, use of this source code is governed by a BSD style license that can be found in the license file of the tree.", "BSD-3-Clause"),
    ("The library of the house: this library is licensed under the GNU Lesser General Public License, version 3. End of the note.", "LGPL-3.0"),
    ("Under the roof of the house the works, Licensed under CC BY-NC 4.0, were in the box under the bed.", "CC-BY-NC-4.0"),
    ("It is to be said that this program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 in the end.", "EPL-2.0"),
    ("To the reader: to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. To the end.", "CC0-1.0"),
    ("Part of the tree\nis Licensed under the\nApache License,\nVersion 2.0.\nof the tree", "Apache-2.0"),
    ("In the file of the tree this program is licensed under the GNU Affero General Public License, version 3. Of the tree, in the file.", "AGPL-3.0"),
]
CLEAN = ["The license of the driver was found under the seat of the car.", "He spoke of the terms of the board, of the public and of the general rule in the file.", "of the in the under the of the terms of the " * 30, "A creative work of the commons is licensed by the state."]


def test_licence_notices_inside_prose(spark):
    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)] + [(100 + i, f"{'the in of the word ' * 300}{t} {'of the in the under the terms of the ' * 300}") for i, (t, _) in enumerate(NOTICES)] + [(200 + i, t) for i, t in enumerate(CLEAN)]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), licenses.template_table(spark)).collect()}
    assert found >= {(k, name) for i, (_, name) in enumerate(NOTICES) for k in (i, 100 + i)}
    # licences of one family have notices that are alike; nothing else is found
    assert all(name.startswith("CC-BY") and NOTICES[k % 100][1] == "CC-BY-4.0" for k, name in found if k >= 200 or name != NOTICES[k % 100][1])


def test_licence_bodies_wrapped_and_inside_lines(spark):
    """A wrapped body, notices inside prose and edited ones are found; repeats count once a row, and columns may clash."""
    body = next(t for k, t in licenses.TEMPLATES if k == "BSD-3-Clause" and len(t) > 1_000)
    wrapped = "\n".join(" ".join(body.split()[i : i + 9]) for i in range(0, len(body.split()), 9))
    inside = "Once upon a time this work is licensed under a Creative Commons Attribution 4.0 International License and nobody minded at all."
    df = spark.createDataFrame([(1, "intro words\n" + wrapped + "\nmore words"), (2, inside), (2, inside), (3, (inside + "\n") * 3), (4, "plain " * 200_000), (None, body.replace("binary", "compiled"))], "doc_id bigint, text string").withColumn("license", F.lit("x"))
    out = sorted((str(r["doc_id"]), r["dice"], r["license"]) for r in licenses.scan(df, licenses.template_table(spark)).collect())
    assert {d: (k, s) for d, s, k in out} | {"None": None} == {"1": ("BSD-3-Clause", 1.0), "2": ("CC-BY-4.0", 1.0), "3": ("CC-BY-4.0", 1.0), "None": None}
    assert {k for d, _, k in out if d == "None"} >= {"BSD-3-Clause"} and [x[0] for x in out].count("2") == 2 * [x[0] for x in out].count("3")


def test_url_lists_hold_as_of_the_fetch_day(spark):
    entries = spark.createDataFrame([("bad.com", "block", "2024-01-10"), ("bad.com", "allow", "2024-02-10"), ("ok.bad.com", "allow", "2024-01-20"), (None, "block", "2024-01-01")], "domain string, action string, since string")
    pages = spark.createDataFrame([(1, "http://bad.com/x", "2024-01-09"), (2, "http://bad.com/x", "2024-01-10"), (3, "http://a.bad.com", "2024-02-10"), (4, "http://ok.bad.com", "2024-01-15"), (5, "http://ok.bad.com", "2024-01-25"), (6, None, "2024-01-25"), (7, "http://bad.com", None)], "page_id int, url string, fetched string")
    out = {r["page_id"]: (r["matched_domain"], r["blocked"]) for r in urls.judge(pages, entries, ["page_id"]).collect()}
    assert out == {1: (None, False), 2: ("bad.com", True), 3: ("bad.com", False), 4: ("bad.com", True), 5: ("ok.bad.com", False), 6: (None, False), 7: (None, False)}
    assert urls.judge(pages.limit(0), entries, ["page_id"]).count() == 0


@pytest.mark.parametrize("longest, k", [(40, 3), (5_000, 3), (3_000_000, 4)])
def test_buckets_are_optimal(longest, k):
    from itertools import combinations

    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(longest, 14, replace=False)).astype(np.int64)
    counts = rng.integers(1, 9, 14)
    cost = lambda edges: sum(int(c) * (min(e for e in edges if e >= n) - int(n)) for n, c in zip(lengths, counts))
    best = min(cost((*map(int, inner), int(lengths[-1]))) for m in range(k) for inner in combinations(lengths[:-1], m))
    assert cost(packing.boundaries(lengths, counts, k)) == best


def test_packing_ties_and_repeats(spark):
    """Lengths beyond 2,048 are boundaries of their own; equal rows get slots of their own."""
    docs = spark.createDataFrame([(1, "w " * 2_051)] * 3 + [(2, "w " * 2_049), (None, None), (3, "")], "doc_id bigint, text string")
    out = packing.pack(docs, buckets=3, budget=4_200).toPandas()
    assert sorted(set(out["bucket_length"])) == [0, 2_049, 2_051] and len(out) == 6 and not out.duplicated(["bucket", "batch", "slot"]).any()
    assert sorted(out[out["n_tokens"] == 2_051]["batch"]) == [0, 0, 1]


def test_batches_are_full_and_whole(spark, edge):
    out = queries.op6_packing(spark, SF).toPandas()
    assert out["doc_id"].is_unique and not out.duplicated(["bucket", "batch", "slot"]).any()
    assert (out["n_tokens"] <= out["bucket_length"]).all()
    for (_, top), part in out.groupby(["bucket", "bucket_length"]):
        sizes = part.groupby("batch").size()
        per = max(1, packing.BUDGET // max(top, 1))
        assert (sizes.iloc[:-1] == per).all() and sizes.iloc[-1] <= per
    assert packing.pack(edge).count() == len(EDGE) and packing.pack(edge.limit(0)).count() == 0


def test_rule_order_changes_no_verdict(spark, edge):
    t = F.coalesce(F.col("text"), F.lit(""))
    from folium.llm.common import words_of

    verdicts = [edge.select(rules.verdict(list(order), t, words_of(t)).alias("k")).collect() for order in (rules.RULES, rules.RULES[::-1])]
    assert verdicts[0] == verdicts[1]
    assert rules.apply_rules(edge).count() == len(EDGE) and rules.apply_rules(edge.limit(0)).count() == 0
    assert rules.ordered([("a", 1.0, 0.5), ("b", 0.1, 0.5)], tuple(rules.Rule(n, None) for n in "ab"))[0].name == "b"
    counted = rules.digest(edge.withColumn("n_lines", F.lit("clash")))
    assert counted.select(rules.verdict(list(rules.counted_rules()), t, words_of(t)).alias("k")).collect() == verdicts[0]
    none = rules.apply_rules(edge, name="score", facts=rules.digest, rejected=F.col("n_words") > 4)
    assert [r["score"] for r in none.filter("n_words > 4").collect()] == [False, False]


def test_a_costly_rule_goes_last(spark, docs):
    """Of rules that reject alike, one that does twenty times the work is found to cost more."""
    short = lambda t, w: F.length(t) < 800
    slow = lambda t, w: F.length(F.regexp_replace(F.repeat(t, 20), "[aeiou]+", "")) < 8_000
    made = (rules.Rule("a_slow", slow), rules.Rule("b_quick", short))
    found = rules.measure(docs, "text", made, 80, lambda df: df)
    assert [r.name for r in rules.ordered([(n, s, 0.5) for n, s, _ in found], made)] == ["b_quick", "a_slow"]


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("toxicity", F.lit(1))
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, state, SF)
        assert name == "packing" or new.columns == docs.columns
        state = new
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in state.collect()}


def shingle_set(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def kept_by_brute_force(rows):
    """Least id of each group that exact similarities of 0.8 or more connect."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


@pytest.mark.parametrize("tile_rows, frequent", [(4_096, 200_000), (3, 200_000), (4_096, 1)])
def test_near_copies_at_similarity_by_brute_force(spark, monkeypatch, tile_rows, frequent):
    from folium.llm import shingles

    monkeypatch.setattr(shingles, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(shingles, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    line = [f"common{i}" for i in range(40)]
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 500, rng.integers(3, 120))] + line * int(i % 3 == 0)
        rows.append((10 * i, " ".join(words)))
        for c in range(1, 4):
            edited = list(words)
            for at in rng.integers(0, len(words), rng.integers(0, 5)):
                edited[at] = f"Edit{rng.integers(0, 9)}"
            rows.append((10 * i + c, "  ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert got == kept_by_brute_force(rows)


def test_near_copies_come_from_fingerprints_first(spark, monkeypatch):
    """The stage searches SimHash fingerprints of the shingle sets, and what they propose is verified by the exact sets."""
    from folium.llm import shingles

    searched, checked = [], []
    links, exact = simhash.links, shingles.Search.exact
    monkeypatch.setattr(simhash, "links", lambda prints, *more: searched.append({r["fp"] for r in prints.collect()}) or links(prints, *more))
    monkeypatch.setattr(shingles.Search, "exact", lambda self, pairs: checked.append((pairs.count(), (found := exact(self, pairs)).count())) or found)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "of another text these are the words"), (4, "but the very same"), (5, "BUT the  very same"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {1, 3, 4, 6}
    assert len(searched) == 1 and len(searched[0]) >= 4 and checked[0] == (1, 1)
    parts = [h for _, _, h in shingles.shingle_sets(pa.array([" ".join(words)]), 5)][0]
    bits = np.unpackbits(parts.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > len(parts)
    assert int(np.packbits(bits, bitorder="little").view(np.int64)[0]) in searched[0] and 0 in searched[0]


def test_one_row_very_often(spark):
    """A row repeated more often than a chunk, shard or array of copies holds."""
    text, n = "the same row of words " * 3, 100_000
    docs = spark.range(n).select(F.lit(7).alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(1, "other words of a row"), (2, None)], "doc_id int, text string"))
    packed = packing.pack(docs, budget=64).groupBy("bucket", "batch", "slot").count()
    assert packed.count() == n + 2 and packed.filter("count > 1").count() == 0
    scored = lm.score(docs, F.lit(True), ["doc_id"], chunk_bytes=1_000, fan=3)
    rows = scored.groupBy("doc_id", "score", "train_tokens").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {7: n, 1: 1, 2: 1} and {r["train_tokens"] for r in rows} == {n * 16 + 6 + 1}


def test_long_lists_and_tiles_of_fingerprints(spark, monkeypatch):
    """Runs of equal blocks beyond the short ones, dealt to tiles, link as brute force does."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(900)]
    prints = np.unique(np.array([base[i % 6] ^ f for i, f in enumerate(flips)], np.uint64))
    monkeypatch.setattr(simhash, "TILE_ROWS", 50)
    monkeypatch.setattr(simhash, "SHORT_RUN", 8)
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(table, "fp", 4, 24).collect()}
    differ = np.bitwise_count(prints[:, None] ^ prints[None, :])
    close = {(int(min(a, b)), int(max(a, b))) for a, b in ((prints.view(np.int64)[i], prints.view(np.int64)[j]) for i, j in np.argwhere((differ <= 4) & (differ > 0)))}
    parent = {int(x): int(x) for x in prints.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    assert got <= close
    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(a) == find(b) for a, b in close)


def test_url_cases(spark):
    """Hosts without a scheme, repeated captures, two entries on one day, old entries, and columns whose names clash."""
    hosts = {"//Host.example/path": "host.example", "host.example:80/x": "host.example", "http://u@h.example./": "h.example", "": "", None: "", "mailto:x": "mailto:x"}
    got = spark.createDataFrame([(u,) for u in hosts], "u string").select("u", urls.host_of(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in got if r["u"] != "mailto:x"} == {u: h for u, h in hosts.items() if u != "mailto:x"}
    entries = spark.createDataFrame([("a.example", "allow", "2020-01-05"), ("a.example", "block", "2020-01-05"), ("b.example", "block", "1990-01-01"), ("b.example", "allow", "2024-02-01"), ("c.example", "block", "2031-01-01"), (None, "block", "2020-01-01")], "domain string, action string, since string")
    rows = [(1, "//a.example/x", "2024-01-10", "d"), (1, "//a.example/x", "2024-01-10", "e"), (2, "http://w.b.example/", "2024-01-31", "d"), (3, "http://b.example/", "2024-02-01", "d"), (4, "http://c.example/", "2024-03-01", "d"), (5, None, "2024-03-01", "d"), (6, "http://a.example/", None, "d")]
    captures = spark.createDataFrame(rows, "id int, url string, fetched string, domain string")
    out = {r["id"]: (r["matched_domain"], r["action"], r["blocked"]) for r in urls.judge(captures, entries, ["id"]).collect()}
    assert out == {1: ("a.example", "block", True), 2: ("b.example", "block", True), 3: ("b.example", "allow", False), 4: (None, None, False), 5: (None, None, False), 6: (None, None, False)}
    assert urls.judge(captures, entries, ["id"]).count() == 6 and urls.judge(captures.limit(0), entries, ["id"]).count() == 0


def test_toxic_stage_keeps_what_it_cannot_judge(spark, docs):
    """Null and empty texts stay, repeated rows stay repeated, an empty table gives an empty result."""
    import corpus_pipeline

    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a calm day by the sea", "en", "s", 21), (3, "a calm day by the sea", "en", "s", 21)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_toxic(spark, docs.unionByName(odd.withColumn("doc_id", -F.col("doc_id"))), SF).filter("doc_id < 0")
    assert sorted(r["doc_id"] for r in kept.collect()) == [-3, -3, -2, -1]
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), SF).count() == 0


def test_the_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
