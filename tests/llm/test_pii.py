"""The field of personal data against enumeration, finite differences and held-out rows; patterns on hostile texts."""

from __future__ import annotations

import random
import time
from itertools import product

import numpy as np
import pytest

from folium.llm import pii
from tests.llm.test_llm import base_of


@pytest.fixture(scope="module")
def crf():
    return pii.fit(pii.training_rows())


def test_patterns_equal_the_contract_on_random_texts():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0129.@a-+ (") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == base_of(text), text


@pytest.mark.parametrize("text", ["0" * 5_000 + ".1.1.1", "7" * 1_000_000, "a" * 1_000_000 + "@", "1." * 300_000, "a@" * 300_000, "+1(" * 300_000, "1-" * 300_000, "x" * 1_000_000 + " 12 " + "y" * 1_000_000, "(" * 1_000_000 + "1", "1" + ")" * 1_000_000, "()" * 500_000 + "1", "(" * 500_000 + "12" + ")" * 500_000])
def test_long_texts_take_linear_time(crf, text):
    began = time.perf_counter()
    pii.merge(pii.base_spans(text), pii.Tagger(crf).spans([text])[0])
    assert time.perf_counter() - began < 30


def slow_core(word):
    a, b = 0, len(word)
    while a < b and word[a] in pii.OPEN and not (word[a] == "(" and ")" in word[a + 1 : b - 1]):
        a += 1
    while b > a and word[b - 1] in pii.CLOSE and not (word[b - 1] == ")" and "(" in word[a:b]):
        b -= 1
    return a, b


def test_core_finds_partners_of_brackets():
    for n in range(8):
        for letters in product("()1.", repeat=n):
            word = "".join(letters)
            assert pii.core(word) == slow_core(word), word


def test_masked_text_is_built_in_one_pass(crf):
    text = "write to a.b@example.com or " * 100_000
    began = time.perf_counter()
    spans = pii.all_spans(pii.Tagger(crf), [text])[0][1]
    out = pii.masked(text, spans)
    assert time.perf_counter() - began < 60 and len(spans) == 100_000 and out == "write to [EMAIL] or " * 100_000
    assert pii.masked("abcdefgh", [(1, 0, 5), (2, 1, 3), (4, 1, 6), (7, 3, 8)]) == "a[EMAIL]g[PHONE]"


def test_numbers_beyond_the_limit_of_int():
    assert pii.base_spans("0" * 5_000 + ".1.1.1") == [(0, 1, 5_006)]
    assert not pii.plausible("ip", "9" * 5_000 + ".1.1.1")


def test_merge_sees_every_base_span():
    base = [(0, 0, 1_000), *[(i, 2, i + 1) for i in range(1, 200)]]
    assert pii.merge(base, [(900, 3, 910), (1_000, 3, 1_010), (990, 3, 1_200)]) == sorted([*base, (1_000, 3, 1_010)])
    rng = random.Random(2)
    for _ in range(300):
        base, more = ([(a, k, a + rng.randint(1, 9)) for a, k in ((rng.randint(0, 60), rng.randint(0, 3)) for _ in range(8))] for _ in range(2))
        want = [m for m in more if not any(m[0] < e and s < m[2] for s, _, e in base)]
        assert pii.merge(base, more) == sorted(base + want)


def paths_scores(scores, move):
    n, k = scores.shape
    for path in product(range(k), repeat=n):
        yield path, sum(scores[t, y] + move[path[t - 1] if t else -1, y] for t, y in enumerate(path))


def test_viterbi_and_expectations_by_enumeration():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    move = np.where(pii._allowed(), rng.normal(size=(k + 1, k)), pii.FORBIDDEN)
    lengths = np.array([3, 1, 2])
    scores = rng.normal(size=(3, 3, k))
    best = pii.viterbi(scores, lengths, move)
    label, pairs = pii._expected(scores, lengths, move)
    want_pairs = np.zeros_like(move)
    for i, n in enumerate(lengths):
        found = list(paths_scores(scores[i, :n], move))
        assert tuple(best[i, :n]) == max(found, key=lambda x: x[1])[0]
        z = np.logaddexp.reduce([s for _, s in found])
        want = np.zeros((n, k))
        for path, s in found:
            for t, y in enumerate(path):
                want[t, y] += np.exp(s - z)
                want_pairs[path[t - 1] if t else -1, y] += np.exp(s - z)
        assert np.allclose(label[i, :n], want, atol=1e-9)
    assert np.allclose(pairs, want_pairs, atol=1e-9)


def test_held_out_spans_of_the_field(crf):
    """Precision and recall of spans on rows that were not trained on, look-alikes included."""
    hits = missed = extra = 0
    for words, labels in pii.training_rows(300, seed=99):
        text, at, spans = " ".join(words), 0, []
        for w in words:
            spans.append((at, at + len(w)))
            at += len(w) + 1
        gold = set()
        for i, label in enumerate(labels):
            if label[0] == "B":
                j = i
                while j + 1 < len(words) and labels[j + 1] == f"I-{label[2:]}":
                    j += 1
                a, b = (spans[i][0] + x for x in pii.core(text[spans[i][0] : spans[j][1]]))
                if pii.plausible(label[2:], text[a:b]):
                    gold.add((a, pii.KINDS.index(label[2:]), b))
        got = set(pii.Tagger(crf).spans([text])[0])
        hits, missed, extra = hits + len(gold & got), missed + len(gold - got), extra + len(got - gold)
    assert hits / (hits + missed) > 0.9 and hits / (hits + extra) > 0.95


def test_the_field_adds_what_patterns_miss(crf):
    text = "call (415) 555-0132 today or 415-555-0132, code v1.2.3 of 2024-01-02"
    assert pii.base_spans(text) == []
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.Tagger(crf).spans([text])[0]] == [("phone", "(415) 555-0132"), ("phone", "415-555-0132")]


def test_whole_neighbour_words_are_features():
    text = "q" * 200 + "7" + " 12 " + "w" * 300
    assert pii._context("a" * 200 + " 12 " + "b" * 300, [(201, 203)]) == ("a" * 200, "b" * 300)
    assert [c[0] for c in pii._runs_of(text)] == [[(0, 201), (202, 204)]]
    assert len(pii.shape("a1" * 40)) == len("ad1") * 40
