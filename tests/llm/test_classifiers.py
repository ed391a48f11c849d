"""The trained classifiers against plain-Python versions of their features, scores and gradients."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from folium.llm import quality, toxicity


def grams(text):
    """Distinct hashed n-grams of a text, one character at a time."""
    padded = f" {' '.join(text.lower().split())} "
    found, mask = set(), (1 << 64) - 1
    for n in toxicity.ORDERS:
        for i in range(len(padded) - n + 1):
            h = 0
            for k, c in enumerate(padded[i : i + n]):
                h = (h * int(toxicity.MULTIPLIER) + ord(c)) & mask if k else ord(c)
            h = (h + n) & mask
            h ^= h >> 31
            found.add((h * 0xC4CEB9FE1A85EC53 & mask) >> (64 - toxicity.BITS))
    return found


TEXTS = ["", " ", "a", "Ab", "You ROTTEN  fool", "naïve café — ничего", "x" * 50, "the end\n of\tall things " * 30]


def test_character_ngrams_by_brute_force(monkeypatch):
    distinct = toxicity.Distinct(toxicity.BITS)
    for piece in (1 << 20, 7):  # a small piece puts seams into every text
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for text in TEXTS:
            got = toxicity._text_buckets(text, distinct, toxicity.BITS)
            assert len(got) == len(set(got.tolist())) and set(got.tolist()) == grams(text), (piece, text)


def test_weights_are_scaled_log_count_ratios_and_scores_sum_them():
    rows = [("you rotten hateful fool", 1), ("a calm and pleasant day", 0), ("rotten fruit on a calm day", 0), ("hateful fool", 1)] * 40
    model = toxicity.fit(rows, alpha=2.0)
    counts = [Counter(g for t, y in rows if y == label for g in grams(t)) for label in (0, 1)]
    total = [sum(c.values()) for c in counts]
    share = [n / sum(total) for n in total]
    for g in grams("rotten hateful calm day"):
        n = counts[0][g] + counts[1][g]
        ratio = np.log((counts[1][g] + 2.0 * share[1]) / total[1]) - np.log((counts[0][g] + 2.0 * share[0]) / total[0]) if n >= 2 else 0.0
        assert ratio * model.weight[g] >= -1e-9  # a learned weight here keeps the sign of its ratio
    distinct = toxicity.Distinct(toxicity.BITS)
    for text in TEXTS:
        z = model.bias + sum(float(model.weight[g]) for g in grams(text))
        assert model.score(text, distinct) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def pooled_by_loop(data, m):
    n = len(data) - quality.WIDTH + 1
    out = []
    for a in range(0, n, quality.CHUNK):
        rows = [np.concatenate([m.embed[b] for b in data[i : i + quality.WIDTH]]) @ m.conv for i in range(a, min(a + quality.CHUNK, n))]
        out.append(np.max(rows, axis=0))
    return np.array(out)


@pytest.mark.parametrize("size", [0, 1, 7, 511, 512, 513, 1_500])
def test_every_position_is_pooled(size):
    m = quality.initial()
    data = quality.padded(np.random.default_rng(size).integers(0, 256, size).astype(np.uint8))
    want = pooled_by_loop(data, m)
    assert np.allclose(quality.max_pool(data, m), want, atol=1e-4) and np.allclose(quality.chunk_features(data, m)[0], want, atol=1e-4)


def test_texts_beyond_a_slab_are_pooled_alike(monkeypatch):
    m = quality.initial()
    data = quality.padded(np.random.default_rng(1).integers(0, 256, quality.SLAB + 3_000).astype(np.uint8))
    whole = quality.max_pool(data, m)
    assert np.allclose(quality.chunk_features(data, m)[0], whole, atol=1e-4)
    monkeypatch.setattr(quality, "SLAB", 1 << 20)
    assert np.allclose(quality.max_pool(data, m), whole, atol=1e-5)


def test_gradient_by_finite_differences():
    m = quality.initial()
    for p in m.arrays():
        p += np.random.default_rng(2).standard_normal(p.shape).astype(np.float32) * 0.01
    wide = quality.Model(*[p.astype(np.float64) for p in m.arrays()])
    data = quality.padded(np.random.default_rng(3).integers(97, 123, 900).astype(np.uint8))
    grads = [np.zeros_like(p) for p in wide.arrays()]
    quality._gradient(data, 1.0, 1.0, wide, grads)

    def loss():
        h = quality.head(quality.chunk_features(data, wide)[0], wide)
        return -np.log(quality.sigmoid(float(h.mean(axis=0) @ wide.out + wide.out_b[0])))

    rng, step = np.random.default_rng(4), 1e-6
    for p, g in zip(wide.arrays(), grads, strict=True):
        for at in rng.integers(0, p.size, 6):
            old = p.flat[at]
            p.flat[at] = old + step
            up = loss()
            p.flat[at] = old - step
            down = loss()
            p.flat[at] = old
            assert g.flat[at] == pytest.approx((up - down) / (2 * step), abs=1e-5)
