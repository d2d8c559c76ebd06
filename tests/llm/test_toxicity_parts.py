"""The parts of the toxicity model against plain loops."""

import math

import numpy as np
import pytest

from tidegauge.llm import toxicity

RULES = toxicity.Rules([*toxicity.LEXICON, "grumpf", "blarg"], ["snork", "zwoll"])
PLAIN = " ".join(["the calm river of this quiet valley runs on"] * 700).split()


def made(text):
    return toxicity.signals(text.encode(), RULES.automaton(), len(RULES))


@pytest.mark.parametrize("passage", ["grumpf and blarg and grumpf", "snorking snorked and zwolling snork", "blarg grumpf zwollen zwoll"])
def test_a_passage_counts_alike_in_short_and_long_texts(passage):
    """Voters of learned words give the same in 50, 450 and 4,500 words, wherever the passage stands."""
    short = made(" ".join([*PLAIN[:240], passage]))[:len(RULES)]
    assert short.any()
    for n in (450, 4500):
        for at in (0, n // 3, n):
            assert np.array_equal(made(" ".join([*PLAIN[:at], passage, *PLAIN[at:n]]))[:len(RULES)], short)


def test_single_hits_far_apart_are_none_in_a_long_text():
    text = " ".join(w if i % 400 else "blarg" for i, w in enumerate(PLAIN[:4500]))
    assert not made(text)[len(toxicity.LEXICON):len(RULES)].any()
    assert made("a blarg here")[RULES.words.index("blarg")] > 0


@pytest.mark.parametrize("seed", range(5))
def test_densest_stretch(seed):
    rng = np.random.default_rng(seed)
    places = sorted(rng.integers(0, 2000, rng.integers(0, 60)).tolist())
    first, last = toxicity.densest(places, 2000)
    most = max((sum(p <= q < p + toxicity.STRETCH for q in places) for p in places), default=0)
    assert last - first == most and all(q - places[first] < toxicity.STRETCH for q in places[first:last])


def test_posteriors_equal_bayes_rule():
    rng = np.random.default_rng(1)
    n, width = 300, 6 + len(toxicity.PATTERNS)
    y = rng.integers(0, 2, n)
    x = np.where(rng.random((n, width)) < np.where(y[:, None] == 1, 0.5, 0.05), 1.0, 0.0)
    v, known = toxicity.votes(x), np.where(rng.random(n) < 0.7, y, -1)
    model = toxicity.fit_labels(v, known)
    got = model.posterior(v, known)
    for i in range(0, n, 7):
        odds = math.log(model.prior / (1 - model.prior))
        for j in range(width):
            if v[i, j]:
                odds += model.voice[j] * math.log(model.fires[1][j] / model.fires[0][j])
            elif j < width - len(toxicity.PATTERNS):
                odds += model.voice[j] * math.log((1 - model.fires[1][j]) / (1 - model.fires[0][j]))
        if known[i] >= 0:
            p, q = model.label[1], model.label[0]
            odds += math.log(p / q) if known[i] else math.log((1 - p) / (1 - q))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds)))), rel=1e-9)
    assert np.mean((got > 0.5) == y) > 0.9


def test_linear_weights_are_the_optimum():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(400, 5)), rng.random(400)
    w = toxicity.fit_linear(x, q, ridge=1.0)
    loss = lambda w: -sum(t * math.log(p) + (1 - t) * math.log(1 - p) for t, p in zip(q, 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))))) + 0.5 * (w[:-1] @ w[:-1]) + 0.0005 * w[-1] ** 2
    best = loss(w)
    for k in range(len(w)):
        for step in (1e-3, -1e-3):
            other = w.copy()
            other[k] += step
            assert loss(other) > best - 1e-9
