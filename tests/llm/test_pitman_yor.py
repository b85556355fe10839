"""The seating sampler against recursions and against an enumeration of every seating."""

import itertools
import math

import numpy as np
import pytest

from sigspark.llm import pitman_yor as P


@pytest.mark.parametrize("d", [0.3, 0.45, 0.8, 0.93])
def test_stirling_numbers_beyond_the_table(d):
    size = 900
    want, t = np.full(size + 1, -np.inf), np.arange(1, size + 1)
    want[0] = 0.0
    for c in range(size):
        left = c - d * t
        grown = want[1:] + np.where(left > 0, np.log(np.maximum(left, 1e-300)), -np.inf)
        want = np.concatenate(([-np.inf], np.logaddexp(want[:-1], grown)))
    ask = np.array([1, 2, 3, 8, 9, 15, 40, 100, 300, 600, 800, 900])
    got = P.log_stirling(d, np.full(len(ask), size), ask)
    assert np.abs(got - want[ask]).max() < 0.05
    assert P.log_stirling(d, np.array([3, 4]), np.array([4, 2])) == pytest.approx([-np.inf, math.log((1 - d) * (11 - 7 * d))])


def test_log_gamma():
    x = np.array([0.01, 0.5, 1.0, 3.3, 8.0, 100.0, 1e7])
    assert P.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-9)


OWN, CONTEXT, COUNT = np.array([3, 2, 1]), np.array([0, 1, 16, 0, 16, 1]), np.array([3, 2, 2, 1, 2, 2])
HYPER = ((0.6, 1.0), (0.6, 1.0), (0.7, 0.5))


def block(tables=None):
    return P.Block(np.array([11, 22, 33], np.uint64) * np.uint64(0x9E3779B97F4A7C15), OWN, CONTEXT, COUNT, tables)


def test_averaged_predictions_are_those_of_all_seatings():
    """Every seating of a corpus of three words in three buckets of two classes, weighed by its exact probability."""

    def restaurants(d, s, customers, tables):
        return sum((t - 1) * math.log(d) + math.lgamma(s / d + t) - math.lgamma(s / d + 1) - math.lgamma(s + c) + math.lgamma(s + 1) for c, t in zip(customers, tables, strict=True) if c)

    s = [P.stirling_table(d) for d, _ in HYPER]
    first, total, mean = block(), 0.0, 0.0
    upto = lambda counts: itertools.product(*[range(1, c + 1) for c in counts])
    for t2 in upto(COUNT):
        c1 = np.bincount(first.up, weights=t2).astype(int)
        for t1 in upto(c1):
            c0 = np.bincount(first.group_word, weights=t1).astype(int)
            for t0 in upto(c0):
                b = block((np.array(t2), np.array(t1), np.array(t0)))
                g = b.totals()
                weight = sum(restaurants(*HYPER[k], g.c[k], g.t[k]) for k in range(3)) - sum(t0) * math.log(4)
                weight += s[2][COUNT, t2].sum() + s[1][c1, t1].sum() + s[0][c0, t0].sum()
                total += math.exp(weight)
                mean = mean + math.exp(weight) * b.predictive(g, HYPER)
    b = block()
    b.start(b.totals(), HYPER)
    got, n = 0.0, 0
    for number in range(1, 2501):
        b.sweep(b.totals(), HYPER, number)
        if number > 50:
            got, n = got + b.predictive(b.totals(), HYPER), n + 1
    assert got / n == pytest.approx(mean / total, abs=0.006)


def test_probabilities_of_all_words_sum_to_one():
    """Words 0..199 in one class; each bucket's probabilities and the unknown word's add up to 1 after sampling."""
    rng = np.random.default_rng(3)
    count = np.zeros((200, P.FAN), np.int64)
    for w, c, n in zip(rng.zipf(1.4, 4000) % 200, rng.integers(0, P.FAN, 4000), rng.integers(1, 60, 4000), strict=True):
        count[w, c] += n
    b = P.Block(np.arange(1, 201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.full(200, P.FAN), np.tile(np.arange(P.FAN), 200), count.ravel())
    g = b.totals()
    b.start(g, P.START)
    for number in range(1, 4):
        b.sweep(b.totals(), P.START, number)
        assert (b.t2 >= (b.count > 0)).all() and (b.t2 <= b.count).all() and (b.t1 <= b.c1).all() and (b.t0 <= b.c0).all()
    g = b.totals()
    p = b.predictive(g, P.START).reshape(200, P.FAN).sum(axis=0)
    (d0, s0), (d1, s1), (d2, s2) = P.START
    unknown = (s0 + d0 * g.t[0][0]) / (g.types + 1) / (s0 + g.c[0][0]) * (s1 + d1 * g.t[1][0]) / (s1 + g.c[1][0])
    unknown = unknown * (s2 + d2 * g.t[2][: P.FAN]) / (s2 + g.c[2][: P.FAN])
    unseen = 200 - g.types  # of these only one counts as a word
    assert p + unknown * (1 - unseen) == pytest.approx(np.ones(P.FAN), rel=1e-9)


def test_seating_does_not_depend_on_the_blocks():
    a, parts = block(), [P.Block(block().hashes[i : i + 1], OWN[i : i + 1], CONTEXT[s], COUNT[s]) for i, s in enumerate((slice(0, 3), slice(3, 5), slice(5, 6)))]
    for number in range(1, 20):
        g = a.totals()
        assert sum(p.totals().packed() for p in parts) == pytest.approx(g.packed())
        for x in (a, *parts):
            x.sweep(g, HYPER, number)
        assert np.concatenate([p.t2 for p in parts]).tolist() == a.t2.tolist()
