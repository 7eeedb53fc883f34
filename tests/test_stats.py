import math

import numpy as np
import pytest

from stipple.functions import stats as S


def test_log_gamma():
    x = np.concatenate([np.linspace(0.01, 30, 400), [1e3, 1e6, 1e10]])
    assert np.allclose(S._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("a", [0.5, 3.0, 50.0, 9.9e4, 1e5, 1e6, 1e10])
def test_lower_gamma_at_its_mean(a):
    """Near its mean P(a, a) is 1/2 + 1 / (3 sqrt(2 pi a)) up to the order a^-1.5."""
    if a >= 50:
        assert S.gamma_lower(np.array([a]), np.array([a]))[0] == pytest.approx(0.5 + 1 / (3 * math.sqrt(2 * math.pi * a)), abs=2 / a)


def test_both_ways_to_the_lower_gamma_agree():
    a = np.full(9, S.LARGE_SHAPE * 0.99)
    x = a + np.linspace(-4, 4, 9) * np.sqrt(a)
    assert np.allclose(S.gamma_lower(a, x), S._gamma_lower_large(a, x), atol=1e-8)
    far = np.array([0.5, 0.9, 1.1, 2.0]) * a[0]
    assert np.allclose(S.gamma_lower(a[:4], far), S._gamma_lower_large(a[:4], far), atol=1e-8)


@pytest.mark.parametrize("small", [2, 5, 8])
def test_limit_of_the_rank_sum_null(small):
    large = 20_000
    ways = S._u_counts(small, large)
    total = float(ways.sum())
    sd = math.sqrt(small * large * (small + large + 1) / 12)
    for z in (0.0, 0.5, 1.0, 1.5, 2.0, 2.4):
        u = int(small * large / 2 + z * sd)
        if u <= small * large:
            assert S._u_tail_limit(u, small, large) == pytest.approx(float(ways[u:].sum()) / total, rel=2e-3, abs=1e-9)
