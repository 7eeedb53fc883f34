"""Distribution functions Spark has no built-in for.

Each is vectorised over an Arrow batch and meant for *result* tables
(clusters, genes x clusters), not for raw matrix rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _f(x) -> np.ndarray:
    return np.asarray(x, dtype=np.float64)


#: fixed values: coefficients of Stirling's series for the logarithm of the gamma function
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after moving the argument up to 10 or more."""
    x = _f(x)
    low = x < 10
    up = np.where(low, x + 10, x)
    shift = np.zeros(x.shape)
    for k in range(10):
        shift += np.where(low, np.log(np.where(low, x + k, 1.0)), 0.0)
    inverse = 1 / up
    series = sum(c * inverse ** (2 * i + 1) for i, c in enumerate(STIRLING))
    return (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + series - shift


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, _f(x).tolist()), np.float64)


#: from this shape on the incomplete gamma function is taken from its uniform expansion
LARGE_SHAPE = 1e5


def _gamma_lower_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) for large a by Temme's uniform expansion, with an error of the order 1 / a^1.5."""
    mu = x / a - 1
    near = np.abs(mu) < 1e-2
    m = np.where(near, mu, 0.0)
    # half the square of eta: mu - log(1 + mu), by its series near 0
    half = np.where(near, m * m * (1 / 2 - m * (1 / 3 - m * (1 / 4 - m * (1 / 5 - m * (1 / 6 - m / 7))))), mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2 * half)
    safe = np.where(near, 1.0, mu), np.where(near, 1.0, eta)
    first = np.where(near, -1 / 3 + eta / 12 - 2 * eta ** 2 / 135 + eta ** 3 / 864, 1 / safe[0] - 1 / safe[1])
    rest = np.exp(-a * half) / np.sqrt(2 * np.pi * a) * first
    return 0.5 * _erfc(-eta * np.sqrt(a / 2)) - rest


def gamma_lower(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x), element-wise, a > 0, x >= 0."""
    a, x = np.broadcast_arrays(_f(a), _f(x))
    out = np.zeros(a.shape)
    pos = x > 0
    large = pos & (a >= LARGE_SHAPE)
    if large.any():
        out[large] = np.clip(_gamma_lower_large(a[large], x[large]), 0.0, 1.0)
        pos = pos & ~large
    a1, x1 = a[pos], x[pos]
    if a1.size == 0:
        return out
    scale = np.exp(a1 * np.log(x1) - x1 - _lgamma(a1))
    res = np.empty(a1.shape)
    series = x1 < a1 + 1
    if series.any():
        aa, xx = a1[series], x1[series]
        term = 1.0 / aa
        total = term.copy()
        k = aa.copy()
        for _ in range(100000):
            k += 1
            term = term * xx / k
            total += term
            if np.all(term <= total * 1e-16):
                break
        else:
            raise ArithmeticError("the series of the incomplete gamma function did not converge")
        res[series] = total * scale[series]
    frac = ~series
    if frac.any():  # modified Lentz evaluation of the continued fraction for Q
        aa, xx = a1[frac], x1[frac]
        tiny = 1e-300
        b = xx + 1 - aa
        c = np.full(aa.shape, 1 / tiny)
        d = 1 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, 100000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        else:
            raise ArithmeticError("the continued fraction of the incomplete gamma function did not converge")
        res[frac] = 1 - scale[frac] * h
    out[pos] = np.clip(res, 0.0, 1.0)
    return out


def _beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_reg(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df):
        return math.nan
    return _beta_reg(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile (p > 0.5) of Student's t by bisection."""
    lo, hi = 0.0, 1.0
    tail = 2 * (1 - p)
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_two_sided(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """p = P(|Z| >= |z|)."""
    return pd.Series(_erfc(np.abs(_f(z)) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def poisson_tail(x: pd.Series, lam: pd.Series) -> pd.Series:
    """P(X >= x) for X ~ Poisson(lam)."""
    x, lam = _f(x), _f(lam)
    out = np.ones(len(x))
    pos = x > 0
    out[pos] = gamma_lower(x[pos], lam[pos])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def log_gamma_density(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    """Log density of the gamma distribution; -inf at x = 0 for shape > 1."""
    x, k, th = _f(x), _f(shape), _f(scale)
    with np.errstate(divide="ignore"):
        return pd.Series((k - 1) * np.log(x) - x / th - _lgamma(k) - k * np.log(th))


@F.pandas_udf(T.DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_t_upper(df: pd.Series) -> pd.Series:
    """97.5 % quantile of Student's t."""
    return pd.Series([t_quantile(0.975, float(d)) for d in df], dtype="float64")


#: up to so many U values their orderings are counted; beyond, the null is the sum of uniforms that it tends to
COUNTED_U = 200_000


def _u_counts(n1: int, n2: int) -> np.ndarray:
    """Number of orderings giving each value of U, without ties (exact integers).

    Coefficients of the product over i of (1 - q^(n2+i)) / (1 - q^i).
    """
    ways = np.zeros(n1 * n2 + 1, dtype=object)
    ways[0] = 1
    for i in range(1, n1 + 1):
        shift = n2 + i
        if shift <= n1 * n2:
            ways[shift:] = ways[shift:] - ways[:-shift]
        for r in range(min(i, len(ways))):
            ways[r::i] = np.cumsum(ways[r::i])
    return ways


def _u_tail_limit(u: float, small: int, large: int) -> float:
    """P(U >= u), without ties, for one small side and a very large one.

    U is then a sum of ``small`` uniform values up to the order 1 / large;
    they are scaled to the exact variance and corrected for steps of one.
    """
    width = math.sqrt(large * (small + large + 1))
    x = small / 2 - (u - small * large / 2 - 0.5) / width
    total = sum((-1) ** k * math.comb(small, k) * (x - k) ** small for k in range(small + 1) if x > k)
    return min(1.0, max(0.0, total / math.factorial(small)))


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, z: pd.Series, n1: pd.Series, n2: pd.Series, tied: pd.Series) -> pd.Series:
    """Two-sided p: exact when a side has at most 8 values and nothing ties."""
    out = []
    for ui, zi, a, b, t in zip(u, z, n1, n2, tied):
        a, b = int(a), int(b)
        small, large = min(a, b), max(a, b)
        if small <= 8 and not t:
            big = max(ui, a * b - ui)
            if a * b > COUNTED_U:
                out.append(min(1.0, 2 * _u_tail_limit(big, small, large)))
                continue
            ways = _u_counts(small, large)
            out.append(min(1.0, float(2 * ways[int(round(big)):].sum()) / float(ways.sum())))
        else:
            out.append(math.erfc(abs(zi) / math.sqrt(2)) if zi == zi else math.nan)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(x: pd.Series, marked: pd.Series, total: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= x) for X marked items among ``drawn`` of ``total``."""
    x, k, n, d = _f(x), _f(marked), _f(total), _f(drawn)

    def log_choose(a, b):
        return _lgamma(a + 1) - _lgamma(b + 1) - _lgamma(a - b + 1)

    term = np.exp(log_choose(k, x) + log_choose(n - k, d - x) - log_choose(n, d))
    out, at, top = term.copy(), x.copy(), np.minimum(k, d)
    live = at < top
    while live.any():
        ratio = (k - at) * (d - at) / ((at + 1) * (n - k - d + at + 1))
        term = np.where(live, term * ratio, 0.0)
        out += term
        at = at + 1
        live = live & (at < top) & ((term > out * 1e-17) | (ratio > 1))
    return pd.Series(np.minimum(out, 1.0))
