"""How many tables the customers of a dish take, drawn from the exact conditional of a Pitman-Yor restaurant.

A restaurant with discount d and strength s that has T tables holds all its dishes together by its total alone.  With
the auxiliary y ~ Gamma(s / d + T) the dishes come apart: the customers of a dish with c customers and base probability
p take t tables with probability proportional to S_d(c, t) * (d * y * p)^t, where S_d are the generalised Stirling
numbers.  Drawing y and then every dish's t is one sweep of a Gibbs sampler in which all customers stand up and are
seated anew, however many there are.  Of c up to EXACT the numbers come from a table; beyond it, few tables (up to
FEW on average) come from the series of S_d for large c, and many from the normal form of a saddle point.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

EXACT, FEW, TERMS, WIDEST = 512, 24.0, 16, 96
#: Numbers worked on at once.
AT_ONCE = 1 << 16
#: Most customers of dishes that are worked on together.
WIDTHS = [*range(2, 17), *(int(16 * 2 ** (k / 6)) for k in range(1, 31))]


@lru_cache(maxsize=8)
def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of S_d(c, t) for c and t up to size."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(size + 1)
    for c in range(size):
        stay = c - discount * t
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.r_[-np.inf, out[c, :-1]]
            out[c + 1] = np.logaddexp(up, np.where(stay > 0, out[c] + np.log(np.maximum(stay, 1e-300)), -np.inf))
    return out


def by_weights(logs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row of logarithmic weights the number, from 1, of the column that the even number u falls into."""
    w = np.exp(logs - logs.max(axis=1, keepdims=True)).cumsum(axis=1)
    return 1 + (w < (u * w[:, -1])[:, None]).sum(axis=1).clip(max=logs.shape[1] - 1)


def few_tables(c: np.ndarray, log_a: np.ndarray, discount: float) -> np.ndarray:
    """Logarithmic weights of t = 1 to WIDEST for large c."""
    t = np.arange(1, WIDEST + 1)
    choose = np.array([[math.comb(n, j) if j <= n else 0 for j in range(1, TERMS + 1)] for n in t], float)
    signs = []
    for j in range(1, TERMS + 1):
        x = discount * j
        signs.append(0.0 if abs(x - round(x)) < 1e-9 else (-1) ** j / math.gamma(-x))
    x = discount * np.arange(1, TERMS + 1)
    ratio = np.exp(-x * np.log(c)[:, None] + x * (x + 1) / (2 * c[:, None]))
    inner = (ratio * np.array(signs)) @ choose.T
    fixed = -t * math.log(discount) - np.array([math.lgamma(n + 1) for n in t])
    with np.errstate(divide="ignore"):
        return np.where(inner > 0, np.log(np.maximum(inner, 1e-300)), -np.inf) + fixed + t * log_a[:, None]


def saddle(c: np.ndarray, a: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables for large c: 1 - x solves a * (1 - x) * x^(d - 1) = c."""
    low, high = np.full(len(c), -80.0), np.zeros(len(c))
    for _ in range(50):
        mid = (low + high) / 2
        over = np.log(a) + np.log(-np.expm1(mid)) + (discount - 1) * mid > np.log(c)
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    x = np.exp((low + high) / 2)
    mean = a * -np.expm1(discount * np.log(x)) / discount
    spread = a * (1 - x) * x ** (discount - 1) * (1 + (1 - x) * (1 - discount) / x)
    return mean, np.maximum(1e-9, mean - c * c / spread)


def tables(c: np.ndarray, a: np.ndarray, discount: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers and weight a; u and v are even numbers of (0, 1) for each dish."""
    out = np.minimum(c, 1).astype(np.int64)
    log_a, small = np.log(np.maximum(a, 1e-300)), stirling(discount)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    for low, n in zip((1, *WIDTHS[:-1]), WIDTHS, strict=True):
        # of numbers beyond a dish's customers none is drawn: their logarithm is minus infinity
        begin, end = np.searchsorted(c[some], (low, n), "right").tolist()
        t, logs, step = np.arange(1, n + 1), small[:, 1 : n + 1], max(1, AT_ONCE // n)
        for at in range(begin, end, step):
            rows = some[at : min(end, at + step)]
            out[rows] = by_weights(logs[c[rows]] + t * log_a[rows][:, None], u[rows])
    step = AT_ONCE // WIDEST
    many = np.flatnonzero(c > EXACT)
    for at in range(0, len(many), step):
        rows = many[at : at + step]
        n = c[rows].astype(float)
        mean, variance = saddle(n, np.maximum(a[rows], 1e-300), discount)
        normal = np.sqrt(-2 * np.log(u[rows])) * np.cos(2 * np.pi * v[rows])
        drawn = np.clip(np.rint(mean + np.sqrt(variance) * normal), 1, n)
        few = mean < FEW
        if few.any():
            drawn[few] = by_weights(few_tables(n[few], log_a[rows[few]], discount), u[rows[few]])
        out[rows] = drawn.astype(np.int64)
    return out
