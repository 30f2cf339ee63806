"""Distribution tails, quantiles and digital filters, from their definitions."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - head * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return head * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return head * h


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def signed_rank_exact(statistic: float, n: int) -> float:
    """Two-sided exact p-value of the smaller rank sum, without ties or zeros."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[: len(ways) - k]
    return float(min(1.0, 2 * ways[: int(statistic) + 1].sum() / 2.0**n))


def butter_lowpass(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a Butterworth low-pass, by the bilinear transform of its analogue poles."""
    warped = 2 * rate * math.tan(math.pi * cutoff / rate)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    digital = (2 * rate + poles) / (2 * rate - poles)
    a = np.real(np.poly(digital))
    b = np.poly(-np.ones(order))
    return np.real(b * a.sum() / b.sum()), a


def _initial(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State in which a constant input of 1 gives a constant output."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:] / a[0]
    companion[1:, :-1] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed along the first axis; state has a row for each delay."""
    out = np.empty_like(x)
    z = np.array(state)
    for i in range(len(x)):
        out[i] = b[0] * x[i] + z[0]
        z[:-1] = z[1:] + np.multiply.outer(b[1:-1], x[i]) - np.multiply.outer(a[1:-1], out[i])
        z[-1] = b[-1] * x[i] - a[-1] * out[i]
    return out


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward along the first axis, with odd extensions of three filter lengths at both ends."""
    x = np.asarray(x, dtype=np.float64)
    edge = 3 * max(len(a), len(b))
    if len(x) <= edge:
        raise ValueError(f"the signal needs more than {edge} samples")
    longer = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    z = _initial(b, a)
    once = lfilter(b, a, longer, np.multiply.outer(z, longer[0]))[::-1]
    return lfilter(b, a, once, np.multiply.outer(z, once[0]))[::-1][edge:-edge]
