"""Distribution functions and tests in plain numpy; grouped use is by applyInPandas on a judge's values."""

from __future__ import annotations

from math import erf, erfc, exp, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + n * d, 1e-300) if 1 + n * d > 0 else 1 / min(1 + n * d, -1e-300)
        c = 1 + n / c
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def chi2_one(x: float) -> float:
    """The upper tail with one degree of freedom."""
    return erfc(sqrt(max(x, 0.0) / 2))


def normal_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """By bisection on erf; exact enough for expected order statistics."""
    low, high = np.full(len(p), -9.0), np.full(len(p), 9.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = np.array([0.5 * (1 + erf(m / sqrt(2))) for m in mid]) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def mann_whitney(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """U of x and its two-sided p by the normal approximation with corrections for ties and continuity."""
    both = np.concatenate([x, y])
    values, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    ranks = (last - (counts - 1) / 2)[inverse]
    n, m = len(x), len(y)
    u = ranks[:n].sum() - n * (n + 1) / 2
    size = n + m
    spread = n * m / 12 * (size + 1 - (counts**3 - counts).sum() / (size * (size - 1))) if size > 1 else 0
    if spread <= 0:
        return float(u), 1.0
    z = (abs(u - n * m / 2) - 0.5) / sqrt(spread)
    return float(u), min(1.0, 2 * normal_tail(max(z, 0.0)))


def kolmogorov_smirnov(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The greatest gap of two empirical distributions and its asymptotic p."""
    x, y = np.sort(x), np.sort(y)
    both = np.concatenate([x, y])
    d = float(np.abs(np.searchsorted(x, both, side="right") / len(x) - np.searchsorted(y, both, side="right") / len(y)).max())
    n = len(x) * len(y) / (len(x) + len(y))
    z = sqrt(n) * d
    if z < 0.2:
        return d, 1.0
    return d, min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * z * z) for k in range(1, 101))))


def welch(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Student's t of two samples with pooled variance, and its two-sided p."""
    n, m = len(x), len(y)
    pooled = ((n - 1) * x.var(ddof=1) + (m - 1) * y.var(ddof=1)) / (n + m - 2)
    t = float((x.mean() - y.mean()) / sqrt(pooled * (1 / n + 1 / m)))
    return t, t_two_sided(t, n + m - 2)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's published approximation, made for 3 to 5000 values; beyond them p is less exact."""
    x, n = np.sort(np.asarray(x, float)), len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    mm, u = float(m @ m), 1 / sqrt(n)
    a = m / sqrt(mm)
    if n > 3:
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            prior = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            scale = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prior**2)
            a = m / sqrt(scale)
            a[-2], a[1] = prior, -prior
        else:
            a = m / sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    else:
        a = np.array([-sqrt(0.5), 0.0, sqrt(0.5)])
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / pi * (np.arcsin(sqrt(w)) - np.arcsin(sqrt(0.75))))
    y = log(max(1 - w, 1e-19))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-19
        y = -log(g - y)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, normal_tail((y - mean) / sd)


def bias_tests(marks: DataFrame, value: str = "deviation") -> DataFrame:
    """By judge: t, its p, the chi-square p of throw-outs against 5 percent, and Shapiro-Wilk's W and p over all of a judge's marks.

    A judge's marks are one group; they are bounded by what one person can give.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf[value].to_numpy(float), len(pdf)
        k = int(pdf["thrown_out"].sum())
        sd = x.std(ddof=1) if n > 1 else 0.0
        t = float(x.mean() / (sd / sqrt(n))) if sd > 0 else 0.0
        chi = (k - 0.05 * n) ** 2 / (0.05 * n) + (0.05 * n - k) ** 2 / (0.95 * n)
        w, pw = shapiro_wilk(x)
        p = t_two_sided(t, n - 1) if n > 1 else 1.0
        return pd.DataFrame({"judge_id": [pdf["judge_id"].iloc[0]], "t": [round(t, 4)], "p_t": [round(p, 4)], "p_chi2": [round(chi2_one(chi), 4)], "w": [round(w, 4)], "p_w": [round(pw, 4)], "significant": [p < 0.05 or chi2_one(chi) < 0.05]})

    own = marks.select("judge_id", value, "thrown_out")
    return own.groupBy("judge_id").applyInPandas(one, "judge_id long, t double, p_t double, p_chi2 double, w double, p_w double, significant boolean")
