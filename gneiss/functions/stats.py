"""Statistics of evaluation: intervals, bounds, calibration."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z = 1.959963984540054  # 95 %


def rate(n: Column, d: Column) -> Column:
    """n / d, null without trials."""
    return F.when(d > 0, n / d)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval at 95 %, within [0, 1]; null without trials."""
    p, z2 = k / n, Z * Z
    centre, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / scale)), F.when(n > 0, F.least(F.lit(1.0), (centre + half) / scale))


def zero_error_bound(n: Column, alpha: float = 0.05) -> Column:
    """Lower bound of the success rate after n successes in n trials."""
    return F.when(n > 0, F.pow(F.lit(alpha), 1.0 / n))


def least_zero_error(target: float, alpha: float = 0.05) -> int:
    """Trials without error that prove a target rate."""
    return math.ceil(math.log(alpha) / math.log(target))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified method of Lentz."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def lower_bound(k: int, n: int, alpha: float = 0.05) -> float | None:
    """One-sided exact lower bound of a success rate; closed form at 0 and n."""
    if n <= 0:
        return None
    if k <= 0:
        return 0.0
    if k >= n:
        return alpha ** (1.0 / n)
    low, high = 0.0, 1.0
    for _ in range(64):
        mid = (low + high) / 2
        if beta_cdf(mid, k, n - k + 1) < alpha:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def exact_lower_bound(k: pd.Series, n: pd.Series) -> pd.Series:
    """lower_bound at alpha 0.05, each distinct pair once."""
    known: dict[tuple[int, int], float | None] = {}
    out = []
    for a, b in zip(k, n):
        key = (int(a), int(b)) if pd.notna(a) and pd.notna(b) else (0, 0)
        if key not in known:
            known[key] = lower_bound(*key)
        out.append(known[key])
    return pd.Series(out, dtype="float64")


def isotonic(scores: list[float], weights: list[float], values: list[float]) -> list[float]:
    """Pool-adjacent-violators fit of values (sorted by score)."""
    blocks: list[list[float]] = []
    for w, v in zip(weights, values):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return [v for _, v, n in blocks for _ in range(int(n))]
