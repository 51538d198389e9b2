"""Numeric functions that Spark lacks: Qn scale and the not-a-knot cubic spline."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Makes Qn consistent for the normal distribution.
QN_FACTOR = 1 / (np.sqrt(2) * NormalDist().inv_cdf(5 / 8))
#: Values up to which all pairs are formed at once.
QN_DIRECT = 1500
#: Values from which pairs are counted roughly first, and bins by which they are, then and from more values on.
ROUGH_FROM, ROUGH_BINS, MANY, MANY_BINS = 3000, 512, 6000, 2048


def qn(values) -> float | None:
    """Scale of Rousseeuw and Croux: the k-th least distance of two values, times a factor; None with
    fewer than two values."""
    x = np.sort(np.asarray(values, float)[np.isfinite(np.asarray(values, float))])
    n = len(x)
    if n < 2:
        return None
    h = n // 2 + 1
    k = h * (h - 1) // 2
    if n <= QN_DIRECT:
        i, j = np.triu_indices(n, 1)
        return float(np.partition(x[j] - x[i], k - 1)[k - 1] * QN_FACTOR)
    # Bisection on the distance: pairs within it are counted by binary search, no pair is formed.
    low, high, at = 0.0, float(x[-1] - x[0]), np.arange(n)
    for _ in range(80):
        mid = (low + high) / 2
        if int((np.searchsorted(x, x + mid, side="right") - at - 1).sum()) >= k:
            high = mid
        else:
            low = mid
    return float(high * QN_FACTOR)


def qn_scale(column: str):
    """Qn as a grouped aggregate; a group's values are those of one hour."""

    def scale(values: pd.Series) -> float:
        return qn(values)

    return F.pandas_udf(scale, "double")(column)


def beyond_qn(u: np.ndarray, values: np.ndarray, low: float, high: float, held: bool = True) -> np.ndarray:
    """Which of ``values`` are less than ``low`` or more than ``high`` Qn from the median of all others. u:
    sorted; with ``held`` it has each of the values too, which is none of its own others. A Qn of 0, or
    fewer than two others, takes nothing out.

    The order of the Qn and a bound is told by the number of pairs within a distance, so no Qn is
    made; it is where a distance lies so close to the bound that rounding may decide. Most bounds are far
    from it: counts of values by bin tell their order, and pairs are counted for the others alone."""
    n = len(u) - held
    out = np.zeros(len(values), bool)
    if n < 2 or not len(values):
        return out
    if not (np.isfinite(u[0]) and np.isfinite(u[-1]) and np.isfinite(values).all()):
        return np.array([beyond_one(without(u, v) if held else u, v, low, high) for v in values], bool)
    k = (n // 2 + 1) * (n // 2) // 2
    own = u.searchsorted(values) if held else np.full(len(values), len(u))
    a, b = (n - 1) // 2, n // 2
    mid = u[a + (own <= a)]
    if b > a:
        upper = u[b + (own <= b)]
        mid = np.where(mid == upper, mid, 0.5 * mid + 0.5 * upper)
    away = values - mid
    # Out where the k-th distance is less than this.
    bound = away / (np.where(away > 0, high, low) * QN_FACTOR)
    slack = 1e-12 * bound + 4e-15 * max(abs(u[0]), abs(u[-1]))
    equal = int((u[1:] == u[:-1]).sum())
    if equal * (equal + 1) // 2 >= k:  # the Qn may be 0
        return np.array([beyond_one(without(u, v) if held else u, v, low, high) for v in values], bool)
    within = lambda d: _pairs_within(u, d)
    order = np.argsort(bound)
    above, below = bound[order] + slack[order], bound[order] - slack[order]
    # Below ``first`` too few pairs are within the bound even with the value's own; from ``sure`` on enough without.
    enough = k + n * held
    low_first, high_first, low_sure, high_sure = 0, len(order), 0, len(order)
    if len(u) >= ROUGH_FROM:
        width, least, most = _rough_pairs(u)
        if width > 0:
            steps = lambda d: np.clip(np.floor(d / width), -1, len(least) - 2).astype(int)
            a, b = steps(above), steps(below)
            low_first, high_first = (int(np.searchsorted(a, s)) for s in (most.searchsorted(k) - 1, least.searchsorted(k) - 1))
            low_sure, high_sure = (int(np.searchsorted(b, s)) for s in (most.searchsorted(enough) - 1, least.searchsorted(enough) - 1))
    first = _first(low_first, high_first, lambda i: within(above[i]) >= k)
    sure = _first(max(first, low_sure), max(first, high_sure), lambda i: within(below[i]) >= enough)
    out[order[sure:]] = True
    for i in order[first:sure]:
        v, d, s = values[i], bound[i], slack[i]
        near = [int(u.searchsorted(v + x, side="right") - u.searchsorted(v - x)) - 1 if held and x >= 0 else 0 for x in (d - s, d + s)]
        if within(d + s) - near[0] >= k:
            out[i] = within(d - s) - near[1] >= k or beyond_one(without(u, v) if held else u, v, low, high)
    return out


def _pairs_within(u: np.ndarray, d: float) -> int:
    """Pairs of u, sorted, up to d apart."""
    return int(u.searchsorted(u + d, side="right").sum()) - len(u) * (len(u) + 1) // 2 if d >= 0 else 0


def _rough_pairs(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The width of a bin, and the least and the most pairs that can be within a distance of -1, 0, 1, ... whole
    widths and less than one more. A bin to each side is allowed for, beyond what bins can hide, and a
    pair, so that no rounding matters."""
    bins = MANY_BINS if len(u) >= MANY else ROUGH_BINS
    width = float(u[-1] - u[0]) / bins
    upto = u.searchsorted(u[0] + width * np.arange(bins + 1))
    upto[-1] = len(u)
    c = np.diff(upto).astype(float)
    pairs = np.rint(np.fft.irfft(np.abs(np.fft.rfft(c, 2 * bins)) ** 2, 2 * bins)[:bins])  # by how many bins apart
    pairs[0] = (c * (c - 1) / 2).sum()
    pairs = np.maximum.accumulate(np.cumsum(pairs))  # up to so many bins apart
    slack = 1 + 1e-12 * pairs[-1] * np.log2(bins)
    t = np.arange(bins + 4)  # of -1 there are none
    least = np.where(t >= 2, pairs[np.clip(t - 2, 0, bins - 1)] - slack, 0)
    most = pairs[np.clip(t + 2, 0, bins - 1)] + slack
    return width, np.concatenate([[0], np.maximum(least, 0)]), np.concatenate([[0], most])


def _first(low: int, high: int, holds) -> int:
    """The first of low..high for which ``holds``, which then does for all behind it; high if none."""
    while low < high:
        mid = (low + high) // 2
        if holds(mid):
            high = mid
        else:
            low = mid + 1
    return low


def without(u: np.ndarray, *values: float) -> np.ndarray:
    for v in values:
        u = np.delete(u, u.searchsorted(v))
    return u


def beyond_one(others: np.ndarray, v: float, low: float, high: float) -> bool:
    """The same for one value, by its Qn. A score that is no number counts as a large one."""
    scale = qn(others)
    if not scale:
        return False
    a, b = others[(len(others) - 1) // 2], others[len(others) // 2]
    z = (v - (a if a == b else 0.5 * a + 0.5 * b)) / scale
    return bool(z < low or z > high or np.isnan(z))


def t_quantile(q: float, df: int) -> float:
    """Quantile of Student's t: the distribution function's integral is a finite sum in the angle
    atan(t / sqrt(df)), and is inverted by bisection."""

    def inside(t: float) -> float:
        """Probability of -t..t."""
        a = np.arctan(t / np.sqrt(df))
        c = np.cos(a)
        k = np.arange(1, df // 2 if df % 2 == 0 else (df - 1) // 2)
        ratios = np.concatenate([[1.0], np.cumprod((2 * k - 1) / (2 * k) if df % 2 == 0 else 2 * k / (2 * k + 1))])
        if df % 2 == 0:
            return float(np.sin(a) * (ratios * c ** (2 * np.arange(len(ratios)))).sum())
        tail = np.sin(a) * (ratios * c ** (2 * np.arange(len(ratios)) + 1)).sum() if df > 1 else 0.0
        return float(2 / np.pi * (a + tail))

    if q < 0.5:
        return -t_quantile(1 - q, df)
    low, high = 0.0, 1.0
    while inside(high) < 2 * q - 1:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < 2 * q - 1 else (low, mid)
    return high


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y), x ascending, with not-a-knot ends; through two points a line,
    through three a parabola."""
    n = len(x)
    if n == 2 or not len(at):
        return np.interp(at, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.empty(n)  # second derivatives
    if n == 3:
        m[:] = 2 * (d[1] - d[0]) / (h[0] + h[1])
    else:
        low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
        right = 6 * np.diff(d)
        # The third derivative does not jump at the second and the last but one point.
        mid[0] += h[0] * (1 + h[0] / h[1])
        high[0] -= h[0] * h[0] / h[1]
        mid[-1] += h[-1] * (1 + h[-1] / h[-2])
        low[-1] -= h[-1] * h[-1] / h[-2]
        for i in range(1, n - 2):
            f = low[i] / mid[i - 1]
            mid[i] -= f * high[i - 1]
            right[i] -= f * right[i - 1]
        m[n - 2] = right[-1] / mid[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (right[i] - high[i] * m[i + 2]) / mid[i]
        m[0] = m[1] + h[0] / h[1] * (m[1] - m[2])
        m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6
