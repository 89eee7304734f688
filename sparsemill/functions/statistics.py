"""Distribution functions, and tests from a group's sums: for one row a group."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return _NORMAL.cdf(z)


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny, key=abs)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(1 + top * d, tiny, key=abs)
            c = max(1 + top / c, tiny, key=abs)
            f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """The t of a one-sided probability p over 0.5, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


# fixed values: Royston's polynomials (1995, algorithm AS R94), lowest power first
_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_FEW_MEAN, _FEW_LOG_SD, _FEW_SHIFT = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
_MEAN, _LOG_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


#: The sizes that Royston's approximation is published for.
SHAPIRO_SIZES = (3, 5000)


def _poly(c: tuple[float, ...], t: float) -> float:
    return sum(v * t**k for k, v in enumerate(c))


def shapiro(n: int, square: float, dot: float, deviation: float, ends: list[float]) -> tuple[float, float]:
    """(W, p) of Shapiro and Wilk's test by Royston's approximation; NaN under 3 values and where all are equal.

    With m the normal scores of the ranks 1..n: square is the sum of their squares, dot the sum of their products with the
    sorted values, deviation the sum of squared deviations from the mean; ends are the two smallest and two largest values.
    """
    if n < 3 or deviation <= 0 or ends[0] == ends[-1]:
        return math.nan, math.nan
    spread = (ends[-1] - ends[0], ends[-2] - ends[1])
    if n == 3:
        dot = math.sqrt(0.5) * spread[0]
    else:
        score = [normal_quantile((n - k + 0.625 - 1) / (n + 0.25)) for k in range(2)]  # of the largest and the next
        weight = [_poly(_LAST, n**-0.5) + score[0] / math.sqrt(square), _poly(_NEXT, n**-0.5) + score[1] / math.sqrt(square)][: 2 if n > 5 else 1]
        k = len(weight)
        scale = math.sqrt((square - 2 * sum(s * s for s in score[:k])) / (1 - 2 * sum(w * w for w in weight)))
        dot = (dot - sum(s * x for s, x in zip(score[:k], spread))) / scale + sum(w * x for w, x in zip(weight, spread))
    w = min(1.0, dot * dot / deviation)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1e-300, 1 - w))
    if n <= 11:
        shift = _poly(_FEW_SHIFT, n)
        if y >= shift:
            return w, 0.0
        y, mean, sd = -math.log(shift - y), _poly(_FEW_MEAN, n), math.exp(_poly(_FEW_LOG_SD, n))
    else:
        mean, sd = _poly(_MEAN, math.log(n)), math.exp(_poly(_LOG_SD, math.log(n)))
    return w, normal_cdf((mean - y) / sd)


@dataclass
class Sample:
    """A sample's size, mean and variance (n - 1)."""

    n: int
    mean: float
    var: float


def levene(a: Sample, b: Sample) -> float:
    """P-value for equal variances, from the sums of two samples' absolute deviations from their medians."""
    n = a.n + b.n
    mean = (a.n * a.mean + b.n * b.mean) / n
    between = a.n * (a.mean - mean) ** 2 + b.n * (b.mean - mean) ** 2
    within = (a.n - 1) * a.var + (b.n - 1) * b.var
    return 1.0 if within <= 0 else f_upper((n - 2) * between / within, 1, n - 2)


def t_test(a: Sample, b: Sample, equal_var: bool) -> tuple[float, float]:
    """(t, two-sided p): pooled or Welch."""
    if equal_var:
        df = a.n + b.n - 2
        se = math.sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / df * (1 / a.n + 1 / b.n))
    else:
        x, y = a.var / a.n, b.var / b.n
        se = math.sqrt(x + y)
        df = (x + y) ** 2 / (x**2 / (a.n - 1) + y**2 / (b.n - 1)) if se else 1
    if se == 0:
        return (0.0, 1.0) if a.mean == b.mean else (math.inf, 0.0)
    t = (a.mean - b.mean) / se
    return t, t_two_sided(t, df)


def mann_whitney(na: int, nb: int, ranks: float, ties: float) -> tuple[float, float]:
    """(U of a, two-sided p) from a's sum of mid-ranks and the sum of c^3 - c over groups of c equal values: normal, with ties and continuity."""
    n, u = na + nb, ranks - na * (na + 1) / 2
    variance = na * nb / 12 * ((n + 1) - ties / (n * (n - 1)))
    if variance <= 0:
        return u, 1.0
    z = (abs(u - na * nb / 2) - 0.5) / math.sqrt(variance)
    return u, min(1.0, 2 * normal_cdf(-z))


def cohens_d(a: Sample, b: Sample) -> float:
    pooled = ((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)
    return (a.mean - b.mean) / math.sqrt(pooled) if pooled else 0.0


def effect_label(d: float) -> str:
    return next(name for limit, name in ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"), (math.inf, "large")) if abs(d) < limit)


def compare(a: Sample, b: Sample, normal: list[bool], spread: tuple[Sample, Sample], ranks: float, ties: float) -> dict:
    """The test that fits the samples: t or Welch where both are normal, else ranks; and the effect's size."""
    if all(normal):
        equal = levene(*spread) > 0.05
        name, (stat, p) = "t-test" if equal else "Welch's t-test", t_test(a, b, equal)
    else:
        name, (stat, p) = "Mann-Whitney U", mann_whitney(a.n, b.n, ranks, ties)
    d = cohens_d(a, b)
    return {"test_name": name, "test_statistic": float(stat), "p_value": float(p), "cohens_d": float(d), "effect_size": effect_label(d), "significant": bool(p < 0.05), "a_normal": normal[0], "b_normal": normal[1]}
