"""Tests and intervals of whole samples in memory, as plain as can be: what the distributed ones are held against."""

import math

import numpy as np

from sparsemill.functions.statistics import effect_label, f_upper, normal_cdf, normal_quantile, t_two_sided


def normality(x: np.ndarray) -> float:
    """P-value of D'Agostino and Pearson's test (skewness and kurtosis); NaN under 8 values."""
    n = len(x)
    if n < 8:
        return math.nan
    d = x - x.mean()
    m2 = (d**2).mean()
    if m2 == 0:
        return math.nan
    skew, kurt = (d**3).mean() / m2**1.5, (d**4).mean() / m2**2
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    v = (kurt - mean) / math.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    inner = (1 - 2 / a) / (1 + v * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(inner) ** (1 / 3), inner)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


# Royston's polynomials (1995, algorithm AS R94), lowest power first
LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW_MEAN, FEW_LOG_SD, FEW_SHIFT = (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
MEAN, LOG_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """(W, p) of Shapiro and Wilk's test by Royston's approximation; NaN under 3 values and where all are equal."""
    n = len(x)
    if n < 3 or x.min() == x.max():
        return math.nan, math.nan
    x, poly = np.sort(x), lambda c, t: sum(v * t**k for k, v in enumerate(c))
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([normal_quantile((k + 0.625) / (n + 0.25)) for k in range(n)])
        square = float(m @ m)
        ends = [poly(LAST, n**-0.5) + m[-1] / math.sqrt(square)]
        if n > 5:
            ends.append(poly(NEXT, n**-0.5) + m[-2] / math.sqrt(square))
        k = len(ends)
        a = m / math.sqrt((square - 2 * float(m[-k:] @ m[-k:])) / (1 - 2 * sum(e * e for e in ends)))
        a[n - k :], a[:k] = ends[::-1], [-e for e in ends]
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1e-300, 1 - w))
    if n <= 11:
        shift = poly(FEW_SHIFT, n)
        if y >= shift:
            return w, 0.0
        y, mean, sd = -math.log(shift - y), poly(FEW_MEAN, n), math.exp(poly(FEW_LOG_SD, n))
    else:
        mean, sd = poly(MEAN, math.log(n)), math.exp(poly(LOG_SD, math.log(n)))
    return w, 1 - normal_cdf((y - mean) / sd)


def levene(a: np.ndarray, b: np.ndarray) -> float:
    """P-value for equal variances, from deviations from the medians."""
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    n, every = len(a) + len(b), np.concatenate((za, zb))
    between = len(a) * (za.mean() - every.mean()) ** 2 + len(b) * (zb.mean() - every.mean()) ** 2
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    return 1.0 if within == 0 else f_upper((n - 2) * between / within, 1, n - 2)


def t_test(a: np.ndarray, b: np.ndarray, equal_var: bool) -> tuple[float, float]:
    """(t, two-sided p): pooled or Welch."""
    na, nb, va, vb = len(a), len(b), a.var(ddof=1), b.var(ddof=1)
    if equal_var:
        df, se = na + nb - 2, math.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb))
    else:
        se = math.sqrt(va / na + vb / nb)
        df = (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) if se else 1
    if se == 0:
        return (0.0, 1.0) if a.mean() == b.mean() else (math.inf, 0.0)
    t = (a.mean() - b.mean()) / se
    return t, t_two_sided(t, df)


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(U of a, two-sided p) by the normal approximation with ties and continuity."""
    every = np.concatenate((a, b))
    values, at, counts = np.unique(every, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks = ((ends - counts + 1 + ends) / 2)[at]
    na, nb, n = len(a), len(b), len(every)
    u = ranks[:na].sum() - na * (na + 1) / 2
    ties = (counts.astype(float) ** 3 - counts).sum()
    sd = math.sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))
    if sd == 0:
        return u, 1.0
    z = (abs(u - na * nb / 2) - 0.5) / sd
    return u, min(1.0, 2 * (1 - normal_cdf(z)))


def cohens_d(a: np.ndarray, b: np.ndarray) -> float:
    pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    return (a.mean() - b.mean()) / math.sqrt(pooled) if pooled else 0.0


def compare(a: np.ndarray, b: np.ndarray) -> dict:
    """The test that fits the samples: t or Welch where both are normal, else ranks; and the effect's size."""
    normal = [not (p := normality(x)) <= 0.05 for x in (a, b)]
    if all(normal):
        equal = levene(a, b) > 0.05
        name, (stat, p) = "t-test" if equal else "Welch's t-test", t_test(a, b, equal)
    else:
        name, (stat, p) = "Mann-Whitney U", mann_whitney(a, b)
    d = cohens_d(a, b)
    return {"test_name": name, "test_statistic": float(stat), "p_value": float(p), "cohens_d": float(d), "effect_size": effect_label(d), "significant": bool(p < 0.05), "a_normal": normal[0], "b_normal": normal[1]}


def bootstrap(x: np.ndarray, statistic, resamples: int = 10_000, level: float = 0.95, seed: int = 42, other: np.ndarray | None = None) -> tuple[float, float]:
    """Percentile interval of a statistic of x (or of x and other), resampled in bounded blocks."""
    rng, out, block = np.random.default_rng(seed), [], max(1, 4_000_000 // max(1, len(x)))
    for at in range(0, resamples, block):
        k = min(block, resamples - at)
        one = x[rng.integers(0, len(x), (k, len(x)))]
        out.append(statistic(one) if other is None else statistic(one, other[rng.integers(0, len(other), (k, len(other)))]))
    tail = (1 - level) / 2 * 100
    lo, hi = np.percentile(np.concatenate(out), [tail, 100 - tail])
    return float(lo), float(hi)
