"""Closed-form tests evaluated on a handful of aggregate rows or one bounded sample."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Royston (1995), algorithm AS R94, polynomial coefficients in ascending powers.
W_LAST = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
W_NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]
SMALL_GAMMA = [-2.273, 0.459]


def _poly(coefficients: list[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test for 3 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = x.size
    if n < 3:
        raise ValueError("at least 3 values are needed")
    if x[-1] == x[0]:
        return 1.0, 1.0
    half = n // 2
    normal = NormalDist()
    if n == 3:
        weights = np.array([math.sqrt(0.5)])
    else:
        # Expected normal order statistics of the upper half, largest first.
        m = np.array([-normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, half + 1)])
        total = 2.0 * float(m @ m)
        root = 1.0 / math.sqrt(n)
        fixed = [m[0] / math.sqrt(total) + _poly(W_LAST, root)]
        if n > 5:
            fixed.append(m[1] / math.sqrt(total) + _poly(W_NEXT, root))
        k = len(fixed)
        head = np.array(fixed)
        scale = math.sqrt((total - 2.0 * float(m[:k] @ m[:k])) / (1.0 - 2.0 * float(head @ head)))
        weights = np.concatenate([head, m[k:] / scale])
    spread = x[::-1][:half] - x[:half]
    w = min(float(weights @ spread) ** 2 / float(((x - x.mean()) ** 2).sum()), 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w >= 1.0:
        return w, 1.0
    y = math.log1p(-w)
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        mean, sd = _poly(LARGE_MEAN, math.log(n)), math.exp(_poly(LARGE_LOG_SD, math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))


# Royston (1993), the normal approximation of log(1 - W') for the Shapiro-Francia form.
FRANCIA_MEAN, FRANCIA_SD = [-1.2725, 1.0521], [1.0308, -0.26758]
# Wichura (1988), algorithm AS 241, rational approximations of the normal quantile: centre, near and far
# tail, numerator and denominator in ascending powers.
QUANTILE_CENTRE = ([3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457,
                    67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
                   [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
                    39307.895800092710610, 28729.085735721942674, 5226.4952788528545610])
QUANTILE_NEAR = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
                  0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
                 [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
                  0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
QUANTILE_FAR = ([6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930,
                 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
                [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4,
                 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal distribution, to some 16 places; p strictly between 0 and 1."""
    def ratio(parts: tuple[list[float], list[float]], x: np.ndarray) -> np.ndarray:
        return np.polynomial.polynomial.polyval(x, parts[0]) / np.polynomial.polynomial.polyval(x, parts[1])

    p = np.asarray(p, dtype=float)
    q = p - 0.5
    tail = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    outer = np.where(tail <= 5.0, ratio(QUANTILE_NEAR, tail - 1.6), ratio(QUANTILE_FAR, tail - 5.0))
    return np.where(np.abs(q) <= 0.425, q * ratio(QUANTILE_CENTRE, 0.180625 - q * q), np.sign(q) * outer)


def shapiro_francia_p(w: float, n: int) -> float | None:
    """p of the Shapiro-Francia statistic, from 5 values on; beyond 5000 the approximation is carried on."""
    if n < 5:
        return None
    if w >= 1.0:
        return 1.0
    u = math.log(n)
    v = math.log(u)
    z = (math.log1p(-w) - FRANCIA_MEAN[0] - FRANCIA_MEAN[1] * (v - u)) / (FRANCIA_SD[0] + FRANCIA_SD[1] * (v + 2.0 / u))
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated front to back."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1.0) < 1e-15:
            break
    return out


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float | None, n: float) -> float | None:
    """Two-sided p-value of a correlation, from Student's t with n - 2 degrees of freedom."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    # t^2 / (df + t^2) equals r^2, so the tail area is an incomplete beta of 1 - r^2.
    return regularized_beta((n - 2) / 2.0, 0.5, 1.0 - r * r)


def correlation_p_value():
    """Column function (r, n) -> p for a few aggregate rows."""
    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, b) for a, b in zip(r, n)], dtype="float64")

    return p_value
