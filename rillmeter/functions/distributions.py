"""Quantiles of the normal and gamma distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wichura (1988), algorithm AS 241, double precision. Coefficients
# run from the constant term upwards.
CENTRAL_NUMERATOR = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRAL_DENOMINATOR = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
MIDDLE_NUMERATOR = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
MIDDLE_DENOMINATOR = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
TAIL_NUMERATOR = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
TAIL_DENOMINATOR = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)


def _polynomial(coefficients: tuple, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _ratio(numerator: tuple, denominator: tuple, x: Column) -> Column:
    return _polynomial(numerator, x) / _polynomial(denominator, x)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, JVM-side."""
    q = p - 0.5
    central = q * _ratio(CENTRAL_NUMERATOR, CENTRAL_DENOMINATOR, F.lit(0.180625) - q * q)
    distance = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(F.lit(1.0) - p)))
    middle = _ratio(MIDDLE_NUMERATOR, MIDDLE_DENOMINATOR, distance - 1.6)
    tail = _ratio(TAIL_NUMERATOR, TAIL_DENOMINATOR, distance - 5.0)
    outer = F.signum(q) * F.when(distance <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, central).otherwise(outer)


def digamma(x: float) -> float:
    """Derivative of log-gamma: recurrence up to 8, then the asymptotic series."""
    shift = 0.0
    while x < 8:
        shift -= 1 / x
        x += 1
    inverse = 1 / (x * x)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240)))
    return shift + math.log(x) - 0.5 / x - series


def gamma_shape(mean: float, mean_log: float) -> float | None:
    """Maximum-likelihood gamma shape of values with this mean and mean logarithm.

    Solves ``log k - digamma(k) = log(mean) - mean_log`` by bisection; the left
    side falls in ``k``. Constant data has no finite shape.
    """
    target = math.log(mean) - mean_log
    if target <= 1e-12:
        return None
    low, high = 1e-8, 1e12
    for _ in range(200):
        middle = math.sqrt(low * high)
        if math.log(middle) - digamma(middle) > target:
            low = middle
        else:
            high = middle
    return math.sqrt(low * high)


#: From this shape on the distribution function comes from its uniform expansion; below, from series and fraction.
LARGE_SHAPE = 1e4
# Temme (1979), first two coefficients of the uniform expansion as power series in eta.
TEMME_FIRST = (
    -1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600, 1 / 25515, -571 / 261273600, -281 / 151559100,
)
TEMME_SECOND = (-1 / 540, -1 / 288, 1 / 378, -77 / 77760, 1 / 4860, -4.0187757201646091e-7)


def _stirling(shape: np.ndarray) -> np.ndarray:
    """Gamma(a) / (sqrt(2 pi / a) (a / e)^a) for large a."""
    t = 1 / shape
    return 1 + t * (1 / 12 + t * (1 / 288 - t * (139 / 51840 + t * 571 / 2488320)))


def _excess(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x / a - 1 - log(x / a), without cancellation near x = a."""
    mu = (x - shape) / shape
    near = mu * mu * (1 / 2 - mu * (1 / 3 - mu * (1 / 4 - mu * (1 / 5 - mu * (1 / 6 - mu / 7)))))
    return np.where(np.abs(mu) < 1e-3, near, mu - np.log1p(np.maximum(mu, np.nextafter(-1, 0))))


def _density_factor(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x^a exp(-x) / Gamma(a + 1)."""
    log_gamma = np.vectorize(math.lgamma, otypes=[float])(np.minimum(shape, 50) + 1)
    few = np.minimum(shape, 50)
    small = np.exp(few * np.log(x) - x - log_gamma)
    large = np.exp(-shape * _excess(shape, x)) / np.sqrt(2 * np.pi * shape) / _stirling(shape)
    return np.where(shape < 50, small, large)


def _series(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower function by its power series, for x <= a + 1: terms fall from the first on."""
    term, total, step = np.ones_like(x), np.ones_like(x), shape.copy()
    while np.any(term > total * 1e-17):
        step = step + 1
        term = term * x / step
        total = total + term
    return _density_factor(shape, x) * total


def _fraction(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper function by its continued fraction (Lentz's method), for x > a + 1."""
    b = x + 1 - shape
    c, d = np.full_like(x, 1e300), 1 / b
    h, i, open_ = d.copy(), 0, np.ones(len(x), bool)
    while open_.any():
        i += 1
        step = -i * (i - shape)
        b = b + 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + step / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = np.where(open_, h * d * c, h)
        open_ &= np.abs(d * c - 1) > 1e-16 * 4
    return _density_factor(shape, x) * shape * h


def _uniform(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower function for large shapes: an error function and two terms of Temme's expansion around x = a."""
    half = _excess(shape, x)
    eta = np.sign(x - shape) * np.sqrt(2 * half)
    centre = np.array([math.erfc(z) / 2 for z in -eta * np.sqrt(shape / 2)])
    near = np.clip(eta, -0.2, 0.2)  # beyond, the exponential is zero
    first, second = (np.polynomial.polynomial.polyval(near, c) for c in (TEMME_FIRST, TEMME_SECOND))
    return centre - np.exp(-shape * half) * (first + second / shape) / np.sqrt(2 * np.pi * shape)


def gamma_cdf(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, for any positive shape.

    Power series up to x = a + 1, continued fraction beyond, uniform expansion from ``LARGE_SHAPE`` on. Each runs until
    its terms no longer count; below ``LARGE_SHAPE`` that takes a few thousand at most.
    """
    shape, x = np.asarray(shape, float), np.maximum(np.asarray(x, float), 1e-300)
    out = np.empty(len(x))
    large = shape >= LARGE_SHAPE
    low = ~large & (x <= shape + 1)
    high = ~large & ~low
    for part, how in ((large, _uniform), (low, _series), (high, lambda a, v: 1 - _fraction(a, v))):
        if part.any():
            out[part] = how(shape[part], x[part])
    return np.clip(out, 0.0, 1.0)


def gamma_ppf(p: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Inverse of :func:`gamma_cdf` by bisection.

    The leading term of the series exceeds the distribution function, so its
    inverse is a lower bound; the upper bound is doubled until it holds ``p``.
    Halving is geometric while the bounds are far apart.
    """
    log_gamma = np.vectorize(math.lgamma)(shape + 1.0)
    low = np.exp(np.maximum((np.log(p) + log_gamma) / shape, -690.0))
    high = np.maximum(shape + 10.0 * np.sqrt(shape) + 10.0, 2.0 * low)
    for _ in range(60):
        short = gamma_cdf(shape, high) < p
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(120):
        middle = np.where(high > 2 * low, np.sqrt(low) * np.sqrt(high), (low + high) / 2)
        below = gamma_cdf(shape, middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
        if np.all(high - low <= 1e-13 * high):
            break
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def gamma_quantile(p: pd.Series, shape: pd.Series) -> pd.Series:
    """Arrow-batched gamma quantile; Spark has no built-in for it."""
    out = np.full(len(p), np.nan)
    known = (p.notna() & shape.notna()).to_numpy()
    if known.any():
        out[known] = gamma_ppf(p.to_numpy()[known], shape.to_numpy()[known].astype(float))
    return pd.Series(out)
