"""The Yeo-Johnson power transform as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 2.220446049250313e-16


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo and Johnson (2000), with the logarithmic branches at 0 and 2."""
    gain = F.log1p(F.abs(x))
    other = F.lit(2.0) - lam
    upper = F.when(F.abs(lam) < _TINY, gain).otherwise(F.expm1(gain * lam) / lam)
    lower = F.when(F.abs(other) < _TINY, -gain).otherwise(-F.expm1(gain * other) / other)
    return F.when(x >= 0, upper).otherwise(lower)


def centred_gain(x: Column, origin: Column) -> Column:
    """``log(1 + |x|)`` from ``origin`` on."""
    return F.log1p(F.abs(x)) - origin


def yeo_johnson_from(x: Column, lam: Column, origin: Column) -> Column:
    """The transform without the factor ``exp(power * origin)`` and a constant.

    Values that lie close together far from zero keep their digits in it. Where x has both signs, origin is zero.
    """
    gain, power = centred_gain(x, origin), F.when(x >= 0, lam).otherwise(F.lit(2.0) - lam)
    out = F.when(F.abs(power) < _TINY, gain).otherwise(F.expm1(gain * power) / power)
    return F.when(x >= 0, out).otherwise(-out)


def yeo_johnson_slope(x: Column, lam: Column, origin: Column) -> Column:
    """Derivative of :func:`yeo_johnson_from` by lambda."""
    gain, power = centred_gain(x, origin), F.when(x >= 0, lam).otherwise(F.lit(2.0) - lam)
    near = gain * gain * (F.lit(0.5) + gain * power / 3 + gain * power * gain * power / 8)
    return F.when(F.abs(gain * power) < 1e-5, near).otherwise((F.exp(gain * power) * gain - F.expm1(gain * power) / power) / power)


def log_jacobian(x: Column, origin: Column) -> Column:
    """``sign(x) * (log(1 + |x|) - origin)``, whose sum enters the likelihood."""
    return F.signum(x) * centred_gain(x, origin)
