"""Formulas as column expressions. ``p`` is the counter side, ``q`` the set."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart/West rational approximation of the normal tail, highest power first.
TAIL_NUMERATOR = (
    3.52624965998911e-2,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-2,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
TAIL_END = 37.0
ROOT_TWO_PI = 2.506628274631


def x_log_x(x: Column) -> Column:
    """x ln x, 0 at 0."""
    value = x.cast("double")
    return F.when(x > 0, value * F.log(value)).otherwise(F.lit(0.0))


def rate(mean: Column) -> Column:
    """Rate of the exponential distribution with this mean; null for mean 0."""
    return F.when(mean > 0, 1.0 / mean)


def exponential_divergence(rate_p: Column, rate_q: Column) -> Column:
    """KL(p || q) of two exponential distributions."""
    return F.log(rate_p) - F.log(rate_q) + rate_q / rate_p - 1.0


def normal_divergence(
    mean_p: Column, var_p: Column, mean_q: Column, var_q: Column, formula: str = "squared_variance"
) -> Column:
    """KL(p || q) of two normal distributions. ``squared_variance`` squares the variances
    once more, as the original measure does; ``textbook`` does not. Null when a
    variance is missing or 0."""
    if formula == "squared_variance":
        p, q = var_p * var_p, var_q * var_q
    elif formula == "textbook":
        p, q = var_p, var_q
    else:
        raise ValueError(f"unknown formula: {formula}")
    gap = mean_p - mean_q
    return F.when((p > 0) & (q > 0), 0.5 * (gap * gap / q + p / q + F.log(q / p) - 1.0))


def exponential_mass(rate_: Column, x: Column) -> Column:
    """Probability of [x, x + 1) under the exponential distribution."""
    return F.exp(-rate_ * x) - F.exp(-rate_ * (x + 1))


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Spark SQL has none)."""
    a = F.abs(z)
    body = F.exp(-z * z / 2.0)
    near = body * _horner(TAIL_NUMERATOR, a) / _horner(TAIL_DENOMINATOR, a)
    fraction = a + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = a + step / fraction
    far = body / (fraction * ROOT_TWO_PI)
    tail = F.when(a > TAIL_END, F.lit(0.0)).when(a < TAIL_SWITCH, near).otherwise(far)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def normal_mass(mean: Column, deviation: Column, x: Column) -> Column:
    """Probability of [x, x + 1) under the normal distribution."""
    safe = F.when(deviation > 0, deviation)
    return normal_cdf((x + 1 - mean) / safe) - normal_cdf((x - mean) / safe)


def log_normal_height(variance: Column) -> Column:
    """ln of the normal density at its mean."""
    return -0.5 * F.log(variance) - 0.5 * math.log(2 * math.pi)
