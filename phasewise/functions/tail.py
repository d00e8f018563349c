"""Upper tail probabilities as column expressions.

Both densities are taken in a variable in which their logarithm is concave with a known least
curvature: the root of chi-square, and the angle whose squared tangent is F * df1 / df2. So all but
a vanishing part of a tail lies between its start and ten standard deviations beyond the mode or
the start, and Simpson's rule with a fixed number of steps integrates it.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

STEPS = 4000
DEVIATIONS = 10
# Stirling's series is used from here on; smaller arguments are shifted.
SHIFT = 15


def _correction(z: Column) -> Column:
    """ln Gamma(z) less its leading terms."""
    s = 1 / (z * z)
    return (1 / z) * (F.lit(1 / 12) - s * (F.lit(1 / 360) - s * (F.lit(1 / 1260) - s / 1680)))


def log_gamma(x: Column) -> Column:
    z = x + SHIFT
    leading = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi)
    return leading + _correction(z) - sum((F.ln(x + k) for k in range(1, SHIFT)), F.ln(x))


def _rise(b: Column, a: Column) -> Column:
    """ln Gamma(b + a) - ln Gamma(b), without the difference of two large numbers."""
    z = b + SHIFT
    shifted = (z - 0.5) * F.log1p(a / z) + a * F.ln(z + a) - a + _correction(z + a) - _correction(z)
    return shifted - sum((F.log1p(a / (b + k)) for k in range(1, SHIFT)), F.log1p(a / b))


def _integral(low: Column, high: Column, constant: Column, log_density: Callable[[Column], Column]) -> Column:
    """Simpson's rule over STEPS steps, narrow ones first: low + (high - low) s^3, as a density may rise like a root from 0."""
    bounds = F.struct(low.alias("low"), (high - low).alias("size"), constant.alias("constant"))

    def add(total: Column, k: Column, at: Column) -> Column:
        weight = F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        s = k / STEPS
        return total + weight * 3 * s * s * F.exp(at["constant"] + log_density(at["low"] + at["size"] * s * s * s))

    # the bounds are computed once per row, as the only element of an array
    parts = F.transform(F.array(bounds), lambda at: at["size"] / (3 * STEPS) * F.aggregate(
        F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda total, k: add(total, k, at)))
    return F.least(F.lit(1.0), parts[0])


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(chi-square with ``df`` >= 1 degrees of freedom > x)."""
    root = F.sqrt(x)
    constant = (1 - df / 2) * math.log(2) - log_gamma(df / 2)
    high = F.greatest(root, F.sqrt(df - 1)) + DEVIATIONS
    tail = _integral(root, high, constant, lambda y: (df - 1) * F.ln(y) - y * y / 2)
    return F.when(x.isNull() | df.isNull(), F.lit(None)).when(x <= 0, 1.0).otherwise(tail)


def f_tail(x: Column, df1: Column, df2: Column) -> Column:
    """P(F with ``df1`` and ``df2`` >= 1 degrees of freedom > x)."""
    small, large = F.least(df1, df2) / 2, F.greatest(df1, df2) / 2
    constant = math.log(2) + _rise(large, small) - log_gamma(small)
    start = F.atan(F.sqrt(df1 * x / df2))
    mode = F.atan(F.sqrt((df1 - 1) / F.greatest(df2 - 1, F.lit(1e-9))))
    spread = DEVIATIONS / F.sqrt(F.greatest(df1 + df2 - 2, F.lit(1.0)))
    high = F.least(F.lit(math.pi / 2), F.greatest(start, mode) + spread)

    def log_density(angle: Column) -> Column:
        sine = F.sin(angle)
        cosine2 = F.greatest(1 - sine * sine, F.lit(1e-24))
        return (df1 - 1) * F.ln(sine) + (df2 - 1) / 2 * F.when(sine < 0.5, F.log1p(-sine * sine)).otherwise(F.ln(cosine2))

    tail = _integral(start, high, constant, log_density)
    return F.when(x.isNull() | df1.isNull() | df2.isNull(), F.lit(None)).when(x <= 0, 1.0).otherwise(tail)


def p_value(statistic: Column, df1: Column, df2: Column) -> Column:
    """F tail, or chi-square tail where ``df2`` is null."""
    return F.when(df2.isNull(), chi_square_tail(statistic, df1)).otherwise(f_tail(statistic, df1, df2))
