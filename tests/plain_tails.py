"""Upper tails by series and continued fractions, to compare with."""

import math


def chi_square_tail(x: float, df: float) -> float:
    """P(chi-square with ``df`` degrees of freedom > x)."""
    return _gamma_tail(df / 2, x / 2)


def f_tail(x: float, df1: float, df2: float) -> float:
    """P(F with ``df1`` and ``df2`` degrees of freedom > x)."""
    return _beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def _gamma_tail(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    return scale * _fraction(lambda i: (x + 2 * i + 1 - a, -i * (i - a)))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a

    def term(i: int) -> tuple[float, float]:
        m = i // 2
        if i == 0:
            return 1.0, 0.0
        if i % 2:
            return 1.0, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1.0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return scale * _fraction(term)


def _fraction(term, limit: int = 100_000) -> float:
    """1 / (b0 + a1 / (b1 + a2 / (b2 + ...))) with ``term(i) = (b_i, a_i)``."""
    tiny = 1e-300
    b, _ = term(0)
    c, d = 1 / tiny, 1 / (b or tiny)
    value = d
    for i in range(1, limit):
        b, a = term(i)
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            return value
    raise ArithmeticError(f"a continued fraction did not settle in {limit} steps")
