"""Bisection as a column expression."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bisect(accepted: Callable[[Column], Column], inside: Column, outside: Column, steps: int = 60) -> Column:
    """The last accepted point on the way from ``inside`` to ``outside``."""
    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["inside"] + ends["outside"]) / 2
        ok = accepted(middle)
        return F.struct(
            F.when(ok, middle).otherwise(ends["inside"]).alias("inside"),
            F.when(ok, ends["outside"]).otherwise(middle).alias("outside"),
        )

    start = F.struct(inside.alias("inside"), outside.alias("outside"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda ends: ends["inside"])
