"""Exact quantiles of a large column without sorting it in one place."""

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions.lineage import cut

ACCURACY = 10_000
# Values that a bracket may still hold when they are read and counted one by one.
LAST_VALUES = 20_000


@dataclass(frozen=True)
class Bracket:
    """The values strictly between two ends (None: no end), how many there are, how many lie
    below them, and the wanted ranks (from 0, of all values) among them."""

    low: float | None
    high: float | None
    below: int
    inside: int
    ranks: tuple[int, ...]

    def holds(self) -> Column:
        v = F.col("v")
        above = F.lit(True) if self.low is None else v > F.lit(self.low)
        return above if self.high is None else above & (v < F.lit(self.high))


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """One row with q0, q1, ...: linear interpolation between the two nearest order statistics.

    The column is written once, so ``df`` is computed once. All wanted ranks are then narrowed
    down together: one sketch (mergeable, bounded size) gives each of them a bracket of values
    that must hold it, one aggregate counts the values below and inside all brackets, and so on
    within the brackets until each holds few values; one last pass reads those. A round
    leaves about 0.06 % of the values per rank, so two or three serve any size. The number of passes
    does not depend on the number of ranks, and none sorts or collects more than
    ``LAST_VALUES`` values per rank.
    """
    spark = df.sparkSession
    values = cut(df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull()))
    count = values.count()
    if not count:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probabilities))])
    positions = [(count - 1) * p for p in probabilities]
    ranks = sorted({r for at in positions for r in (math.floor(at), math.ceil(at))})
    found = _of_ranks(values, count, tuple(ranks))
    return spark.range(1).select(*[
        F.lit(found[math.floor(at)] + (at - math.floor(at)) * (found[math.ceil(at)] - found[math.floor(at)])).alias(f"q{i}")
        for i, at in enumerate(positions)
    ])


def _of_ranks(values: DataFrame, count: int, ranks: tuple[int, ...]) -> dict[int, float]:
    """The values of some ranks (from 0)."""
    found: dict[int, float] = {}
    brackets = [Bracket(None, None, 0, count, ranks)]
    margin = 3 / ACCURACY
    while wide := [b for b in brackets if b.inside > LAST_VALUES]:
        narrowed, missed = _narrowed(values, wide, margin, found)
        if missed:
            margin *= 2  # the sketch was further off than it may be: wider brackets
        brackets = [b for b in brackets if b not in wide] + narrowed + missed
    if brackets:
        last = (values.where(reduce(Column.__or__, [b.holds() for b in brackets])).groupBy("v")
                .agg(F.count("*").alias("n")).orderBy("v").collect())
        for b in brackets:
            own = [(v, n) for v, n in last if (b.low is None or v > b.low) and (b.high is None or v < b.high)]
            upto, at = b.below, iter(own)
            for rank in b.ranks:
                while upto <= rank:
                    value, n = next(at)
                    upto += n
                found[rank] = value
    return found


def _narrowed(values: DataFrame, brackets: list[Bracket], margin: float, found: dict[int, float]) -> tuple[list[Bracket], list[Bracket]]:
    """Narrower brackets for the ranks of some, and the old ones of ranks that the new ends miss.

    Ranks that fall on an end go to ``found``.  Brackets may overlap.
    """
    v = F.col("v")
    sketches = []
    for i, b in enumerate(brackets):
        shares = [min(1.0, max(0.0, (r - b.below) / (b.inside - 1) + side * margin)) for r in b.ranks for side in (-1, 1)]
        sketches.append(F.percentile_approx(F.when(b.holds(), v), F.array(*map(F.lit, shares)), ACCURACY).alias(f"s{i}"))
    wanted: dict[tuple[float, float], list[tuple[Bracket, int]]] = {}
    for b, ends in zip(brackets, values.agg(*sketches).first()):
        for r, low, high in zip(b.ranks, ends[::2], ends[1::2]):
            wanted.setdefault((low, high), []).append((b, r))
    counts = iter(values.agg(*[
        c.alias(f"c{i}_{j}") for i, (low, high) in enumerate(wanted) for j, c in enumerate((
            F.count_if(v < F.lit(low)), F.count_if(v == F.lit(low)), F.count_if((v > F.lit(low)) & (v < F.lit(high))),
            F.count_if((v == F.lit(high)) & (v > F.lit(low)))))
    ]).first())
    narrowed, missed = [], {}
    for (low, high), own in wanted.items():
        under, at_low, middle, at_high = (next(counts) for _ in range(4))
        left = []
        for b, r in own:
            if not under <= r < under + at_low + middle + at_high:
                missed.setdefault(b, []).append(r)
            elif r < under + at_low:
                found[r] = low
            elif r >= under + at_low + middle:
                found[r] = high
            else:
                left.append(r)
        if left:
            narrowed.append(Bracket(low, high, under + at_low, middle, tuple(sorted(left))))
    return narrowed, [replace(b, ranks=tuple(sorted(r))) for b, r in missed.items()]
