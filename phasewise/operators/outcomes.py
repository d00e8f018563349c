"""Odds ratios of outcomes by treatment, with profile-likelihood intervals."""

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions.lineage import cut, scratch
from phasewise.functions.roots import bisect
from phasewise.operators.propensity import NotConverged

# 97.5 % point of the normal distribution: the limits are where the signed root of the
# scaled deviance reaches it.
Z = 1.959963984540054
INTERCEPT = "(Intercept)"
# Log odds beyond this are as good as infinite.
FAR = 40.0
MAX_STEPS = 50
TOLERANCE = 1e-9
ROUNDING = 1e-9
# Parts of a Newton step that are tried together where the whole one fails.
STEP_PARTS = [2.0**-k for k in range(1, 8)]
REACHED, OPEN, NOT_SETTLED = "reached", "open", "not settled"


def outcome_cells(df: DataFrame, treat: str, outcomes: list[str], weight: str | None = None) -> DataFrame:
    """Per outcome: rows and the cells n11, n10, n01, n00 (treated first, outcome second).

    One row with counts and, given a weight, one with weight sums (``weighted``). The data
    is grouped once by treatment and all outcomes; the few resulting rows are then split by
    outcome. Rows with a missing outcome are left out of that outcome only.
    """
    w = F.lit(None).cast("double") if weight is None else F.col(weight).cast("double")
    grouped = df.where(F.col(treat).isNotNull()).groupBy(
        F.col(treat).alias("t"), *[F.col(y).alias(y) for y in outcomes]
    ).agg(F.count("*").alias("rows"), F.sum(w).alias("w"))
    kinds = [(False, F.col("rows").cast("double"))] + ([] if weight is None else [(True, F.col("w"))])
    sizes = F.array(*[F.struct(F.lit(k).alias("weighted"), size.alias("size")) for k, size in kinds])
    long = (
        grouped.unpivot(["t", "rows", "w"], outcomes, "outcome", "y")
        .where(F.col("y").isNotNull())
        .select("outcome", "t", "y", "rows", F.inline(sizes))
    )

    def cell(t: int, y: int) -> Column:
        found = F.sum(F.when((F.col("t") == t) & (F.col("y") == y), F.col("size")))
        return F.coalesce(found, F.lit(0.0)).alias(f"n{t}{y}")

    return long.groupBy("outcome", "weighted").agg(
        F.sum("rows").alias("rows"), cell(1, 1), cell(1, 0), cell(0, 1), cell(0, 0)
    )


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.ln(y)).otherwise(0.0)


def _arm_likelihood(events: Column, others: Column) -> Column:
    total = events + others
    return _xlogy(events, events / total) + _xlogy(others, others / total)


def _limits(estimate: Column, loss: Callable[[Column], Column], dispersion: Column) -> tuple[Column, Column]:
    """Both ends of {b : 2 loss(b) / dispersion <= Z^2}; an end without data is null."""
    def accepted(b: Column) -> Column:
        return 2 * loss(b) <= Z * Z * dispersion

    start = F.greatest(F.least(estimate, F.lit(FAR)), F.lit(-FAR))
    low = F.when(estimate > -FAR, bisect(accepted, start, start - 2 * FAR))
    high = F.when(estimate < FAR, bisect(accepted, start, start + 2 * FAR))
    return low, high


def _log_ratio(top: Column, bottom: Column) -> Column:
    return (
        F.when((top > 0) & (bottom > 0), F.ln(top) - F.ln(bottom))
        .when(top > 0, F.lit(2 * FAR))
        .when(bottom > 0, F.lit(-2 * FAR))
    )


def _safe_exp(x: Column) -> Column:
    return F.when(x >= 2 * FAR, F.lit(float("inf"))).when(x <= -2 * FAR, F.lit(0.0)).otherwise(F.exp(x))


def cell_odds_ratios(cells: DataFrame, treat: str) -> DataFrame:
    """Odds ratios and intervals from outcome cells, without going back to the data.

    A logistic model of treatment alone is saturated: its estimates are ratios of cells, its
    weighted dispersion is the weight sum over (rows - 2). For a fixed treatment effect the
    best intercept solves a quadratic, so each limit is a bisection on closed-form values;
    the intercept's limits involve the control arm only.
    """
    a, b, c, d = (F.col(n) for n in ("n11", "n10", "n01", "n00"))
    treated, control, events = a + b, c + d, a + c
    dispersion = F.when(F.col("weighted"), (treated + control) / (F.col("rows") - 2)).otherwise(1.0)
    best_control = _arm_likelihood(c, d)
    best = _arm_likelihood(a, b) + best_control

    def treatment_loss(effect: Column) -> Column:
        ratio = F.exp(effect)
        square = ratio * (treated + control - events)
        linear = treated * ratio + control - events * (1 + ratio)
        odds = (F.sqrt(linear * linear + 4 * square * events) - linear) / (2 * square)
        return best - (
            _xlogy(a, ratio * odds) + _xlogy(c, odds) - treated * F.log1p(ratio * odds) - control * F.log1p(odds)
        )

    def intercept_loss(base: Column) -> Column:
        return best_control - (c * base - control * F.log1p(F.exp(base)))

    def term(name: str, estimate: str, loss: Callable[[Column], Column]) -> Column:
        low, high = _limits(F.col(estimate), loss, F.col("dispersion"))
        return F.struct(
            F.lit(name).alias("term"), _safe_exp(F.col(estimate)).alias("odds_ratio"),
            F.exp(low).alias("ci_low"), F.exp(high).alias("ci_high"),
        )

    estimated = cells.withColumns({
        "base": _log_ratio(c, d), "effect": _log_ratio(a * d, b * c), "dispersion": dispersion,
    })
    terms = F.array(term(INTERCEPT, "base", intercept_loss), term(treat, "effect", treatment_loss))
    return estimated.select("outcome", "weighted", F.inline(terms))


def odds_ratios(df: DataFrame, treat: str, outcomes: list[str], weight: str | None = None) -> DataFrame:
    """(outcome, weighted, term, odds_ratio, ci_low, ci_high) for intercept and treatment."""
    cells = outcome_cells(df, treat, outcomes, weight).where(F.col("weighted") == F.lit(weight is not None))
    return cell_odds_ratios(cells, treat)


def outcome_table(
    df: DataFrame, comparison: str, treat: str, outcomes: list[str], weight: str = "ipw"
) -> DataFrame:
    """Weighted and unweighted odds ratios of all outcomes of a comparison, in long form."""
    both = cell_odds_ratios(outcome_cells(df, treat, outcomes, weight), treat)
    return both.select(F.lit(comparison).alias("comparison"), *both.columns)


def odds_ratio_adjusted(
    df: DataFrame, outcomes: list[str], treat: str, covariates: list[str], weight: str, on_failure: str = "error"
) -> DataFrame:
    """Weighted odds ratios with further covariates, quasi-binomial dispersion, per outcome.

    Rows with equal covariates, treatment and outcomes are merged first and carry their
    weight sum; that table is written, and each pass of the fit reads it once for all outcomes, terms and
    sides together. Rows with a missing value are left out of an outcome and counted. The profile
    limits come from Newton's method on "likelihood at its limit, other slopes zero" (Venzon and Moolgavkar
    1988) inside brackets: a step that leaves what is known to hold the limit is replaced by a
    halving or doubling of the distance. ``ci_low_status`` and ``ci_high_status`` tell a limit that was
    ``reached`` from one that is ``open`` (null: the likelihood stays above its limit all the way) and
    one ``not settled`` after ``MAX_STEPS`` passes (null).

    A model without a finite estimate (separated data) raises ``NotConverged``; with
    ``on_failure='mark'`` its numbers are null and ``converged`` is false.
    """
    terms = [treat, *covariates]
    spark = df.sparkSession
    found = []
    with scratch(spark):
        grouped = df.groupBy(*terms, *[F.col(y).cast("double").alias(y) for y in outcomes]).agg(
            F.count("*").alias("_rows"), F.sum(weight).alias("_w"))
        patterns = cut(grouped.unpivot([*terms, "_rows", "_w"], outcomes, "_outcome", "_y").select(
            "_outcome", *[F.col(t).cast("double").alias(t) for t in terms], "_y", "_rows", "_w", F.lit(1.0).alias(INTERCEPT)))
        complete = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in (*terms, "_y", "_w")])
        own = F.when(complete, F.col("_rows"))
        counts = {r[0]: (r[1], r[2] or 0, [1.0, *r[3:]]) for r in patterns.groupBy("_outcome").agg(
            F.sum("_rows"), F.sum(own), *[F.sqrt(F.try_divide(F.sum(own * F.pow(f"`{t}`", F.lit(2))), F.sum(own))) for t in terms]).collect()}
        models = {y: _profile([INTERCEPT, *terms], *counts[y][1:]) for y in outcomes if y in counts}
        results = _evaluated(patterns.where(complete), [INTERCEPT, *terms], models)
    for outcome in outcomes:
        rows, used = counts.get(outcome, (0, 0))[:2]
        fit = results.get(outcome, NotConverged("no rows"))
        if isinstance(fit, NotConverged):
            if on_failure == "error":
                raise NotConverged(f"{outcome}: {fit}")
            fit = {t: (None,) * 5 for t in (INTERCEPT, *terms)}
        found += [(outcome, True, term, *row, row[0] is not None, rows - used) for term, row in fit.items()]
    return spark.createDataFrame(
        found, "outcome string, weighted boolean, term string, odds_ratio double, ci_low double, ci_high double, "
               "ci_low_status string, ci_high_status string, converged boolean, rows_left_out long")


@dataclass(frozen=True)
class Point:
    """Log-likelihood, gradient, information and Pearson sum at some coefficients."""

    value: float
    gradient: np.ndarray
    information: np.ndarray
    pearson: float


# A fit asks for points and is sent what was found there.
Steps = Generator[list[np.ndarray], list[Point], Any]


def _evaluated(patterns: DataFrame, terms: list[str], models: dict[str, Steps]) -> dict[str, Any]:
    """What each model returns, or the ``NotConverged`` it raises; all ask together, one pass a round."""
    done: dict[str, Any] = {}
    asked: dict[str, list[np.ndarray]] = {}
    answers: dict[str, list[Point] | None] = dict.fromkeys(models)
    while len(done) < len(models):
        asked.clear()
        for name, model in models.items():
            if name in done:
                continue
            try:
                asked[name] = model.send(answers[name])
            except StopIteration as end:
                done[name] = end.value
            except NotConverged as failure:
                done[name] = failure
        if asked:
            answers = _likelihoods(patterns, terms, asked)
    return done


def _likelihoods(patterns: DataFrame, terms: list[str], betas: dict[str, list[np.ndarray]]) -> dict[str, list[Point]]:
    """Every outcome at several coefficient vectors, in one pass."""
    size = len(terms)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    at = F.coalesce(*[
        F.when(F.col("_outcome") == name, F.array(*[F.array(*[F.lit(float(v)) for v in beta]) for beta in own]))
        for name, own in betas.items()
    ])
    x, y, w, eta, mu = [F.col(f"`{t}`") for t in terms], *map(F.col, ("_y", "_w", "eta", "mu"))
    fitted = (
        patterns.where(F.col("_outcome").isin(list(betas))).select("*", F.posexplode(at).alias("k", "beta"))
        .withColumn("eta", reduce(Column.__add__, [F.col("beta")[i] * x[i] for i in range(size)]))
        .withColumn("mu", 1 / (1 + F.exp(-eta)))
        .withColumn("v", w * mu * (1 - mu))
    )
    sums = [F.sum(w * (y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))))]
    sums += [F.sum(w * (y - mu) * x[i]) for i in range(size)]
    sums += [F.sum(F.col("v") * x[i] * x[j]) for i, j in pairs]
    sums += [F.sum(F.try_divide(F.pow(w * (y - mu), 2), F.col("v")))]
    found: dict[str, list] = {name: [None] * len(own) for name, own in betas.items()}
    for name, k, value, *rest, pearson in fitted.groupBy("_outcome", "k").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect():
        information = np.zeros((size, size))
        for (i, j), v in zip(pairs, rest[size:]):
            information[i, j] = information[j, i] = v
        found[name][k] = Point(value, np.array(rest[:size]), information, pearson)
    return found


def _solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray | None:
    try:
        found = np.linalg.solve(matrix, vector)
    except np.linalg.LinAlgError:
        return None
    return found if np.isfinite(found).all() else None


def _maximum(size: int) -> Steps:
    """The estimate and its point. Only a Newton step that does not raise the likelihood is tried in parts."""
    beta = np.zeros(size)
    (best,) = yield [beta]
    for _ in range(MAX_STEPS):
        step = _solve(best.information, best.gradient)
        if step is None or np.abs(beta).max() > FAR:
            raise NotConverged("the data are separated: the estimate runs to infinity")
        (whole,) = yield [beta + step]
        if np.abs(step).max() < TOLERANCE:
            return beta + step, whole
        tried = {1.0: whole}
        if not whole.value >= best.value - ROUNDING * abs(best.value):
            tried = dict(zip(STEP_PARTS, (yield [beta + part * step for part in STEP_PARTS])))
        part = max(tried, key=lambda k: (tried[k].value if math.isfinite(tried[k].value) else -math.inf, k))
        if not tried[part].value >= best.value - ROUNDING * abs(best.value):
            raise NotConverged("no part of a Newton step raises the likelihood")
        beta, best = beta + part * step, tried[part]
    raise NotConverged(f"no estimate after {MAX_STEPS} steps")


class Limit:
    """One end of a profile interval: where the best likelihood for a fixed coefficient meets its limit.

    ``inside`` is the furthest point known to lie above the limit, ``outside`` the nearest value of the
    coefficient known to lie below; the profile is concave, so the end is between them.
    """

    def __init__(self, i: int, side: int, beta: np.ndarray, error: np.ndarray, best: float, target: float, far: float):
        self.i, self.side, self.start, self.best, self.target = i, side, beta[i], best, target
        self.inside, self.outside = beta, math.inf
        self.at = beta + side * error
        self.far = far
        self.status, self.value = NOT_SETTLED, None
        self.undecided = 0

    def _distance(self, b: float) -> float:
        return self.side * (b - self.start)

    def move(self, p: Point) -> bool:
        """Learn from the point at ``at`` and go on; whether there is more to do."""
        i, at, here = self.i, self.at, self._distance(self.at[self.i])
        others = np.arange(len(at)) != i
        inner = p.information[np.ix_(others, others)]
        turn = _solve(inner, np.column_stack([p.gradient[others], p.information[others, i]])) if others.any() else np.zeros((0, 2))
        raised = math.inf if turn is None else 0.5 * float(p.gradient[others] @ turn[:, 0])  # by the best other slopes
        if p.value >= self.target:
            self.undecided = 0
            if here > self._distance(self.inside[i]):
                self.inside = at
            if here > self.far:
                self.status = OPEN
                return False
        elif raised < 0.1 * (self.best - self.target) and p.value + 2 * raised < self.target:
            self.undecided = 0
            self.outside = min(self.outside, here)
        else:
            self.undecided += 1
        aim, slopes = p.gradient.copy(), -p.information.copy()
        aim[i], slopes[i] = p.value - self.target, p.gradient
        step = _solve(slopes, aim)
        if step is not None:
            goal = self._distance(at[i] - step[i])
            if np.abs(step).max() < TOLERANCE and goal > 0:
                self.status, self.value = REACHED, at[i] - step[i]
                return False
            low = self._distance(self.inside[i])
            high = self.outside if math.isfinite(self.outside) else 2 * max(here, low)
            if low < goal < high and self.undecided < 2:
                self.at = at - step
                return True
        if self.undecided or turn is None:
            self.at = (self.inside + at) / 2  # towards a point that is known to be good
            return True
        low = self._distance(self.inside[i])
        if math.isfinite(self.outside):
            if self.outside - low < TOLERANCE:
                self.status, self.value = REACHED, self.start + self.side * (low + self.outside) / 2
                return False
            goal = (low + self.outside) / 2
        else:
            goal = 2 * max(here, low)
        moved = self.start + self.side * goal - at[i]
        self.at = at.copy()
        self.at[i] += moved
        self.at[others] += turn[:, 0] - turn[:, 1] * moved
        return True


def _profile(terms: list[str], count: int, scales: list[float]) -> Steps:
    """Odds ratio, limits and their status per term; scales: the usual size of each term's values."""
    beta, best = yield from _maximum(len(terms))
    if count <= len(terms):
        raise NotConverged("not more rows than terms")
    dispersion = best.pearson / (count - len(terms))
    target = best.value - Z * Z * dispersion / 2
    covariance = np.linalg.inv(best.information) * dispersion
    limits = [
        Limit(i, side, beta, Z * covariance[:, i] / math.sqrt(covariance[i, i]), best.value, target, FAR / (scales[i] or 1))
        for i in range(len(terms)) for side in (-1, 1)
    ]
    moving = limits
    for _ in range(MAX_STEPS):
        if not moving:
            break
        points = yield [end.at for end in moving]
        moving = [end for end, p in zip(moving, points) if end.move(p)]

    def odds(end: Limit) -> float | None:
        return None if end.value is None else math.exp(end.value)

    return {
        term: (math.exp(beta[i]), odds(limits[2 * i]), odds(limits[2 * i + 1]), limits[2 * i].status, limits[2 * i + 1].status)
        for i, term in enumerate(terms)
    }
