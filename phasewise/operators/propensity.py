"""Treatment probability, weights from it, and trimming."""

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import RFormula, VectorSlicer
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, functions as F

from phasewise.functions.lineage import cut
from phasewise.functions.quantiles import exact_quantiles
from phasewise.names import TRIM_QUANTILES

SCORE = "pr_score"
MAX_ITERATIONS = 25
TOLERANCE = 1e-8
# A fitted probability this near to 0 or 1 comes from a coefficient on its way to infinity.
SEPARATED = 1e-8
# A covariate of which this share of its variance is its own follows from those before it.
DEPENDENT = 1e-9


class NotConverged(ArithmeticError):
    """A model without a finite maximum-likelihood estimate, or one not reached in time."""


@dataclass(frozen=True)
class Fit:
    """Scored rows, and what the fit has to report: one row with treatment, rows used and left
    out, iterations, whether it converged, and the covariates that follow from others (aliased)."""

    scored: DataFrame
    report: DataFrame


def fit(
    df: DataFrame,
    treat: str,
    numeric: list[str],
    categorical: list[str],
    on_missing: str = "error",
    on_failure: str = "error",
) -> Fit:
    """Fitted probability of treatment from a logistic model.

    The alphabetically first level of a category is its reference level. A missing covariate
    is an error; ``on_missing='skip'`` leaves such rows out of model and result and counts
    them in the report. A fit that stops at its last iteration, or that drives a probability to
    0 or 1 (separation), raises ``NotConverged``; with ``on_failure='mark'`` the scores are null
    instead and the report says so. A covariate that is constant or follows from those before it
    gets no coefficient, as its share cannot be told apart; the scores are the same without it.
    The fit passes over the data once per iteration, so the model columns are kept in memory (or
    on local disk) while it runs.
    """
    formula = RFormula(
        formula=f"{treat} ~ " + " + ".join([*numeric, *categorical]),
        featuresCol="_features", labelCol="_label",
        stringIndexerOrderType="alphabetDesc", handleInvalid=on_missing,
    ).fit(df)
    prepared = formula.transform(df)
    model_rows = prepared.select("_features", "_label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        names, own = _independent(model_rows)
        slicer = VectorSlicer(inputCol="_features", outputCol="_own", indices=own)
        prepared, model_rows_own = slicer.transform(prepared), slicer.transform(model_rows)
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", featuresCol="_own", labelCol="_label",
            predictionCol=SCORE, maxIter=MAX_ITERATIONS, tol=TOLERANCE,
        ).fit(model_rows_own)
        iterations = model.summary.numIterations
        used, low, high = model.transform(model_rows_own).agg(
            F.count("*"), F.min(SCORE), F.max(SCORE)).first()
    finally:
        model_rows.unpersist()
    converged = iterations < MAX_ITERATIONS and low > SEPARATED and high < 1 - SEPARATED
    if not converged and on_failure == "error":
        raise NotConverged(
            f"the model of {treat} has no estimate after {iterations} iterations; "
            f"fitted probabilities from {low:.3g} to {high:.3g}")
    scored = model.transform(prepared).select(*df.columns, SCORE)
    if not converged:
        scored = scored.withColumn(SCORE, F.lit(None).cast("double"))
    left_out = df.count() - used if on_missing == "skip" else 0
    report = df.sparkSession.createDataFrame(
        [(treat, used, left_out, iterations, converged, ",".join(n for i, n in enumerate(names) if i not in own))],
        "treatment string, rows long, rows_left_out long, iterations int, converged boolean, aliased string")
    return Fit(scored, report)


def _independent(rows: DataFrame) -> tuple[list[str], list[int]]:
    """Names of the entries of ``_features``, and the numbers of those that do not follow from earlier ones.

    Their variances and correlations come from two passes; the elimination needs no more than that
    matrix, whose size is the number of covariates.
    """
    attributes = rows.schema["_features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])]
    varying = rows.select(Summarizer.variance(F.col("_features"))).first()[0].toArray() > 0
    rest = np.where(np.outer(varying, varying), Correlation.corr(rows, "_features").first()[0].toArray(), 0.0)
    own = []
    for i in range(len(rest)):
        if rest[i, i] > DEPENDENT:
            own.append(i)
            rest = rest - np.outer(rest[:, i], rest[i]) / rest[i, i]
    return names, own


def propensity(
    df: DataFrame,
    treat: str,
    numeric: list[str],
    categorical: list[str],
    on_missing: str = "error",
    on_failure: str = "error",
) -> DataFrame:
    """``df`` with the fitted probability of treatment; see ``fit``."""
    return fit(df, treat, numeric, categorical, on_missing, on_failure).scored


def ip_weights(df: DataFrame, treat: str, score: str = SCORE) -> DataFrame:
    """Add iptw, wt_stab and ipw; the treated share is taken over all rows given (C23, C24)."""
    share = df.agg(F.avg(treat)).scalar()
    s = F.col(score)
    treated = F.try_divide(share, s)
    control = F.try_divide(1 - share, 1 - s)
    return df.withColumns({
        "iptw": F.try_divide(F.lit(1.0), s),
        "wt_stab": treated,
        "ipw": F.when(F.col(treat) == 1, treated).otherwise(control),
    })


def trim_by_quantile(
    df: DataFrame, column: str = SCORE, low: float = TRIM_QUANTILES[0], high: float = TRIM_QUANTILES[1]
) -> DataFrame:
    """Rows strictly between two exact quantiles of the column."""
    cuts = exact_quantiles(df, column, [low, high]).select(F.struct("q0", "q1")).scalar()
    return df.where((F.col(column) > cuts["q0"]) & (F.col(column) < cuts["q1"]))


def weighted_population(
    df: DataFrame,
    treat: str,
    numeric: list[str],
    categorical: list[str],
    trim: tuple[float, float] = TRIM_QUANTILES,
) -> DataFrame:
    """Score, weigh and trim a population. It is written once, and once more with its scores."""
    return fitted_population(df, treat, numeric, categorical, trim).scored


def fitted_population(
    df: DataFrame,
    treat: str,
    numeric: list[str],
    categorical: list[str],
    trim: tuple[float, float] = TRIM_QUANTILES,
    on_missing: str = "error",
) -> Fit:
    """The same with the report of the fit."""
    found = fit(cut(df), treat, numeric, categorical, on_missing)
    scored = cut(found.scored)
    return Fit(trim_by_quantile(ip_weights(scored, treat), SCORE, *trim), found.report)


def overlap_histogram(
    df: DataFrame, treat: str, column: str = "ipw", low: float = 0.0, high: float = 5.0, bins: int = 50
) -> DataFrame:
    """Rows per arm and equal-width bin; bin 0 is below ``low``, bin ``bins + 1`` from ``high`` on."""
    bucket = F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(F.col(treat).alias("arm"), bucket.alias("bin")).agg(F.count("*").alias("n"))
