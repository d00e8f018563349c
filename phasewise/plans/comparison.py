"""Treatment comparisons: population, weights, tables and outcomes."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from phasewise import names
from phasewise.functions.lineage import cut
from phasewise.operators import outcomes, populations, propensity, table_one
from phasewise.sources.tables import write_table


@dataclass(frozen=True)
class Comparison:
    """One comparison. The treatment of the weights and that of the outcome models are
    separate settings, as early treatment is weighted by one and analysed by the other (C30)."""

    name: str
    population: Callable[[DataFrame], DataFrame]
    weight_treatment: str = names.TREATMENT
    outcome_treatment: str = names.TREATMENT
    numeric: tuple[str, ...] = tuple(names.SCORE_NUMERIC)
    categorical: tuple[str, ...] = tuple(names.SCORE_CATEGORICAL)
    trim: tuple[float, float] = names.TRIM_QUANTILES
    outcomes: tuple[str, ...] = tuple(names.OUTCOMES)
    adjust_for: tuple[str, ...] = tuple(names.ADJUSTED_FOR)


VS_UNTREATED = Comparison("vs_untreated", populations.population_vs_untreated)
ACTIVE_COMPARATOR = Comparison("active_comparator", populations.population_active_comparator)
EARLY_TREATMENT = Comparison(
    "early_treatment",
    populations.population_vs_untreated,
    weight_treatment=names.EARLY_TREATMENT,
    numeric=tuple(names.SCORE_NUMERIC_BASE),
    trim=names.EARLY_TRIM_QUANTILES,
)
LONG_TERM = Comparison(
    "long_term", populations.population_followup, outcomes=(names.LONG_TERM_OUTCOME,)
)
COMPARISONS = [VS_UNTREATED, ACTIVE_COMPARATOR, EARLY_TREATMENT, LONG_TERM]


def weighted(analysis: DataFrame, comparison: Comparison) -> DataFrame:
    """The comparison's population with scores and weights, trimmed; written, as every
    table of the comparison reads it."""
    return cut(
        propensity.weighted_population(
            comparison.population(analysis), comparison.weight_treatment,
            list(comparison.numeric), list(comparison.categorical), comparison.trim,
        )
    )


class ComparisonResult:
    """Everything a comparison reports, each table built when it is asked for.

    ``rows`` are scored, weighted, trimmed and written; ``fit`` says whether their model
    converged and how many rows it left out. Tables without weights describe the same rows.
    """

    def __init__(self, comparison: Comparison, rows: DataFrame, fit: DataFrame):
        self.comparison, self.rows, self.fit = comparison, rows, fit

    def _arms(self, of: Callable[..., DataFrame], *weight: str) -> DataFrame:
        return of(self.rows, self.comparison.outcome_treatment, names.TABLE_NUMERIC, names.TABLE_CATEGORICAL, *weight)

    def description(self) -> DataFrame:
        return self._arms(table_one.table_one)

    def description_weighted(self) -> DataFrame:
        return self._arms(table_one.table_one, "ipw")

    def differences(self) -> DataFrame:
        return self._arms(table_one.smd)

    def differences_weighted(self) -> DataFrame:
        return self._arms(table_one.smd, "ipw")

    def tests(self) -> DataFrame:
        return self._arms(table_one.group_tests)

    def tests_weighted(self) -> DataFrame:
        return self._arms(table_one.group_tests_weighted, "ipw")

    def balance(self) -> DataFrame:
        return balance(self.rows, self.comparison.outcome_treatment)

    def outcomes(self) -> DataFrame:
        return outcome_table(self.rows, self.comparison)

    def outcomes_adjusted(self) -> DataFrame:
        return outcomes_adjusted(self.rows, self.comparison)


TABLES = ("description description_weighted differences differences_weighted tests tests_weighted "
          "balance outcomes outcomes_adjusted").split()


def compare(analysis: DataFrame, comparison: Comparison, on_missing: str = "error") -> ComparisonResult:
    """One comparison: its population is weighted and written, and all ``TABLES`` read that copy."""
    found = propensity.fitted_population(
        comparison.population(analysis), comparison.weight_treatment,
        list(comparison.numeric), list(comparison.categorical), comparison.trim, on_missing,
    )
    return ComparisonResult(comparison, cut(found.scored), found.report)


def write_comparison(result: ComparisonResult, folder: str) -> None:
    """Write the rows, the fit and every table to ``folder/<name>`` as parquet."""
    for name, df in {"rows": result.rows, "fit": result.fit, **{t: getattr(result, t)() for t in TABLES}}.items():
        write_table(df, folder, name)


def outcomes_adjusted(weighted_rows: DataFrame, comparison: Comparison) -> DataFrame:
    """Weighted odds ratios of all outcomes with further covariates."""
    return outcomes.odds_ratio_adjusted(
        weighted_rows, list(comparison.outcomes), comparison.outcome_treatment, list(comparison.adjust_for), "ipw"
    )


def outcome_table(weighted_rows: DataFrame, comparison: Comparison) -> DataFrame:
    return outcomes.outcome_table(
        weighted_rows, comparison.name, comparison.outcome_treatment, list(comparison.outcomes)
    )


def description(rows: DataFrame, treat: str = names.TREATMENT, weight: str | None = None) -> DataFrame:
    """The comparison's table of variables by arm."""
    return table_one.table_one(rows, treat, names.TABLE_NUMERIC, names.TABLE_CATEGORICAL, weight)


def balance(weighted_rows: DataFrame, treat: str = names.TREATMENT) -> DataFrame:
    return table_one.balance(
        weighted_rows, treat, names.BALANCE_NUMERIC, names.BALANCE_CATEGORICAL, "ipw"
    )
