"""One Spark query per treatment-comparison operator, on the test tables.

Operators that take a score or a weight get one computed from the table, so that their
arithmetic is checked apart from the model. Doubles are rounded to 6 digits, as sums run in
another order in every engine.
"""

import dataclasses
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasewise import names as N
from phasewise.operators import outcomes, populations, propensity, table_one
from phasewise.plans import comparison
from phasewise.sources import trial

# Checked together: the group share is the exact fit of a model with one category.
ONE_CATEGORY = ([], ["race_ethnicity"])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(F.col(c), 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])


def _given_score(df: DataFrame) -> DataFrame:
    return df.withColumn(propensity.SCORE, (F.col(N.OBSERVED_BEFORE) + 100) / 1100)


def _population(a: DataFrame) -> DataFrame:
    return populations.population_vs_untreated(a)


def _weighted(a: DataFrame) -> DataFrame:
    return propensity.ip_weights(_given_score(_population(a)), N.TREATMENT)


def _fitted(a: DataFrame) -> DataFrame:
    return propensity.propensity(_population(a), N.TREATMENT, *ONE_CATEGORY).select(N.PERSON, propensity.SCORE)


def _weighted_population(a: DataFrame) -> DataFrame:
    weighted = propensity.weighted_population(_population(a), N.TREATMENT, *ONE_CATEGORY)
    return weighted.select(N.PERSON, propensity.SCORE, "iptw", "wt_stab", "ipw")


def _trimmed(a: DataFrame) -> DataFrame:
    return propensity.trim_by_quantile(_given_score(_population(a))).select(N.PERSON, propensity.SCORE)


def _tests(a: DataFrame) -> DataFrame:
    return table_one.group_tests(_population(a), N.TREATMENT, N.TABLE_NUMERIC, N.TABLE_CATEGORICAL)


def _tests_weighted(a: DataFrame) -> DataFrame:
    return table_one.group_tests_weighted(
        _weighted(a), N.TREATMENT, N.TABLE_NUMERIC, N.TABLE_CATEGORICAL, "ipw"
    )


def _smd(weight: str | None, a: DataFrame) -> DataFrame:
    return table_one.smd(_weighted(a), N.TREATMENT, N.TABLE_NUMERIC, N.TABLE_CATEGORICAL, weight)


def _odds(weight: str | None, a: DataFrame) -> DataFrame:
    return outcomes.odds_ratios(_weighted(a), N.TREATMENT, [*N.OUTCOMES, N.LONG_TERM_OUTCOME], weight)


def _adjusted(a: DataFrame) -> DataFrame:
    return comparison.outcomes_adjusted(_weighted(a), comparison.VS_UNTREATED)


def _outcome_table(a: DataFrame) -> DataFrame:
    return comparison.outcome_table(_weighted(a), comparison.VS_UNTREATED)


def _whole(chosen: comparison.Comparison, a: DataFrame) -> DataFrame:
    weighted = comparison.weighted(a, chosen)
    return weighted.select(
        N.PERSON, chosen.weight_treatment, propensity.SCORE, "iptw", "wt_stab", "ipw"
    )


def _whole_outcomes(chosen: comparison.Comparison, a: DataFrame) -> DataFrame:
    return comparison.outcome_table(comparison.weighted(a, chosen), chosen)


_BUILDERS = {
    "population_vs_untreated": _population,
    "population_active_comparator": populations.population_active_comparator,
    "population_followup": populations.population_followup,
    "propensity": _fitted,
    "ip_weights": lambda a: _weighted(a).select(N.PERSON, "iptw", "wt_stab", "ipw"),
    "trim_by_quantile": _trimmed,
    "weighted_population": _weighted_population,
    "overlap_histogram": lambda a: propensity.overlap_histogram(_weighted(a), N.TREATMENT),
    "table_one": lambda a: comparison.description(_population(a)),
    "table_one_weighted": lambda a: comparison.description(_weighted(a), weight="ipw"),
    "smd": partial(_smd, None),
    "smd_weighted": partial(_smd, "ipw"),
    "group_tests": lambda a: _tests(a).drop("p"),
    "group_test_p_values": lambda a: _tests(a).select("variable", "p"),
    "group_tests_weighted": lambda a: _tests_weighted(a).drop("p"),
    "group_test_p_values_weighted": lambda a: _tests_weighted(a).select("variable", "p"),
    "balance": lambda a: comparison.balance(_weighted(a)),
    "odds_ratio_unweighted": partial(_odds, None),
    "odds_ratio_weighted": partial(_odds, "ipw"),
    "odds_ratio_adjusted": _adjusted,
    "outcome_table": _outcome_table,
    **{f"weights_{c.name}": partial(_whole, c) for c in comparison.COMPARISONS},
    **{f"outcomes_{c.name}": partial(_whole_outcomes, c) for c in comparison.COMPARISONS},
}


# The comparisons with a score from one category: group shares, which SQL can follow to the end.
ONE_CATEGORY_COMPARISONS = [
    dataclasses.replace(c, numeric=(), categorical=("race_ethnicity",)) for c in comparison.COMPARISONS
]
WITHOUT_P = ("tests", "tests_weighted")


def _compared(table: str, chosen: comparison.Comparison, a: DataFrame) -> DataFrame:
    found = getattr(comparison.compare(a, chosen), table)()
    return found.drop("p") if table in WITHOUT_P else found


def _fit_reports(a: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        comparison.compare(a, c).fit.select(F.lit(c.name).alias("comparison"), "*") for c in comparison.COMPARISONS])


_BUILDERS |= {
    **{f"weights_{c.name}_by_group": partial(_whole, c) for c in ONE_CATEGORY_COMPARISONS},
    **{f"outcomes_{c.name}_by_group": partial(_whole_outcomes, c) for c in ONE_CATEGORY_COMPARISONS},
    **{f"comparison_{t}": partial(_compared, t, ONE_CATEGORY_COMPARISONS[1]) for t in comparison.TABLES},
    "fit_reports": lambda a: _fit_reports(a).drop("iterations"),
}


def _query(build, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build(trial.analysis_table(spark, sf_dir)))


def queries():
    return {key: partial(_query, build) for key, build in _BUILDERS.items()}
