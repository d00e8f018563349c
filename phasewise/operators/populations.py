"""Who is compared with whom."""

from pyspark.sql import DataFrame, functions as F

from phasewise.names import FOLLOWED_UP, OTHER_TREATMENT, PRIOR_STAY, TREATMENT


def population_vs_untreated(
    df: DataFrame, other: str = OTHER_TREATMENT, prior_stay: str = PRIOR_STAY
) -> DataFrame:
    """Without the other treatment and without an earlier hospital stay."""
    return df.where((F.col(other) == 0) & (F.col(prior_stay) == 0))


def population_active_comparator(
    df: DataFrame, treat: str = TREATMENT, other: str = OTHER_TREATMENT, prior_stay: str = PRIOR_STAY
) -> DataFrame:
    """Exactly one of the two treatments, and no earlier hospital stay."""
    return df.where((F.col(treat) + F.col(other) == 1) & (F.col(prior_stay) == 0))


def population_followup(df: DataFrame, followed: str = FOLLOWED_UP) -> DataFrame:
    return df.where(F.col(followed) == 1)
