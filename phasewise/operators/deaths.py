"""Signs of death from the registry and from visit discharges: one row per person."""

from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions.dates import mask, plausible
from phasewise.names import CONCEPT, DATE, DEATH, EXTRACTION, FLOOR_DATE, HORIZON_DAYS, PERSON

DEATH_DATE = "death_date"
DISCHARGE = "discharge_to_concept_id"


def _signs(
    death: DataFrame, visits: DataFrame, cohort: DataFrame, roles: DataFrame
) -> DataFrame:
    """Registry rows and death or hospice discharges of cohort persons, in one shape.

    Collapsed to distinct rows before the join: what remains of a person is bounded by its
    distinct dates.
    """
    none = F.lit(None).cast("date")
    ends = roles.where(F.col("deceased") | F.col("hospice")).select(
        F.col(CONCEPT).alias(DISCHARGE), "deceased"
    )
    registry = death.select(
        PERSON, F.col(DEATH_DATE).alias("registered"),
        none.alias("visit_start"), none.alias("visit_end"), F.lit(False).alias("deceased"),
    )
    discharges = visits.join(ends, DISCHARGE).select(
        PERSON, none.alias("registered"),
        mask(F.col("deceased"), "visit_start_date").alias("visit_start"),
        mask(F.col("deceased"), "visit_end_date").alias("visit_end"),
        "deceased",
    )
    return (
        registry.unionByName(discharges)
        .distinct()
        .join(cohort.select(PERSON, EXTRACTION), PERSON)
    )


def _death_date(floor: str, horizon_days: int) -> Column:
    def ok(column: str) -> Column:
        return plausible(column, EXTRACTION, floor, horizon_days)

    registered = F.min(mask(ok("registered"), "registered"))
    discharged = F.max(
        F.when(ok("visit_end"), F.col("visit_end")).when(ok("visit_start"), F.col("visit_start"))
    )
    return F.coalesce(registered, discharged)


def death_flags(
    death: DataFrame,
    visits: DataFrame,
    cohort: DataFrame,
    roles: DataFrame,
    floor: str = FLOOR_DATE,
    horizon_days: int = HORIZON_DAYS,
) -> DataFrame:
    """(person, date or null, 1) for every cohort person with any sign of death.

    The earliest plausible registry date wins; otherwise the latest plausible date of a
    visit discharged as deceased. A hospice discharge gives the flag and no date. ``roles``
    tells deceased and hospice concepts (``concept_roles``).
    """
    return (
        _signs(death, visits, cohort, roles)
        .groupBy(PERSON)
        .agg(_death_date(floor, horizon_days).alias(DATE))
        .select(PERSON, DATE, F.lit(1).alias(DEATH))
    )


def death_dates(
    death: DataFrame,
    visits: DataFrame,
    cohort: DataFrame,
    roles: DataFrame,
    floor: str = FLOOR_DATE,
    horizon_days: int = HORIZON_DAYS,
) -> DataFrame:
    """Persons of ``death_flags`` that have a date."""
    flagged = death_flags(death, visits, cohort, roles, floor, horizon_days)
    return flagged.where(F.col(DATE).isNotNull()).select(PERSON, DATE)
