"""Event domains to day-level indicators: codes, labs, body mass, doses."""

from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions import flags
from phasewise.functions.dates import mask
from phasewise.functions.sizing import bounded
from phasewise.names import (
    BMI, BMI_RANGE, CONCEPT, DATE, DOSE, DOSE_DATES, HEIGHT_M_RANGE, LAB_FLAGS, OBESE_BMI,
    OBESITY, PERSON, WEIGHT_KG_RANGE,
)
from phasewise.operators.codesets import indicator_words
from phasewise.operators.index_event import RESULT
from phasewise.operators.intake import cohort_ids, early_cohort_filter, in_cohort

VALUE = "harmonized_value_as_number"
BODY_PARTS = ["recorded_bmi", "height", "weight"]
BODY_LIMITS = {
    "recorded_bmi": BMI_RANGE,
    "height": HEIGHT_M_RANGE,
    "weight": WEIGHT_KG_RANGE,
}


def indicator_rows(events: DataFrame, words: DataFrame, indicators: list[str]) -> DataFrame:
    """Events of the mapped concepts as (person, date, indicator words).

    ``words`` has one row per concept, or per domain and concept if the events of several
    domains come together.
    """
    keys = [c for c in ("domain", CONCEPT) if c in words.columns]
    return events.join(words, keys).select(PERSON, DATE, *flags.word_names(indicators))


def indicator_pivot(
    events: DataFrame, cohort: DataFrame, pairs: DataFrame, indicators: list[str]
) -> DataFrame:
    """One row per cohort person and day with a 0/1 column per indicator.

    The columns are the given list, so an indicator without events is an all-0 column (C16).
    """
    near = early_cohort_filter(events, cohort_ids(cohort))
    rows = indicator_rows(near, bounded(indicator_words(pairs, indicators)), indicators)
    days = rows.groupBy(PERSON, DATE).agg(*flags.merged(indicators))
    return days.select(PERSON, DATE, *flags.unpacked(indicators))


# --- measurements ---------------------------------------------------------------


TEST_ROLES = ["pcr_ag", "antibody", "bmi", "height", "weight"]
RESULT_ROLES = ["positive_result", "negative_result"]


def tagged_measurements(meas: DataFrame, roles: DataFrame) -> DataFrame:
    """Measurements with a boolean column per role of their test and of their result.

    ``roles`` comes from ``concept_roles``.
    """
    tests = roles.select(CONCEPT, *TEST_ROLES)
    results = roles.select(F.col(CONCEPT).alias(RESULT), *RESULT_ROLES)
    return meas.join(tests, CONCEPT, "left").join(results, RESULT, "left")


def lab_columns() -> dict[str, Column]:
    """0/1 per lab flag: test of the set with a result of the set."""

    def lab(test: str, result: str) -> Column:
        return (F.coalesce(F.col(test) & F.col(result), F.lit(False))).cast("int")

    pcr_pos, pcr_neg, ab_pos, ab_neg = LAB_FLAGS
    return {
        pcr_pos: lab("pcr_ag", "positive_result"),
        pcr_neg: lab("pcr_ag", "negative_result"),
        ab_pos: lab("antibody", "positive_result"),
        ab_neg: lab("antibody", "negative_result"),
    }


def body_columns(limits: dict[str, tuple[float, float]] = BODY_LIMITS) -> list[Column]:
    """Value of each body measure where in range, 0 where not, null without a value."""
    roles = {"recorded_bmi": "bmi", "height": "height", "weight": "weight"}
    return [
        mask(
            F.col(VALUE).isNotNull(),
            F.when(F.col(roles[part]) & F.col(VALUE).between(*limits[part]), F.col(VALUE)).otherwise(0.0),
        ).alias(f"{part}_value")
        for part in BODY_PARTS
    ]


def merged_body() -> list[Column]:
    return [F.max(f"{part}_value").alias(f"{part}_value") for part in BODY_PARTS]


def bmi_columns(limits: tuple[float, float] = BMI_RANGE) -> tuple[Column, Column]:
    """Rounded BMI of a day and its obesity flag, from the day's largest body values.

    A recorded BMI wins over weight / height²; without a height there is none. Days whose
    BMI is out of range have both columns null.
    """
    recorded, height, weight = (F.col(f"{part}_value") for part in BODY_PARTS)
    best = F.when(recorded > 0, recorded).otherwise(F.try_divide(weight, height * height))
    rounded = mask(best.between(*limits), F.round(best))
    obese = mask(rounded.isNotNull(), F.when(rounded >= OBESE_BMI, 1).otherwise(0))
    return rounded.alias(BMI), obese.alias(OBESITY)


def lab_flags(tagged: DataFrame) -> DataFrame:
    """Four lab flags per person and day; a day with any measurement is kept."""
    labs = tagged.select(PERSON, DATE, *flags.words(lab_columns(), LAB_FLAGS))
    days = labs.groupBy(PERSON, DATE).agg(*flags.merged(LAB_FLAGS))
    return days.select(PERSON, DATE, *flags.unpacked(LAB_FLAGS))


def best_bmi(tagged: DataFrame, limits: dict[str, tuple[float, float]] = BODY_LIMITS) -> DataFrame:
    """Rounded BMI and obesity flag for days that have a BMI in range."""
    days = tagged.select(PERSON, DATE, *body_columns(limits)).groupBy(PERSON, DATE).agg(*merged_body())
    return days.select(PERSON, DATE, *bmi_columns(limits["recorded_bmi"])).where(F.col(BMI).isNotNull())


def measurements(tagged: DataFrame, limits: dict[str, tuple[float, float]] = BODY_LIMITS) -> DataFrame:
    """Lab flags and BMI of each day in one aggregate."""
    days = (
        tagged.select(PERSON, DATE, *flags.words(lab_columns(), LAB_FLAGS), *body_columns(limits))
        .groupBy(PERSON, DATE)
        .agg(*flags.merged(LAB_FLAGS), *merged_body())
    )
    return days.select(
        PERSON, DATE, *flags.unpacked(LAB_FLAGS), *bmi_columns(limits["recorded_bmi"])
    )


# --- doses ------------------------------------------------------------------------


def dose_rows(doses: DataFrame, columns: list[str] = DOSE_DATES) -> DataFrame:
    """Wide dose dates as (person, date) rows."""
    return (
        doses.select(PERSON, *[F.col(f"`{c}`") for c in columns])
        .unpivot(PERSON, [F.col(f"`{c}`") for c in columns], "dose", DATE)
        .where(F.col(DATE).isNotNull())
        .select(PERSON, DATE)
    )


def dose_dates(doses: DataFrame, cohort: DataFrame, columns: list[str] = DOSE_DATES) -> DataFrame:
    """Distinct dose days of cohort persons, flag 1. Doses on one day count once (C11)."""
    days = dose_rows(doses, columns).distinct()
    return in_cohort(days, cohort).select(PERSON, DATE, F.lit(1).alias(DOSE))
