"""The index event: first positive test or first diagnosis, whichever is earlier."""

from pyspark.sql import DataFrame, functions as F

from phasewise.names import CONCEPT, DATE, FIRST_DX, FIRST_LAB, INDEX, PERSON

RESULT = "value_as_concept_id"


def with_concept(rows: DataFrame, ids: DataFrame, column: str = CONCEPT) -> DataFrame:
    """Rows whose ``column`` is one of the concept ids."""
    return rows.join(ids.select(F.col(CONCEPT).alias(column)), column, "left_semi")


def positive_test_rows(meas: DataFrame, test_ids: DataFrame, result_ids: DataFrame) -> DataFrame:
    return with_concept(with_concept(meas, test_ids), result_ids, RESULT)


def positive_tests(meas: DataFrame, test_ids: DataFrame, result_ids: DataFrame) -> DataFrame:
    """Days with a test of the test set whose result is in the result set."""
    return positive_test_rows(meas, test_ids, result_ids).select(PERSON, DATE).distinct()


def first_event_date(rows: DataFrame, alias: str) -> DataFrame:
    """Earliest date per person."""
    return rows.groupBy(PERSON).agg(F.min(DATE).alias(alias))


def index_date(lab_rows: DataFrame, dx_rows: DataFrame) -> DataFrame:
    """First lab date, first diagnosis date and the earlier of them, per person.

    Takes the qualifying rows themselves: both kinds go through one aggregate, so there is
    one shuffle of at most one row per person, kind and task, and no outer join.
    """
    none = F.lit(None).cast("date")
    lab = lab_rows.select(PERSON, F.col(DATE).alias(FIRST_LAB), none.alias(FIRST_DX))
    dx = dx_rows.select(PERSON, none.alias(FIRST_LAB), F.col(DATE).alias(FIRST_DX))
    return (
        lab.unionByName(dx)
        .groupBy(PERSON)
        .agg(F.min(FIRST_LAB).alias(FIRST_LAB), F.min(FIRST_DX).alias(FIRST_DX))
        .withColumn(INDEX, F.least(FIRST_LAB, FIRST_DX))
    )
