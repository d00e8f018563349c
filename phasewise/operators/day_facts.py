"""One row per person and day, with everything known about the day."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from phasewise.functions import flags
from phasewise.functions.dates import days_between
from phasewise.names import (
    BMI, DATE, DEATH, DEATH_IN_WINDOW, DEATH_WINDOW_DAYS, FIRST_DX, FIRST_LAB, IN_ANY_STAY,
    IN_STRONG_STAY, IN_WEAK_STAY, INDEX, ON_STRONG_ED, ON_WEAK_ED, PERSON, POST, PRE,
    REINFECTION, REINFECTION_WAIT_DAYS, STAY_END, STAY_START, STRONG_ED, STRONG_END,
    STRONG_START, WEAK_ED, WEAK_END, WEAK_START,
)

POSITIVE = "PCR_AG_Pos"
SPAN = ["span_start", "span_end"]


def day_facts_merge(frames: list[DataFrame], indicators: list[str], values: list[str] = [BMI]) -> DataFrame:
    """Merge (person, date, ...) tables to one row per person and day.

    ``indicators`` are 0/1 columns: 1 if any table says so, else 0. ``values`` keep their
    maximum, null if there is none. A union and one aggregate in place of one full outer
    join per table; the indicators travel as bit words.
    """
    def narrow(frame: DataFrame) -> DataFrame:
        known = {c: F.col(f"`{c}`") for c in frame.columns if c in indicators}
        kept = [F.col(v) if v in frame.columns else F.lit(None).cast("double").alias(v) for v in values]
        return frame.select(PERSON, DATE, *flags.words(known, indicators), *kept)

    merged = (
        reduce(DataFrame.unionByName, map(narrow, frames))
        .groupBy(PERSON, DATE)
        .agg(*flags.merged(indicators), *[F.max(v).alias(v) for v in values])
    )
    return merged.select(PERSON, DATE, *flags.unpacked(indicators), *values)


def attach_person_dates(facts: DataFrame, cohort: DataFrame, linked: DataFrame) -> DataFrame:
    """Cohort persons with their index dates, linked visits and day rows.

    A person without facts keeps one row with a null date. ``linked`` holds cohort persons
    only, so every join is a left join and keeps the partitioning by person.
    """
    persons = cohort.groupBy(PERSON).agg(*[F.min(d).alias(d) for d in (FIRST_LAB, FIRST_DX, INDEX)])
    return persons.join(linked, PERSON, "left").join(facts, PERSON, "left")


def _since_index() -> Column:
    return days_between(DATE, INDEX)


def first_reinfection(facts: DataFrame, wait_days: int = REINFECTION_WAIT_DAYS) -> DataFrame:
    """Flag the first positive test day more than ``wait_days`` after the index date."""
    again = F.when((F.col(POSITIVE) == 1) & (_since_index() > wait_days), F.col(DATE))
    first = F.min(again).over(Window.partitionBy(PERSON))
    return facts.withColumn("_first", first).select(
        *facts.columns, F.when(F.col(DATE) == F.col("_first"), 1).otherwise(0).alias(REINFECTION)
    )


def death_in_window(facts: DataFrame, days: int = DEATH_WINDOW_DAYS) -> DataFrame:
    """Flag a death day 1 to ``days`` days after the index date."""
    return facts.withColumn(
        DEATH_IN_WINDOW,
        F.when((F.col(DEATH) == 1) & _since_index().between(1, days), 1).otherwise(0),
    )


def phase_flags(facts: DataFrame) -> DataFrame:
    """Up to and including the index date, or after it; neither without a date."""
    return facts.withColumns({
        PRE: F.when(_since_index() <= 0, 1).otherwise(0),
        POST: F.when(_since_index() > 0, 1).otherwise(0),
    })


def stay_flags(facts: DataFrame) -> DataFrame:
    """Day inside the first strong or weak stay, or on the first strong or weak emergency day."""
    def flagged(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    day = F.col(DATE)
    return facts.withColumns({
        IN_STRONG_STAY: flagged(day.between(F.col(STRONG_START), F.col(STRONG_END))),
        ON_STRONG_ED: flagged(day == F.col(STRONG_ED)),
        IN_WEAK_STAY: flagged(day.between(F.col(WEAK_START), F.col(WEAK_END))),
        ON_WEAK_ED: flagged(day == F.col(WEAK_ED)),
    })


def stay_spans(visits: DataFrame) -> DataFrame:
    """Each person's stay days cut into disjoint spans, one stay per span.

    Every day inside any stay lies in exactly one span, and the span names the stay that
    starts first among those covering the day (the longest of them on a tie). A span starts
    where its stay starts or where earlier stays have ended, whichever is later. Per person
    there are at most as many rows as distinct start dates.
    """
    stays = (
        visits.where(F.col(STAY_START).isNotNull() & F.col(STAY_END).isNotNull())
        .groupBy(PERSON, STAY_START)
        .agg(F.max(STAY_END).alias(STAY_END))
    )
    earlier = Window.partitionBy(PERSON).orderBy(STAY_START).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(STAY_END).over(earlier)
    return (
        stays.where(F.col(STAY_END) >= F.col(STAY_START))
        .withColumn("reach", reach)
        .where(F.col("reach").isNull() | (F.col(STAY_END) > F.col("reach")))
        .select(
            PERSON,
            F.greatest(F.col(STAY_START), F.date_add("reach", 1)).alias(DATE),
            F.col(STAY_START).alias("span_start"),
            F.col(STAY_END).alias("span_end"),
        )
    )


def latest_span(order: WindowSpec) -> dict[str, Column]:
    """Start and end of the last span begun up to the row, as ``span_start`` and ``span_end``."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {c: F.last(c, ignorenulls=True).over(so_far) for c in SPAN}


def covering() -> tuple[Column, Column, Column]:
    """Flag and dates of the stay covering the row's day, from the last span begun by then."""
    covered = F.col(DATE) <= F.col("span_end")
    return (
        F.when(covered, 1).otherwise(0).alias(IN_ANY_STAY),
        F.when(covered, F.col("span_start")).alias(STAY_START),
        F.when(covered, F.col("span_end")).alias(STAY_END),
    )


def during_any_stay(facts: DataFrame, visits: DataFrame, with_dates: bool = True) -> DataFrame:
    """Flag days inside any stay of the person, optionally with the covering stay's dates.

    Days and spans go through one window per person, in which the last span begun decides:
    no day is ever paired with all the stays of its person.
    """
    rows = facts.withColumn("is_fact", F.lit(True)).unionByName(
        stay_spans(visits), allowMissingColumns=True
    )
    ordered = Window.partitionBy(PERSON).orderBy(F.col(DATE), F.col("is_fact").asc_nulls_first())
    stay = covering()
    return (
        rows.withColumns(latest_span(ordered))
        .where(F.col("is_fact"))
        .select(*facts.columns, *(stay if with_dates else stay[:1]))
    )
