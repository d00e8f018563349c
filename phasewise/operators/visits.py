"""Visits: counts around the index date, and visits linked to it by day windows.

Micro-visits have a ``visit_start_date``; those inside a hospital stay also carry the
stay's interval (``macrovisit_start_date``, ``macrovisit_end_date``).

Raw visit rows are collapsed before they meet the cohort. The collapse is combined on the
map side and leaves at most one row per person and distinct date (or interval), so a person
with a third of all visits is an ordinary key by the time of the join.
"""

from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions.dates import days_between, mask, within
from phasewise.names import (
    CONCEPT, FIRST_DX, FIRST_LAB, INDEX, LINK_DAYS, OBSERVED_BEFORE, OBSERVED_POST, PERSON,
    STAY_END, STAY_START, STRONG_ED, STRONG_END, STRONG_START, VISITS_BEFORE, VISITS_POST,
    WEAK_ED, WEAK_ED_DAYS, WEAK_END, WEAK_START,
)

VISIT_START = "visit_start_date"
# What visits are compared with.
INDEX_COLUMNS = [FIRST_LAB, FIRST_DX, INDEX]


def visit_dedup(visits: DataFrame) -> DataFrame:
    """One row per person and stay (its earliest visit date), or per person and day outside stays."""
    outside = F.when(F.col(STAY_START).isNull(), F.col(VISIT_START))
    return (
        visits.groupBy(PERSON, STAY_START, outside.alias("day"))
        .agg(F.min(VISIT_START).alias(VISIT_START))
        .select(PERSON, STAY_START, VISIT_START)
    )


def _around_index(visits: DataFrame, cohort: DataFrame) -> DataFrame:
    lead = days_between(INDEX, VISIT_START)
    return visits.join(cohort.select(PERSON, INDEX), PERSON).select(PERSON, VISIT_START, lead.alias("lead"))


def _counts() -> list[Column]:
    lead = F.col("lead")
    return [
        F.nullif(F.count_if(lead > 0), F.lit(0)).alias(VISITS_BEFORE),
        F.nullif(F.count_if(lead < 0), F.lit(0)).alias(VISITS_POST),
    ]


def _periods() -> list[Column]:
    def span(side: Column) -> Column:
        day = mask(side, VISIT_START)
        return days_between(F.max(day), F.min(day))

    lead = F.col("lead")
    return [span(lead >= 0).alias(OBSERVED_BEFORE), span(lead <= 0).alias(OBSERVED_POST)]


def visit_counts(visits: DataFrame, cohort: DataFrame) -> DataFrame:
    """Visits strictly before and strictly after the index date; null when there are none."""
    return _around_index(visits, cohort).groupBy(PERSON).agg(*_counts())


def observation_periods(visits: DataFrame, cohort: DataFrame) -> DataFrame:
    """Days from first to last visit up to and from the index date; the index day is in both."""
    return _around_index(visits, cohort).groupBy(PERSON).agg(*_periods())


def visit_measures(visits: DataFrame, cohort: DataFrame) -> DataFrame:
    """Counts and periods in one pass."""
    return _around_index(visits, cohort).groupBy(PERSON).agg(*_counts(), *_periods())


def candidate_visits(visits: DataFrame, ed_ids: DataFrame) -> DataFrame:
    """Distinct emergency visit days and distinct stays, as (person, ed_date, start, end).

    An emergency visit has no stay and a concept of the emergency set. Other visits collapse
    to one row of nulls, which keeps the person known to have visits.
    """
    ed = ed_ids.select(F.col(CONCEPT).alias("visit_concept_id"), F.lit(True).alias("is_ed"))
    in_stay = F.col(STAY_START).isNotNull()
    return (
        visits.join(ed, "visit_concept_id", "left")
        .select(
            PERSON,
            mask(~in_stay & F.col("is_ed"), VISIT_START).alias("ed_date"),
            STAY_START,
            mask(in_stay, STAY_END).alias(STAY_END),
        )
        .distinct()
    )


def _strong(start: str, mode: str, link_days: tuple[int, int]) -> Column:
    """Is the visit starting at ``start`` linked to the index event?

    ``and``: lab inside the window of the visit and of the diagnosis. ``or``: earlier of
    lab and diagnosis inside the window of the visit.
    """
    if mode == "and":
        return within(days_between(FIRST_LAB, start), link_days) & within(
            days_between(FIRST_LAB, FIRST_DX), link_days
        )
    if mode == "or":
        return within(days_between(INDEX, start), link_days)
    raise ValueError(f"mode must be 'and' or 'or', not {mode!r}")


def _weak_ed() -> Column:
    return within(days_between(FIRST_LAB, "ed_date"), WEAK_ED_DAYS) | within(
        days_between(FIRST_DX, "ed_date"), WEAK_ED_DAYS
    )


def _weak_stay() -> Column:
    return F.col(FIRST_DX).between(F.col(STAY_START), F.col(STAY_END)) | F.col(FIRST_LAB).between(
        F.col(STAY_START), F.col(STAY_END)
    )


def _with_index(candidates: DataFrame, cohort: DataFrame) -> DataFrame:
    return candidates.join(cohort.select(PERSON, FIRST_LAB, FIRST_DX, INDEX), PERSON)


def visit_link(
    candidates: DataFrame,
    cohort: DataFrame,
    kind: str = "ed",
    strength: str = "strong",
    mode: str = "and",
    link_days: tuple[int, int] = LINK_DAYS,
) -> DataFrame:
    """Linked emergency visits (person, ed_date) or stays (person, start, end)."""
    start = "ed_date" if kind == "ed" else STAY_START
    if strength == "strong":
        linked = _strong(start, mode, link_days)
    else:
        linked = _weak_ed() if kind == "ed" else _weak_stay()
    columns = [PERSON, "ed_date"] if kind == "ed" else [PERSON, STAY_START, STAY_END]
    rows = candidates.where(F.col(start).isNotNull())
    return _with_index(rows, cohort).where(linked).select(*columns)


def first_linked_visits(
    visits: DataFrame,
    cohort: DataFrame,
    ed_ids: DataFrame,
    mode: str = "and",
    link_days: tuple[int, int] = LINK_DAYS,
    paired: bool = False,
) -> DataFrame:
    """Six first dates per cohort person with any visit; null where nothing is linked.

    Start and end of the first stay are the minima of all linked stays and may come from
    two of them; ``paired=True`` takes the end of the stay that starts first.
    """
    strong_ed = _strong("ed_date", mode, link_days)
    strong_stay = _strong(STAY_START, mode, link_days)
    weak_stay = _weak_stay()

    def first_end(linked: Column) -> Column:
        if paired:
            return F.min(mask(linked, F.struct(STAY_START, STAY_END)))[STAY_END]
        return F.min(mask(linked, STAY_END))

    return (
        _with_index(candidate_visits(visits, ed_ids), cohort)
        .groupBy(PERSON)
        .agg(
            F.min(mask(strong_ed, "ed_date")).alias(STRONG_ED),
            F.min(mask(strong_stay, STAY_START)).alias(STRONG_START),
            first_end(strong_stay).alias(STRONG_END),
            F.min(mask(_weak_ed(), "ed_date")).alias(WEAK_ED),
            F.min(mask(weak_stay, STAY_START)).alias(WEAK_START),
            first_end(weak_stay).alias(WEAK_END),
        )
    )
