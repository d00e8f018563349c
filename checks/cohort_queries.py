"""One Spark query per cohort-side operator, on the test tables."""

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasewise import names as N
from phasewise.functions.lineage import shared_folder
from phasewise.operators import (
    codesets, day_facts, deaths, demographics, domains, index_event, intake, summary, visits,
)
from phasewise.plans import person_flow
from phasewise.plans.codes import StudyCodes, resolve_codes
from phasewise.sources import trial
from phasewise.sources.tables import StudyTables

SETS, WINDOWS = trial.SETS, trial.WINDOWS
Query = Callable[[SparkSession, str], DataFrame]


def _sheet(t: StudyTables) -> DataFrame:
    return codesets.merge_sheets(t.required_sheet, t.custom_sheet)


def _codes(t: StudyTables) -> StudyCodes:
    return resolve_codes(t, SETS)


def _persons(t: StudyTables, codes: StudyCodes | None = None) -> DataFrame:
    return person_flow.index_persons(t, codes or _codes(t), WINDOWS)


def _index_dates(t: StudyTables) -> DataFrame:
    return index_event.index_date(_labs(t), _diagnoses(t))


def _ids(t: StudyTables, *names: str) -> DataFrame:
    return codesets.concept_ids(t.concept_sets, list(names))


def _labs(t: StudyTables) -> DataFrame:
    return index_event.positive_tests(
        person_flow.measurement_events(t), _ids(t, SETS.pcr_ag_tests), _ids(t, SETS.positive_results)
    )


def _diagnoses(t: StudyTables) -> DataFrame:
    return index_event.with_concept(person_flow.domain_events(t, "condition"), _ids(t, SETS.diagnosis))


# --- intake and code sets -------------------------------------------------------


def occurrence_intake(t):
    return intake.occurrence_intake(
        t.condition_occurrence, _index_dates(t), "condition_start_date", "condition_concept_id"
    )


def concept_indicator_map(t):
    return codesets.concept_indicator_map(t.concept_sets, _sheet(t), "condition")


# --- cohort ---------------------------------------------------------------------


def date_of_birth(t):
    shift = intake.normalize_shift_days(t.manifest).agg(F.max("shift_days")).scalar()
    people = demographics.date_of_birth(intake.person_sample(t.person), WINDOWS.as_of, shift)
    return people.select(N.PERSON, "date_of_birth")


def age_at_index(t):
    people = demographics.date_of_birth(intake.person_sample(t.person), WINDOWS.as_of, 0)
    return demographics.age_at_index(people.join(_index_dates(t), N.PERSON)).select(N.PERSON, "age_at_covid")


def category_map(t):
    people = intake.person_sample(t.person)
    return demographics.race_ethnicity(demographics.race(people)).select(N.PERSON, "race", "race_ethnicity")


def normalize_shift_days(t):
    return intake.normalize_shift_days(t.manifest).select(N.PARTNER, "max_num_shift_days", "shift_days")


def plausible_dates(t):
    return intake.plausible_dates(
        t.visits, intake.source_manifest(t.manifest), visits.VISIT_START, WINDOWS.floor,
        WINDOWS.horizon_days,
    )


def _counted(t: StudyTables) -> DataFrame:
    return person_flow.counted_visits(t, intake.source_manifest(t.manifest), WINDOWS)


def visit_counts(t):
    return visits.visit_counts(_counted(t), _index_dates(t))


def observation_periods(t):
    return visits.observation_periods(_counted(t), _index_dates(t))


def cohort(t):
    codes = _codes(t)
    return person_flow.build_cohort(t, _persons(t, codes), codes.sources, WINDOWS)


# --- linked visits ----------------------------------------------------------------


def _linked(t: StudyTables, kind: str, strength: str, mode: str = "and") -> DataFrame:
    candidates = visits.candidate_visits(t.visits, _ids(t, SETS.ed_visits))
    return visits.visit_link(candidates, _index_dates(t), kind, strength, mode, WINDOWS.link_days)


def visits_strong_or_mode(t):
    return _linked(t, "ed", "strong", "or").unionByName(
        _linked(t, "stay", "strong", "or"), allowMissingColumns=True
    )


def first_linked_visits(t):
    codes = _codes(t)
    return person_flow.linked_visits(t, _persons(t, codes), codes, WINDOWS)


# --- domains ----------------------------------------------------------------------


def _pivot(domain: str, t: StudyTables) -> DataFrame:
    codes = _codes(t)
    return person_flow.domain_table(t, _persons(t, codes), codes, domain)


def _of_tagged(operator: Callable[[DataFrame], DataFrame], t: StudyTables) -> DataFrame:
    codes = _codes(t)
    persons = _persons(t, codes)
    events = intake.early_cohort_filter(person_flow.measurement_events(t), intake.cohort_ids(persons))
    return intake.in_cohort(operator(domains.tagged_measurements(events, codes.roles)), persons)


def measurements(t):
    codes = _codes(t)
    return person_flow.measurement_table(t, _persons(t, codes), codes)


def dose_dates(t):
    return domains.dose_dates(t.vaccine_doses, _index_dates(t), list(WINDOWS.dose_columns))


def _of_deaths(operator: Callable[..., DataFrame], t: StudyTables) -> DataFrame:
    codes = _codes(t)
    return operator(
        t.death, t.visits, _persons(t, codes), codes.roles, WINDOWS.floor, WINDOWS.horizon_days
    )


# --- day facts --------------------------------------------------------------------


def _plausible_death_days(t: StudyTables, persons: DataFrame, codes: StudyCodes) -> DataFrame:
    deaths_found = person_flow.death_table(t, persons, codes, WINDOWS)
    return person_flow.plausible_death_days(deaths_found, persons, WINDOWS)


def day_facts_merge(t):
    """From the separate domain tables, each already one row per person and day."""
    codes = _codes(t)
    persons = _persons(t, codes)
    frames = [
        intake.in_cohort(t.visits.select(N.PERSON, F.col(visits.VISIT_START).alias(N.DATE)), persons),
        domains.dose_dates(t.vaccine_doses, persons, list(WINDOWS.dose_columns)),
        person_flow.measurement_table(t, persons, codes),
        _plausible_death_days(t, persons, codes).withColumn(N.DEATH, F.lit(1)),
        *[person_flow.domain_table(t, persons, codes, d) for d in N.DOMAINS],
    ]
    return day_facts.day_facts_merge(frames, [*codes.indicators, N.OBESITY])


def _attached(t: StudyTables) -> DataFrame:
    codes = _codes(t)
    persons = _persons(t, codes)
    days = person_flow.fact_days(t, persons, codes, _plausible_death_days(t, persons, codes), WINDOWS)
    linked = person_flow.linked_visits(t, persons, codes, WINDOWS)
    return day_facts.attach_person_dates(
        days.drop(N.IN_ANY_STAY, N.STAY_START, N.STAY_END), persons, linked
    )


def first_reinfection(t):
    flagged = day_facts.first_reinfection(_attached(t), WINDOWS.reinfection_wait)
    return flagged.select(N.PERSON, N.DATE, N.INDEX, N.REINFECTION)


def death_in_window(t):
    flagged = day_facts.death_in_window(_attached(t), WINDOWS.death_window)
    return flagged.select(N.PERSON, N.DATE, N.DEATH_IN_WINDOW)


def phase_flags(t):
    return day_facts.phase_flags(_attached(t)).select(N.PERSON, N.DATE, N.PRE, N.POST)


def stay_flags(t):
    return day_facts.stay_flags(_attached(t)).select(
        N.PERSON, N.DATE, N.IN_STRONG_STAY, N.ON_STRONG_ED, N.IN_WEAK_STAY, N.ON_WEAK_ED
    )


def during_any_stay(t):
    return day_facts.during_any_stay(_attached(t).select(N.PERSON, N.DATE), t.visits)


def _facts_and_codes(t: StudyTables) -> tuple[DataFrame, StudyCodes]:
    codes = _codes(t)
    persons = _persons(t, codes)
    linked = person_flow.linked_visits(t, persons, codes, WINDOWS)
    death_rows = person_flow.death_table(t, persons, codes, WINDOWS)
    return person_flow.build_day_facts(t, persons, codes, linked, death_rows, WINDOWS), codes


# --- person summary ---------------------------------------------------------------


def _rollup(phase: str, t: StudyTables) -> DataFrame:
    facts, codes = _facts_and_codes(t)
    return summary.phase_rollup(facts, phase, summary.phase_column_lists(codes.sheet_rows, facts.columns))


def length_of_stay(t):
    return summary.length_of_stay(first_linked_visits(t)).select(N.PERSON, N.LENGTH_OF_STAY)


def person_summary(t):
    return person_flow.run(t, SETS, WINDOWS).person_summary


def study_flow(t):
    """All outputs, each written and read again for the next."""
    folder = f"{shared_folder(t.person.sparkSession)}/study-{uuid.uuid4().hex}"
    return person_flow.output_sizes(person_flow.write_outputs(t, SETS, WINDOWS, folder))


_BUILDERS: dict[str, Callable[[StudyTables], DataFrame]] = {
    "occurrence_intake": occurrence_intake,
    "person_sample": lambda t: intake.person_sample(t.person),
    "person_sample_share": lambda t: intake.person_sample(t.person, 0.3),
    "concept_ids": lambda t: _ids(t, SETS.pcr_ag_tests, SETS.positive_results),
    "concept_indicator_map": concept_indicator_map,
    "merge_sheets": _sheet,
    "positive_tests": _labs,
    "first_event_date": lambda t: index_event.first_event_date(_diagnoses(t), N.FIRST_DX),
    "index_date": _index_dates,
    "date_of_birth": date_of_birth,
    "age_at_index": age_at_index,
    "category_map": category_map,
    "normalize_shift_days": normalize_shift_days,
    "plausible_dates": plausible_dates,
    "visit_dedup": _counted,
    "visit_counts": visit_counts,
    "observation_periods": observation_periods,
    "dimension_dedup": lambda t: intake.locations(t.location),
    "cohort": cohort,
    "ed_visits_strong": lambda t: _linked(t, "ed", "strong"),
    "visits_strong_or_mode": visits_strong_or_mode,
    "ed_visits_weak": lambda t: _linked(t, "ed", "weak"),
    "hospital_visits_strong": lambda t: _linked(t, "stay", "strong"),
    "hospital_visits_weak": lambda t: _linked(t, "stay", "weak"),
    "first_linked_visits": first_linked_visits,
    **{f"indicator_pivot_{d}": partial(_pivot, d) for d in N.DOMAINS},
    "lab_flags": partial(_of_tagged, domains.lab_flags),
    "best_bmi": partial(_of_tagged, domains.best_bmi),
    "measurements": measurements,
    "dose_dates": dose_dates,
    "death_dates": partial(_of_deaths, deaths.death_dates),
    "death_flags": partial(_of_deaths, deaths.death_flags),
    "day_facts_merge": day_facts_merge,
    "attach_person_dates": _attached,
    "first_reinfection": first_reinfection,
    "death_in_window": death_in_window,
    "phase_flags": phase_flags,
    "stay_flags": stay_flags,
    "during_any_stay": during_any_stay,
    "day_facts": lambda t: _facts_and_codes(t)[0],
    "phase_columns": lambda t: summary.phase_columns(_sheet(t), _facts_and_codes(t)[0]),
    "phase_rollup_pre": partial(_rollup, "pre"),
    "phase_rollup_during": partial(_rollup, "during"),
    "phase_rollup_post": partial(_rollup, "post"),
    "length_of_stay": length_of_stay,
    "severity": lambda t: person_summary(t).select(N.PERSON, N.SEVERITY),
    "person_summary": person_summary,
    "count_by_shift": lambda t: summary.count_by_shift(person_summary(t)),
    "study_flow": study_flow,
}


def _query(build: Callable[[StudyTables], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(trial.study_tables(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {key: partial(_query, build) for key, build in _BUILDERS.items()}
