"""Index event, demographics, visits around the index date."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from phasewise import names as N
from phasewise.operators import codesets, demographics, index_event, intake, visits

INDEXED = f"person_id long, {N.FIRST_LAB} date, {N.FIRST_DX} date, {N.INDEX} date"
VISIT = ("person_id long, visit_start_date date, macrovisit_start_date date, macrovisit_end_date date, "
         "visit_concept_id long")


def test_index_is_the_earlier_or_the_one_present(frame):
    labs = frame("person_id long, date date", (1, "01-05"), (3, "01-09"), (3, "01-07"))
    dx = frame("person_id long, date date", (2, "01-06"), (3, "01-08"))
    assert rows(index_event.index_date(labs, dx)) == [
        (1, day("01-05"), None, day("01-05")),
        (2, None, day("01-06"), day("01-06")),
        (3, day("01-07"), day("01-08"), day("01-07")),
    ]


def test_only_the_current_version_of_a_set_counts(frame):
    sets = frame("concept_set_name string, is_most_recent_version string, concept_id long",
                 ("A", "true", 1), ("A", "false", 2), ("B", "true", 3))
    assert rows(codesets.concept_ids(sets, ["A"])) == [(1,)]
    as_boolean = sets.withColumn("is_most_recent_version", F.col("is_most_recent_version").cast("boolean"))
    assert rows(codesets.concept_ids(as_boolean, ["A", "B"])) == [(1,), (3,)]


def test_positive_test_needs_test_and_result(frame):
    meas = frame("person_id long, date date, concept_id long, value_as_concept_id long",
                 (1, "01-05", 10, 90), (1, "01-05", 10, 90), (1, "01-06", 10, 91), (1, "01-07", 11, 90))
    test, result = frame("concept_id long", (10,)), frame("concept_id long", (90,))
    assert rows(index_event.positive_tests(meas, test, result)) == [(1, day("01-05"))]


def test_sheets_with_equal_rows_and_nulls_merge_once(frame):
    schema = "concept_set_name string, indicator_prefix string, domain string, pre_during_post string"
    required = frame(schema, ("A", "a", None, "pre"), ("B", "b", "drug", "pre"))
    custom = frame(schema, ("A", "a", None, "pre"), ("C", "c", "drug", "post"))
    assert [r[0] for r in rows(codesets.merge_sheets(required, custom))] == ["A", "B", "C"]


@pytest.mark.parametrize("parts, expected", [
    ((None, 0, None), None),
    ((1950, 2, 31), None),
    ((1901, 12, 31), None),
    ((2030, 1, 1), None),
    ((1950, 0, 0), "1950-07-01"),
    ((1950, None, 9), "1950-07-09"),
    ((1902, 1, 1), "1902-01-01"),
    ((2024, 3, 2), "2024-03-02"),
    ((2024, 3, 3), None),
])
def test_date_of_birth(frame, parts, expected):
    people = frame("year_of_birth int, month_of_birth int, day_of_birth int", parts)
    born = demographics.date_of_birth(people, "2024-02-01", 30).first()["date_of_birth"]
    assert born == day(expected)


def test_leap_day_birthday(frame):
    df = frame(f"date_of_birth date, {N.INDEX} date", ("1980-02-29", "2019-02-28"), (None, "2019-02-28"))
    assert [r.age_at_covid for r in demographics.age_at_index(df).collect()] == [39, None]


def test_shift_text(frame):
    manifest = frame("data_partner_id long, max_num_shift_days string",
                     (1, ""), (2, "NA"), (3, "30"), (4, "unknown"), (5, None))
    found = rows(intake.normalize_shift_days(manifest), "max_num_shift_days", "shift_days")
    assert found == sorted([("0", 0), ("0", 0), ("30", 30), ("unknown", None), (None, None)], key=repr)


def test_race_groups_and_override(frame):
    people = frame("race_concept_name string, ethnicity_concept_name string",
                   ("Korean", "Not Hispanic or Latino"), ("Korean", "Hispanic or Latino"),
                   ("Hispanic", None), ("Martian", None), (None, None))
    df = demographics.race_ethnicity(demographics.race(people))
    assert [(r.race, r.race_ethnicity) for r in df.collect()] == [
        ("Asian", "Asian Non-Hispanic"), ("Asian", "Hispanic or Latino Any Race"),
        ("Hispanic or Latino", "Hispanic or Latino Any Race"), ("Unknown", "Unknown"), ("Unknown", "Unknown"),
    ]


def test_sample_is_stable_and_keeps_everyone_at_one(spark):
    person = spark.range(2000).select(
        F.col("id").alias("person_id"),
        *[F.lit(1).alias(c) for c in ("year_of_birth", "month_of_birth", "day_of_birth", "location_id", "data_partner_id")],
        *[F.lit("x").alias(c) for c in ("ethnicity_concept_name", "race_concept_name", "gender_concept_name")])
    assert intake.person_sample(person).count() == 2000
    some = rows(intake.person_sample(person, 0.3), "person_id")
    assert some == rows(intake.person_sample(person.repartition(7), 0.3), "person_id")
    assert 500 < len(some) < 700
    assert some != rows(intake.person_sample(person, 0.3, seed=5), "person_id")


def test_dimension_keeps_one_row_per_key(frame):
    place = frame("location_id long, city string, state string", (1, "b", "x"), (1, "a", "z"), (2, None, "y"))
    assert rows(intake.dimension_dedup(place, "location_id")) == [(1, "a", "z"), (2, None, "y")]


def test_visit_dedup_matches_sort_and_drop(spark, frame):
    """The earliest micro-visit of a stay stands for it, as after sorting all rows and dropping duplicates."""
    rng = random.Random(3)
    table = frame("person_id long, macrovisit_start_date date, visit_start_date date", *[
        (rng.randrange(9), rng.choice([None, "01-02", "01-09"]), f"01-{rng.randrange(1, 29):02d}")
        for _ in range(400)])
    stays = (table.where("macrovisit_start_date is not null").orderBy("visit_start_date").coalesce(1)
             .dropDuplicates(["person_id", "macrovisit_start_date"]))
    days = table.where("macrovisit_start_date is null").dropDuplicates(["person_id", "visit_start_date"])
    expected = stays.union(days).select("person_id", "macrovisit_start_date", "visit_start_date")
    assert rows(visits.visit_dedup(table)) == rows(expected)


def test_index_day_counts_in_no_side_but_both_periods(frame):
    cohort = frame(INDEXED, (1, None, "01-10", "01-10"), (2, None, "01-10", "01-10"))
    seen = frame("person_id long, macrovisit_start_date date, visit_start_date date",
                 (1, None, "01-07"), (1, None, "01-10"), (1, None, "01-15"), (2, None, "01-10"))
    assert rows(visits.visit_measures(seen, cohort), "person_id", N.VISITS_BEFORE, N.VISITS_POST,
                N.OBSERVED_BEFORE, N.OBSERVED_POST) == [(1, 1, 1, 3, 5), (2, None, None, 0, 0)]
    assert rows(visits.visit_counts(seen, cohort)) == [(1, 1, 1), (2, None, None)]
    assert rows(visits.observation_periods(seen, cohort)) == [(1, 3, 5), (2, 0, 0)]


@pytest.fixture
def ed_ids(frame):
    return frame("concept_id long", (7,))


def test_strong_link_edges(frame, ed_ids):
    """Lab 1 to 30 days before the visit and before the diagnosis; the same day is out."""
    cohort = frame(INDEXED, (1, "01-01", "01-05", "01-01"))
    seen = frame(VISIT, *[(1, d, None, None, 7) for d in ("01-01", "01-02", "01-31", "02-01")],
                 (1, "01-10", None, None, 8))
    found = visits.visit_link(visits.candidate_visits(seen, ed_ids), cohort)
    assert rows(found) == [(1, day("01-02")), (1, day("01-31"))]
    same_day = frame(INDEXED, (1, "01-01", "01-01", "01-01"))
    assert visits.visit_link(visits.candidate_visits(seen, ed_ids), same_day).count() == 0
    either = visits.visit_link(visits.candidate_visits(seen, ed_ids), same_day, mode="or")
    assert rows(either) == [(1, day("01-02")), (1, day("01-31"))]


def test_weak_link_edges(frame, ed_ids):
    cohort = frame(INDEXED, (1, "01-10", None, "01-10"))
    seen = frame(VISIT, *[(1, d, None, None, 7) for d in ("01-12", "01-11", "01-10", "01-09")])
    found = visits.visit_link(visits.candidate_visits(seen, ed_ids), cohort, strength="weak")
    assert rows(found) == [(1, day("01-10")), (1, day("01-11"))]


def test_start_and_end_of_first_stay_are_separate_minima(frame, ed_ids):
    cohort = frame(INDEXED, (1, "2023-12-30", "2023-12-31", "2023-12-30"), (2, "01-01", None, "01-01"))
    seen = frame(VISIT, (1, "01-02", "01-01", "01-20", 8), (1, "01-05", "01-05", "01-08", 8),
                 (2, "01-05", None, None, 8))
    found = visits.first_linked_visits(seen, cohort, ed_ids)
    assert rows(found, "person_id", N.STRONG_START, N.STRONG_END) == [
        (1, day("01-01"), day("01-08")), (2, None, None)]
    paired = visits.first_linked_visits(seen, cohort, ed_ids, paired=True)
    assert rows(paired, "person_id", N.STRONG_END)[0] == (1, day("01-20"))


def test_first_linked_visits_match_person_level_joins(spark, frame, ed_ids):
    rng = random.Random(5)

    def visit():
        start = rng.randrange(1, 20)
        stay = rng.random() < .5
        return (rng.randrange(8), f"01-{start:02d}", f"01-{start:02d}" if stay else None,
                f"01-{start + rng.randrange(9):02d}" if stay and rng.random() < .9 else None, rng.choice([7, 8]))

    seen = frame(VISIT, *[visit() for _ in range(200)])
    cohort = frame(INDEXED, *[(p, f"01-{p + 2:02d}", f"01-{p + 4:02d}", f"01-{p + 2:02d}") for p in range(6)])
    candidates = visits.candidate_visits(seen, ed_ids)
    strong, weak = (visits.visit_link(candidates, cohort, "stay", s).groupBy("person_id").agg(
        F.min(N.STAY_START).alias(f"{s}_start"), F.min(N.STAY_END).alias(f"{s}_end")) for s in ("strong", "weak"))
    ed = [visits.visit_link(candidates, cohort, "ed", s).groupBy("person_id").agg(F.min("ed_date").alias(f"{s}_ed"))
          for s in ("strong", "weak")]
    expected = seen.join(cohort, "person_id", "left_semi").select("person_id").distinct()
    for part in (ed[0], strong, ed[1], weak):
        expected = expected.join(part, "person_id", "left")
    assert rows(visits.first_linked_visits(seen, cohort, ed_ids)) == rows(expected)


def test_plausible_dates_drop_unknown_sources(frame):
    manifest = frame("data_partner_id long, run_date date, cdm_name string, cdm_version string, "
                     "shift_date_yn string, max_num_shift_days string", (1, "01-20", "a", "1", "N", ""))
    seen = frame("person_id long, data_partner_id long, visit_start_date date",
                 (1, 1, "2017-12-31"), (2, 1, "2018-01-01"), (3, 1, "01-24"), (4, 1, "01-25"),
                 (5, None, "01-01"), (6, 2, "01-01"), (7, 1, None))
    kept = intake.plausible_dates(seen, intake.source_manifest(manifest), "visit_start_date", N.FLOOR_DATE, 5)
    assert [r[0] for r in rows(kept, "person_id")] == [2, 3]
