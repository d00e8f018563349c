"""Domains, deaths, day facts, person summary."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from phasewise import names as N
from phasewise.functions import flags
from phasewise.operators import codesets, day_facts, deaths, domains, summary

MEAS = ("person_id long, date date, concept_id long, value_as_concept_id long, harmonized_value_as_number double")


@pytest.fixture
def roles(frame):
    return frame("concept_id long, pcr_ag boolean, antibody boolean, positive_result boolean, "
                 "negative_result boolean, bmi boolean, weight boolean, height boolean",
                 (1, True, False, False, False, False, False, False),
                 (2, False, True, False, False, False, False, False),
                 (3, False, False, False, False, True, False, False),
                 (4, False, False, False, False, False, True, False),
                 (5, False, False, False, False, False, False, True),
                 (8, False, False, True, False, False, False, False),
                 (9, False, False, False, True, False, False, False))


def test_words_round_trip_over_more_than_one_word(spark):
    names = [f"c{i}" for i in range(130)]
    on = {"c0", "c63", "c64", "c100", "c129"}
    df = spark.range(1).select(*[F.lit(int(n in on)).alias(n) for n in names])
    packed = df.select(*flags.words({n: F.col(n) for n in names}, names))
    assert len(packed.columns) == 3
    assert {n for n, v in packed.select(*flags.unpacked(names)).first().asDict().items() if v} == on


def test_pivot_keeps_listed_columns_and_current_concepts(frame):
    events = frame("person_id long, date date, concept_id long",
                   (1, "01-01", 1), (1, "01-01", 2), (1, "01-02", 3), (2, "01-01", 1), (1, "01-03", 99))
    pairs = frame("concept_id long, indicator_prefix string", (1, "x"), (2, "y"), (2, "x"), (3, "y"))
    cohort = frame("person_id long", (1,))
    found = domains.indicator_pivot(events, cohort, pairs, ["x", "y", "z"])
    assert found.columns == ["person_id", "date", "x", "y", "z"]
    assert rows(found) == [(1, day("01-01"), 1, 1, 0), (1, day("01-02"), 0, 1, 0)]


def test_pivot_without_broadcast_gives_the_same(frame, monkeypatch):
    from phasewise.functions import sizing

    events = frame("person_id long, date date, concept_id long", (1, "01-01", 1), (2, "01-01", 2), (3, "01-01", 1))
    pairs = frame("concept_id long, indicator_prefix string", (1, "x"), (2, "y"))
    cohort = frame("person_id long", (1,), (2,))
    small = rows(domains.indicator_pivot(events, cohort, pairs, ["x", "y"]))
    monkeypatch.setattr(sizing, "fits", lambda df, n=0: False)
    assert rows(domains.indicator_pivot(events, cohort, pairs, ["x", "y"])) == small


@pytest.mark.parametrize("domains_asked", ["drug", ["drug", "device"]])
def test_the_sheet_goes_to_the_members_not_the_members_to_the_sheet(spark, frame, tmp_path, domains_asked):
    """The members grow with the study; a sheet made of collected rows has no size Spark knows."""
    members = frame("concept_set_name string, concept_id int, is_most_recent_version string",
                    ("A", 1, "true"), ("A", 2, "true"), ("A", 3, "false"), ("B", 1, "true"), ("C", 9, "true"), (None, 5, "true"))
    members.write.parquet(f"{tmp_path}/members")
    sheet = frame("concept_set_name string, indicator_prefix string, domain string",
                  ("A", "a", "drug,device"), ("A", "a", "drug"), ("B", "b", "drug"), ("C", "c", None), (None, "d", "drug"))
    one = isinstance(domains_asked, str)
    mapped = codesets.concept_indicator_map if one else codesets.domain_indicator_map
    found = mapped(spark.read.parquet(f"{tmp_path}/members"), sheet, domains_asked)
    drug = [(1, "a"), (1, "b"), (2, "a")]
    assert rows(found) == (drug if one else sorted([("drug", *r) for r in drug] + [("device", 1, "a"), ("device", 2, "a")]))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_labs_keep_days_without_flags(frame, roles):
    meas = frame(MEAS, (1, "01-01", 1, 8, None), (1, "01-01", 2, 9, None), (1, "01-02", 77, 8, None),
                 (1, "01-03", 1, None, None))
    found = domains.lab_flags(domains.tagged_measurements(meas, roles))
    assert rows(found) == [(1, day("01-01"), 1, 0, 0, 1), (1, day("01-02"), 0, 0, 0, 0), (1, day("01-03"), 0, 0, 0, 0)]


def test_bmi_cases(frame, roles):
    meas = frame(MEAS,
                 (1, "01-01", 3, None, 29.5), (1, "01-01", 4, None, 70.0), (1, "01-01", 5, None, 1.7),
                 (1, "01-02", 4, None, 70.0), (1, "01-02", 5, None, 9.0),
                 (1, "01-03", 4, None, 80.0), (1, "01-03", 5, None, 2.0),
                 (1, "01-04", 3, None, 250.0), (1, "01-05", 3, None, None))
    tagged = domains.tagged_measurements(meas, roles)
    assert rows(domains.best_bmi(tagged)) == [(1, day("01-01"), 30.0, 1), (1, day("01-03"), 20.0, 0)]
    merged = domains.measurements(tagged)
    assert merged.count() == 5
    assert rows(merged.where(F.col("date") == day("01-02")), N.BMI, N.OBESITY) == [(None, None)]


def test_two_doses_on_one_day_are_one_row(frame):
    doses = frame("person_id long, a date, b date", (1, "01-01", "01-01"), (1, None, "01-05"), (9, "01-01", None))
    cohort = frame("person_id long", (1,))
    assert rows(domains.dose_dates(doses, cohort, ["a", "b"])) == [(1, day("01-01"), 1), (1, day("01-05"), 1)]


def test_dose_dates_match_outer_joins(frame):
    rng = random.Random(2)
    columns = ["1_vax_date", "2_vax_date", "3_vax_date"]
    doses = frame("person_id long, " + ", ".join(f"`{c}` date" for c in columns), *[
        (rng.randrange(10), *[rng.choice([None, "01-01", "01-02", "01-03"]) for _ in columns]) for _ in range(60)])
    single = [doses.select("person_id", F.col(f"`{c}`").alias("date")).where("date is not null") for c in columns]
    joined = reduce(lambda a, b: a.join(b, ["person_id", "date"], "outer"), single).distinct()
    found = domains.dose_dates(doses, doses.select("person_id"), columns)
    assert rows(found, "person_id", "date") == rows(joined)


def test_death_sources(frame):
    cohort = frame("person_id long, data_extraction_date date", *[(p, "06-01") for p in range(1, 7)])
    death = frame("person_id long, death_date date", (1, "01-10"), (2, "01-12"), (2, "01-10"), (3, None),
                  (5, "1999-01-01"), (9, "01-01"))
    seen = frame("person_id long, visit_start_date date, visit_end_date date, discharge_to_concept_id long",
                 (1, "01-01", "01-08", 50), (3, "01-03", "01-04", 50), (3, "01-05", None, 50),
                 (4, "01-03", "01-04", 60), (6, "01-03", "01-04", 70))
    roles = frame("concept_id long, deceased boolean, hospice boolean",
                  (50, True, False), (60, False, True), (70, False, False))
    found = deaths.death_flags(death, seen, cohort, roles)
    assert rows(found) == [(1, day("01-10"), 1), (2, day("01-10"), 1), (3, day("01-05"), 1), (4, None, 1), (5, None, 1)]
    assert [r[0] for r in rows(deaths.death_dates(death, seen, cohort, roles))] == [1, 2, 3]


def test_merge_matches_full_outer_joins(spark, frame):
    """Eight tables, one indicator shared by two of them; the joined form is collapsed at the end."""
    rng = random.Random(7)
    tables = []
    for i in range(8):
        names = ["shared"] if i in (2, 5) else []
        names += [f"i{i}"]
        keys = {(rng.randrange(6), f"01-{rng.randrange(1, 9):02d}") for _ in range(15)}
        tables.append(frame("person_id long, date date, " + ", ".join(f"{n} int" for n in names),
                            *[(*k, *[rng.randrange(2) for _ in names]) for k in keys]))
    joined = reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], "outer"), tables)
    names = [c for c in joined.columns if c not in ("person_id", "date")]
    expected = joined.na.fill(0).groupBy("person_id", "date").agg(*[F.max(c).alias(c) for c in names])
    found = day_facts.day_facts_merge(tables, names, [])
    assert rows(found, "person_id", "date", *names) == rows(expected, "person_id", "date", *names)


def test_merge_keeps_bmi_null(frame):
    days = frame("person_id long, date date", (1, "01-01"), (1, None))
    bmi = frame(f"person_id long, date date, {N.BMI} double, {N.OBESITY} int", (1, "01-02", 31.0, 1))
    found = day_facts.day_facts_merge([days, bmi], [N.OBESITY])
    assert rows(found, "date", N.OBESITY, N.BMI) == sorted(
        [(day("01-01"), 0, None), (day("01-02"), 1, 31.0), (None, 0, None)], key=repr)


def test_reinfection_only_after_the_wait(frame):
    facts = frame(f"person_id long, date date, {N.INDEX} date, PCR_AG_Pos int",
                  (1, "03-31", "01-01", 1), (1, "04-01", "01-01", 1), (1, "04-30", "01-01", 1), (1, "04-15", "01-01", 0))
    found = day_facts.first_reinfection(facts)
    assert rows(found, "date", N.REINFECTION) == [
        (day("03-31"), 0), (day("04-01"), 1), (day("04-15"), 0), (day("04-30"), 0)]


def test_death_window_edges(frame):
    facts = frame(f"person_id long, date date, {N.INDEX} date, {N.DEATH} int",
                  *[(1, d, "01-01", 1) for d in ("01-01", "01-02", "01-31", "02-01")], (1, "01-03", "01-01", 0))
    found = {r[0]: r[1] for r in rows(day_facts.death_in_window(facts), "date", N.DEATH_IN_WINDOW)}
    assert [found[day(d)] for d in ("01-01", "01-02", "01-31", "02-01", "01-03")] == [0, 1, 1, 0, 0]


def test_person_without_facts_keeps_a_row(frame):
    cohort = frame(f"person_id long, {N.FIRST_LAB} date, {N.FIRST_DX} date, {N.INDEX} date", (1, None, "01-01", "01-01"))
    linked = frame("person_id long, " + ", ".join(f"{c} date" for c in N.LINKED_DATES))
    facts = frame("person_id long, date date", (2, "01-01"))
    found = day_facts.phase_flags(day_facts.attach_person_dates(facts, cohort, linked))
    assert rows(found, "person_id", "date", N.PRE, N.POST) == [(1, None, 0, 0)]


def test_day_in_any_stay_names_the_earliest(frame):
    days = frame("person_id long, date date", *[(1, f"01-{d:02d}") for d in (1, 5, 10, 12, 20)], (2, "01-05"), (1, None))
    stays = frame(f"person_id long, {N.STAY_START} date, {N.STAY_END} date",
                  (1, "01-04", "01-10"), (1, "01-05", "01-15"), (1, "01-06", "01-07"), (1, "01-19", None), (1, None, None))
    found = day_facts.during_any_stay(days, stays)
    assert rows(found, "person_id", "date", N.IN_ANY_STAY, N.STAY_START) == sorted([
        (1, None, 0, None), (1, day("01-01"), 0, None), (1, day("01-05"), 1, day("01-04")),
        (1, day("01-10"), 1, day("01-04")), (1, day("01-12"), 1, day("01-05")), (1, day("01-20"), 0, None),
        (2, day("01-05"), 0, None)], key=repr)


def test_any_stay_matches_pairwise_search(frame):
    rng = random.Random(11)
    stays = [(p, a, a + rng.randrange(-2, 12)) for p in range(4) for a in (rng.randrange(1, 50) for _ in range(12))]
    days = [(p, d) for p in range(4) for d in range(1, 60) if rng.random() < .6]
    base = day("01-01").toordinal()
    at = lambda n: type(day("01-01")).fromordinal(base + n).isoformat()
    found = day_facts.during_any_stay(
        frame("person_id long, date date", *[(p, at(d)) for p, d in days]),
        frame(f"person_id long, {N.STAY_START} date, {N.STAY_END} date", *[(p, at(a), at(b)) for p, a, b in stays]))
    expected = []
    for p, d in days:
        covering = [(a, -b) for q, a, b in stays if q == p and a <= d <= b]
        start, end = (at(min(covering)[0]), at(-min(covering)[1])) if covering else (None, None)
        expected.append((p, day(at(d)), int(bool(covering)), day(start), day(end)))
    assert rows(found) == sorted(expected, key=repr)


FACTS = (f"person_id long, date date, {N.PRE} int, {N.POST} int, {N.IN_STRONG_STAY} int, {N.IN_WEAK_STAY} int, "
         f"{N.BMI} double, {N.DOSE} int, {N.REINFECTION} int, {N.DEATH} int, {N.DEATH_IN_WINDOW} int, "
         "LL_IMV int, other int")


def test_rollup_by_phase(frame):
    facts = frame(FACTS,
                  (1, "01-01", 1, 0, 0, 0, 25.0, 1, 0, 0, 0, 1, 0),
                  (1, "01-02", 1, 0, 1, 0, 27.0, 1, 0, 0, 0, 0, 1),
                  (1, "01-03", 0, 1, 1, 0, None, 1, 1, 1, 1, 1, 0),
                  (2, None, 0, 0, 0, 0, None, 0, 0, 0, 0, 0, 0))
    columns = {"pre": [N.BMI, N.DOSE, "other"], "during": ["LL_IMV", N.DEATH], "post": [N.BMI, N.DOSE, N.REINFECTION]}
    found = summary.phase_rollups(facts, columns).where("person_id = 1").first().asDict()
    assert found[N.BMI_PRE] == 27.0 and found[N.DOSES_PRE] == 2 and found["other_before_or_day_of_covid_indicator"] == 1
    assert found["LL_IMV_during_strong_covid_hospitalization_indicator"] == 1
    assert found["LL_ECMO_during_strong_covid_hospitalization_indicator"] == 0
    assert found["LL_IMV_during_weak_covid_hospitalization_indicator"] is None
    assert found[N.DOSES_POST] == 1 and found[N.REINFECTED] == 1 and found[N.DEATH_IN_WINDOW] == 1
    assert rows(summary.phase_rollup(facts, "post", columns), "person_id", N.DOSES_POST) == [(1, 1)]


def test_severity_order(frame):
    critical = [c + N.PHASE_SUFFIX[p] for p in ("during_strong", "during_weak") for c in N.CRITICAL_CARE]
    schema = (f"person_id long, {N.FIRST_LAB} date, {N.FIRST_DX} date, {N.DEATH_IN_WINDOW} int, "
              + ", ".join(f"{c} int" for c in critical)
              + f", {N.STRONG_START} date, {N.STRONG_ED} date, {N.WEAK_START} date, {N.WEAK_ED} date")
    d = "01-01"
    people = frame(schema,
                   (1, None, None, 1, 1, 1, 1, 1, d, d, d, d), (2, d, None, 1, 1, 0, 0, 0, d, None, None, None),
                   (3, d, None, 0, 0, 1, 0, 0, d, d, None, None), (4, d, None, 0, 0, 0, 1, 0, d, d, d, None),
                   (5, d, None, 0, 0, 0, 1, 0, None, d, d, None), (6, d, None, 0, 0, 0, 0, 1, None, None, d, d),
                   (7, d, None, 0, 0, 0, 0, 0, None, None, d, d), (8, d, None, 0, 0, 0, 0, 0, None, None, None, d),
                   (9, d, None, 0, 0, 0, 0, 0, None, None, None, None))
    assert [r[1] for r in rows(summary.severity(people), "person_id", N.SEVERITY)] == list(N.SEVERITY_CLASSES.values())


def test_count_by_shift_keeps_the_null_group(frame):
    people = frame("person_id long, shift_date_yn string", (1, "Y"), (1, "Y"), (2, None), (3, "N"))
    assert rows(summary.count_by_shift(people)) == sorted([("Y", 1), (None, 1), ("N", 1)], key=repr)


def test_phase_columns_lists_agree(frame):
    sheet = frame("concept_set_name string, indicator_prefix string, domain string, pre_during_post string",
                  ("A", "a", "drug", "pre,post"), ("B", "b", "drug", "during"), ("C", "absent", "drug", "pre"))
    facts = frame(f"person_id long, a int, b int, {N.BMI} double, {N.DEATH} int")
    listed = summary.phase_column_lists(sheet.collect(), facts.columns)
    assert listed == {"pre": [N.BMI, "a"], "during": [N.DEATH, "b"], "post": [N.BMI, "a"]}
    assert rows(summary.phase_columns(sheet, facts)) == sorted(
        (phase, c) for phase, columns in listed.items() for c in columns)
