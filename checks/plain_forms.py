"""Plain forms of some operators, written from their definitions, to compare plans and times with ours.

join per table to the list of keys, a join on person and range, one grouped scan per phase. They
give the same rows. Inputs are written beforehand, so only the operator itself is timed.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from phasewise import names as N
from phasewise.functions.lineage import cut
from phasewise.operators import day_facts, domains, summary, visits
from phasewise.plans import person_flow
from phasewise.plans.codes import resolve_codes
from phasewise.sources import trial

KEYS = [N.PERSON, N.DATE]


def ranked_visits(seen: DataFrame) -> DataFrame:
    """Of each person and stay, or day outside stays, the visit that ranks first by date."""
    day = F.when(F.col(N.STAY_START).isNull(), F.col(visits.VISIT_START))
    order = Window.partitionBy(N.PERSON, N.STAY_START, day).orderBy(visits.VISIT_START)
    return seen.select("*", F.row_number().over(order).alias("place")).where("place = 1").drop("place")


def to_keys(keys: DataFrame, tables: list[DataFrame], by: list[str]) -> DataFrame:
    """Every table joined to the keys."""
    return reduce(lambda rows, table: rows.join(table, by, "left"), tables, keys)


def linked_by_kind(seen: DataFrame, cohort: DataFrame, ed_ids: DataFrame) -> DataFrame:
    """First dates of each kind and strength of link, one grouped table for each."""
    candidates = visits.candidate_visits(seen, ed_ids)
    found = []
    for strength, dates in (("strong", (N.STRONG_ED, N.STRONG_START, N.STRONG_END)), ("weak", (N.WEAK_ED, N.WEAK_START, N.WEAK_END))):
        for kind, columns in (("ed", {"ed_date": dates[0]}), ("stay", {N.STAY_START: dates[1], N.STAY_END: dates[2]})):
            found.append(visits.visit_link(candidates, cohort, kind, strength).groupBy(N.PERSON).agg(
                *[F.min(c).alias(name) for c, name in columns.items()]))
    persons = seen.select(N.PERSON).intersect(cohort.select(N.PERSON))
    return to_keys(persons, found, [N.PERSON]).select(N.PERSON, *N.LINKED_DATES)


def dose_days(doses: DataFrame, cohort: DataFrame, columns: list[str]) -> DataFrame:
    """The days of each dose column, one below the other, without repetitions."""
    days = reduce(DataFrame.union, [doses.select(N.PERSON, F.col(c).alias(N.DATE)) for c in columns])
    return days.where(F.col(N.DATE).isNotNull()).distinct().join(
        cohort.select(N.PERSON), N.PERSON, "left_semi").withColumn(N.DOSE, F.lit(1))


def days_by_table(tables: list[DataFrame]) -> DataFrame:
    """All days of all tables, and each column as the largest of the tables that have it (numbers other than BMI: 0 if none)."""
    grouped, sources = [], {}
    for i, table in enumerate(tables):
        own = [c for c in table.columns if c not in KEYS]
        grouped.append(table.groupBy(*KEYS).agg(*[F.max(c).alias(f"{c} {i}") for c in own] or [F.lit(1).alias(f"row {i}")]))
        for c in own:
            sources.setdefault(c, []).append(F.col(f"`{c} {i}`"))
    keys = reduce(DataFrame.union, [t.select(*KEYS) for t in tables]).distinct()
    value = {c: F.greatest(*found) if len(found) > 1 else found[0] for c, found in sources.items()}
    return to_keys(keys, grouped, KEYS).select(
        *KEYS, *[(v if c == N.BMI else F.coalesce(v, F.lit(0))).alias(c) for c, v in value.items()])


def days_in_range(days: DataFrame, seen: DataFrame) -> DataFrame:
    """Days with a stay of the person around them, by a join on person and range."""
    a, b = days.alias("a"), seen.select(N.PERSON, N.STAY_START, N.STAY_END).distinct().alias("b")
    inside = (F.col(f"a.{N.PERSON}") == F.col(f"b.{N.PERSON}")) & F.col(f"a.{N.DATE}").between(F.col(N.STAY_START), F.col(N.STAY_END))
    return a.join(b, inside, "left").groupBy(*[F.col(f"a.{k}").alias(k) for k in KEYS]).agg(
        F.max(F.when(F.col(N.STAY_START).isNotNull(), 1)).alias(N.IN_ANY_STAY))


def rollup_by_phase(facts: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """One grouped scan per phase, each joined to the persons."""
    found = [
        facts.where(F.col(flag) == 1).groupBy(N.PERSON).agg(
            *[F.max(c).alias(f"{phase}_{c}") for c in columns["during" if phase.startswith("during") else phase]])
        for phase, flag in summary.PHASE_FLAG.items()
    ]
    return to_keys(facts.select(N.PERSON).distinct(), found, [N.PERSON])


def pairs(spark: SparkSession, folder: str) -> dict[str, dict]:
    t = trial.study_tables(spark, folder)
    windows, codes = trial.WINDOWS, resolve_codes(t, trial.SETS)
    persons = person_flow.index_persons(t, codes, windows)
    seen, doses = cut(t.visits), cut(t.vaccine_doses)
    doses_columns = list(windows.dose_columns)
    ed_ids = codes.ids("ed_visit")
    linked = cut(person_flow.linked_visits(t, persons, codes, windows))
    death_rows = cut(person_flow.death_table(t, persons, codes, windows))
    facts = cut(person_flow.build_day_facts(t, persons, codes, linked, death_rows, windows))
    columns = summary.phase_column_lists(codes.sheet_rows, facts.columns)
    frames = [cut(f) for f in (
        seen.select(N.PERSON, F.col(visits.VISIT_START).alias(N.DATE)).distinct(),
        domains.dose_dates(doses, persons, doses_columns),
        *[person_flow.domain_table(t, persons, codes, d) for d in N.DOMAINS],
        person_flow.measurement_table(t, persons, codes),
    )]
    days = cut(facts.select(*KEYS))
    return {
        "visit_dedup": {
            "plain": lambda: ranked_visits(seen), "ours": lambda: visits.visit_dedup(seen)},
        "first_linked_visits": {
            "plain": lambda: linked_by_kind(seen, persons, ed_ids),
            "ours": lambda: visits.first_linked_visits(seen, persons, ed_ids)},
        "dose_dates": {
            "plain": lambda: dose_days(doses, persons, doses_columns),
            "ours": lambda: domains.dose_dates(doses, persons, doses_columns)},
        "day_facts_merge": {
            "plain": lambda: days_by_table(frames),
            "ours": lambda: day_facts.day_facts_merge(frames, [*codes.indicators, N.OBESITY])},
        "during_any_stay": {
            "plain": lambda: days_in_range(days, seen),
            "ours": lambda: day_facts.during_any_stay(days, seen)},
        "phase_rollups": {
            "plain": lambda: rollup_by_phase(facts, columns),
            "ours": lambda: summary.phase_rollups(facts, columns)},
    }
