"""The whole flow, from source tables to the person summary."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from phasewise import names
from phasewise.functions import flags, sizing
from phasewise.functions.dates import plausible
from phasewise.functions.lineage import cut_observed, scratch
from phasewise.names import BMI, DATE, DEATH, DOMAINS, DOSE, OBESITY, PERSON
from phasewise.operators import (
    codesets, day_facts, deaths, demographics, domains, index_event, intake, summary, visits,
)
from phasewise.plans.codes import StudyCodes, resolve_codes
from phasewise.plans.study import CodeSets, Windows
from phasewise.sources.tables import StudyTables, write_table

# Source table, date column and concept column of each indicator domain.
DOMAIN_SOURCES = {
    "condition": ("condition_occurrence", "condition_start_date", "condition_concept_id"),
    "device": ("device_exposure", "device_exposure_start_date", "device_concept_id"),
    "drug": ("drug_exposure", "drug_exposure_start_date", "drug_concept_id"),
    "observation": ("observation", "observation_date", "observation_concept_id"),
    "procedure": ("procedure_occurrence", "procedure_date", "procedure_concept_id"),
}


def domain_events(tables: StudyTables, domain: str) -> DataFrame:
    table, date_col, concept_col = DOMAIN_SOURCES[domain]
    return intake.dated_events(getattr(tables, table), date_col, concept_col)


def measurement_events(tables: StudyTables) -> DataFrame:
    return intake.dated_events(
        tables.measurement, "measurement_date", "measurement_concept_id",
        {index_event.RESULT: index_event.RESULT, domains.VALUE: domains.VALUE},
    )


# --- cohort ---------------------------------------------------------------------


def index_dates(tables: StudyTables, codes: StudyCodes) -> DataFrame:
    labs = index_event.positive_test_rows(
        measurement_events(tables), codes.ids("pcr_ag"), codes.ids("positive_result")
    )
    diagnoses = index_event.with_concept(domain_events(tables, "condition"), codes.ids("diagnosis"))
    return index_event.index_date(labs, diagnoses)


def counted_visits(tables: StudyTables, sources: DataFrame, windows: Windows) -> DataFrame:
    """Plausible visits, one per stay or day."""
    columns = tables.visits.select(PERSON, names.PARTNER, names.STAY_START, visits.VISIT_START)
    return visits.visit_dedup(
        intake.plausible_dates(
            columns, sources, visits.VISIT_START, windows.floor, windows.horizon_days
        )
    )


@dataclass(frozen=True)
class IndexPersons:
    """Persons with an index date and what was seen while they were written.

    ``near`` and ``ids`` are the same rows, and their ids, for joins with events: marked for
    broadcast where their measured size allows it.
    """

    rows: DataFrame
    count: int
    max_shift: int

    def marked(self, df: DataFrame) -> DataFrame:
        """A table with at most one row of fixed size for each of the persons, marked if that is small."""
        size = self.count * (sizing.ROW_BYTES + sizing.VALUE_BYTES * len(df.columns))
        return F.broadcast(df) if size <= sizing.MAX_BROADCAST_BYTES else df

    @property
    def near(self) -> DataFrame:
        return self.marked(self.rows.select(PERSON, *visits.INDEX_COLUMNS, names.EXTRACTION))

    @property
    def ids(self) -> DataFrame:
        return self.marked(self.rows.select(PERSON))


def index_group(tables: StudyTables, codes: StudyCodes, windows: Windows) -> IndexPersons:
    """Index dates with person and source columns, before anything derived from them.

    Written once: most later steps read it, and none should repeat the scan of the event
    tables. Its bytes, rows and largest shift are aggregated on the way.
    """
    people = intake.person_sample(tables.person, windows.sample, windows.seed)
    found = index_dates(tables, codes).join(people, PERSON).join(codes.sources, names.PARTNER)
    rows, seen = cut_observed(found, rows=F.count(F.lit(1)), shift=F.max("shift_days"))
    return IndexPersons(rows, seen["rows"] or 0, seen["shift"] or 0)


def index_persons(tables: StudyTables, codes: StudyCodes, windows: Windows) -> DataFrame:
    return index_group(tables, codes, windows).rows


def build_cohort(
    tables: StudyTables, persons: DataFrame, sources: DataFrame, windows: Windows, group: IndexPersons | None = None
) -> DataFrame:
    """One row per person with an index date: dates, demographics, place, source, visit measures.

    ``group`` tells what is known of the persons already.
    """
    seen = counted_visits(tables, sources, windows)
    if group is None:
        max_shift = F.coalesce(persons.agg(F.max("shift_days")).scalar(), F.lit(0))
        measures = visits.visit_measures(seen, persons)
    else:
        max_shift = F.lit(group.max_shift)
        measures = group.marked(visits.visit_measures(seen, group.near))
    described = demographics.age_at_index(demographics.date_of_birth(persons, windows.as_of, max_shift))
    grouped = demographics.race_ethnicity(demographics.race(described))
    return (
        grouped.join(measures, PERSON, "left")
        .join(intake.locations(tables.location), "location_id", "left")
        .select(*names.COHORT_COLUMNS)
    )


# --- tables around the cohort ------------------------------------------------------


def linked_visits(tables: StudyTables, cohort: DataFrame, codes: StudyCodes, windows: Windows) -> DataFrame:
    return visits.first_linked_visits(
        tables.visits, cohort, codes.ids("ed_visit"), windows.link_mode, windows.link_days
    )


def death_table(tables: StudyTables, cohort: DataFrame, codes: StudyCodes, windows: Windows) -> DataFrame:
    return deaths.death_flags(
        tables.death, tables.visits, cohort, codes.roles, windows.floor, windows.horizon_days
    )


def domain_table(tables: StudyTables, cohort: DataFrame, codes: StudyCodes, domain: str) -> DataFrame:
    """Day-level indicators of one domain, as a table of its own."""
    pairs = codesets.concept_indicator_map(tables.concept_sets, codes.sheet, domain)
    return domains.indicator_pivot(
        domain_events(tables, domain), cohort, pairs, codes.domain_indicators(domain)
    )


def measurement_table(tables: StudyTables, cohort: DataFrame, codes: StudyCodes) -> DataFrame:
    """Labs and body mass per day, as a table of its own."""
    events = intake.early_cohort_filter(measurement_events(tables), intake.cohort_ids(cohort))
    tagged = domains.tagged_measurements(events, codes.roles)
    return domains.measurements(tagged)


# --- day facts ----------------------------------------------------------------------


def plausible_death_days(death_rows: DataFrame, cohort: DataFrame, windows: Windows) -> DataFrame:
    """Death dates that can stand among the facts."""
    return (
        death_rows.join(cohort.select(PERSON, names.EXTRACTION), PERSON)
        .where(plausible(DATE, names.EXTRACTION, windows.floor, windows.horizon_days))
        .select(PERSON, DATE)
    )


def merged_days(
    tables: StudyTables,
    cohort: DataFrame,
    codes: StudyCodes,
    death_days: DataFrame,
    windows: Windows,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Every fact of every day, straight from the source rows.

    All sources are brought to one narrow row (person, day, indicator bits, body values) and
    merged by one aggregate: one shuffle, combined on the map side, in place of an aggregate
    per domain and a join between each two. Stay spans ride along; a day that only starts a
    span has ``is_fact`` false. ``ids``: the cohort's, where their size is known already.
    """
    indicators = codes.indicators
    body = [f"{part}_value" for part in domains.BODY_PARTS]
    no_body = [F.lit(None).cast("double").alias(b) for b in body]
    no_span = [F.lit(None).cast("date").alias(c) for c in day_facts.SPAN]
    fact = F.lit(True).alias("is_fact")
    ids = intake.cohort_ids(cohort) if ids is None else ids

    def near(rows: DataFrame) -> DataFrame:
        return intake.early_cohort_filter(rows, ids)

    def flagged(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        return rows.select(PERSON, DATE, *flags.words(values, indicators), *no_body, *no_span, fact)

    coded = reduce(
        DataFrame.unionByName,
        [domain_events(tables, d).withColumn("domain", F.lit(d)) for d in DOMAINS],
    )
    tagged = domains.tagged_measurements(near(measurement_events(tables)), codes.roles)
    spans = day_facts.stay_spans(near(tables.visits))
    sources = [
        flagged(near(tables.visits.select(PERSON, F.col(visits.VISIT_START).alias(DATE))), {}),
        flagged(near(domains.dose_rows(tables.vaccine_doses, list(windows.dose_columns))), {DOSE: F.lit(1)}),
        flagged(death_days, {DEATH: F.lit(1)}),
        domains.indicator_rows(near(coded), codes.words, indicators).select(
            PERSON, DATE, *flags.word_names(indicators), *no_body, *no_span, fact
        ),
        tagged.select(
            PERSON, DATE, *flags.words(domains.lab_columns(), indicators),
            *domains.body_columns(), *no_span, fact,
        ),
        spans.select(
            PERSON, DATE, *flags.words({}, indicators), *no_body,
            *day_facts.SPAN, F.lit(False).alias("is_fact"),
        ),
    ]
    merged = (
        reduce(DataFrame.unionByName, sources)
        .groupBy(PERSON, DATE)
        .agg(
            *flags.merged(indicators), *domains.merged_body(),
            *[F.max(c).alias(c) for c in day_facts.SPAN], F.bool_or("is_fact").alias("is_fact"),
        )
    )
    bmi, obese = domains.bmi_columns()
    return merged.withColumns({BMI: bmi, OBESITY: F.coalesce(obese, F.lit(0))}).drop(*body)


def covered_days(
    tables: StudyTables,
    cohort: DataFrame,
    codes: StudyCodes,
    death_days: DataFrame,
    windows: Windows,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Merged days with the stay that covers each, indicators still as bits.

    After the merge a person has at most one row per calendar day, so the window over one
    person stays small whoever the person is.
    """
    by_day = Window.partitionBy(PERSON).orderBy(DATE)
    return (
        merged_days(tables, cohort, codes, death_days, windows, ids)
        .withColumns(day_facts.latest_span(by_day))
        .where(F.col("is_fact"))
        .select(PERSON, DATE, *flags.word_names(codes.indicators), BMI, OBESITY, *day_facts.covering())
    )


def fact_days(
    tables: StudyTables,
    cohort: DataFrame,
    codes: StudyCodes,
    death_days: DataFrame,
    windows: Windows,
) -> DataFrame:
    """The same with a 0/1 column per indicator."""
    days = covered_days(tables, cohort, codes, death_days, windows)
    others = [c for c in days.columns if c not in flags.word_names(codes.indicators)]
    return days.select(*others, *flags.unpacked(codes.indicators))


def build_day_facts(
    tables: StudyTables,
    cohort: DataFrame,
    codes: StudyCodes,
    linked: DataFrame,
    death_rows: DataFrame,
    windows: Windows,
    ids: DataFrame | None = None,
) -> DataFrame:
    """One row per cohort person and day, all indicators and flags.

    The merged days move once more, to their person: the windows for stays and reinfection
    and the joins with person-level tables all run on that partitioning. Rows stay narrow
    until the last projection spreads the indicator bits.
    """
    indicators = codes.indicators
    words = flags.word_names(indicators)
    needed = [names.DEATH, day_facts.POSITIVE]
    days = covered_days(
        tables, cohort, codes, plausible_death_days(death_rows, cohort, windows), windows, ids
    ).select("*", *[flags.flag(indicators, c).alias(c) for c in needed])
    attached = day_facts.attach_person_dates(days, cohort, linked)
    flagged = day_facts.stay_flags(
        day_facts.phase_flags(
            day_facts.death_in_window(
                day_facts.first_reinfection(attached, windows.reinfection_wait), windows.death_window
            )
        )
    )
    filled = summary.fill_numbers(flagged, [PERSON, BMI])
    dropped = [*words, *needed, names.STRONG_END, names.STRONG_ED, names.WEAK_END, names.WEAK_ED]
    others = [c for c in filled.columns if c not in dropped]
    return filled.select(*others, *flags.unpacked(indicators))


# --- everything -----------------------------------------------------------------------


@dataclass(frozen=True)
class StudyResult:
    """Output tables of the flow, still to be written or read."""

    codes: StudyCodes
    cohort: DataFrame
    linked: DataFrame
    deaths: DataFrame
    day_facts: DataFrame
    person_summary: DataFrame


def run(tables: StudyTables, sets: CodeSets, windows: Windows) -> StudyResult:
    """Cohort, linked visits, deaths, day facts and person summary of a study."""
    codes = resolve_codes(tables, sets)
    group = index_group(tables, codes, windows)
    cohort = build_cohort(tables, group.rows, codes.sources, windows, group)
    linked = linked_visits(tables, group.near, codes, windows)
    death_rows = death_table(tables, group.near, codes, windows)
    stays, dead = group.marked(linked), group.marked(death_rows)
    facts = build_day_facts(tables, group.rows, codes, stays, death_rows, windows, group.ids)
    columns = summary.phase_column_lists(codes.sheet_rows, facts.columns)
    people = summary.person_summary(cohort, facts, stays, dead, columns)
    return StudyResult(codes, cohort, linked, death_rows, facts, people)


OUTPUTS = ["cohort", "linked", "deaths", "day_facts", "person_summary"]


def write_outputs(tables: StudyTables, sets: CodeSets, windows: Windows, folder: str) -> dict[str, DataFrame]:
    """Write every output table to ``folder/<name>`` as parquet and return them as written.

    Each table is built from the written ones before it, so every event table is scanned for the
    day merge once. Copies of other tables that were needed on the way are removed at the end.
    """
    spark = tables.person.sparkSession

    def written(name: str, df: DataFrame) -> DataFrame:
        write_table(df, folder, name)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    with scratch(spark):
        codes = resolve_codes(tables, sets)
        group = index_group(tables, codes, windows)
        cohort = written("cohort", build_cohort(tables, group.rows, codes.sources, windows, group))
        linked = written("linked", linked_visits(tables, group.near, codes, windows))
        death_rows = written("deaths", death_table(tables, group.near, codes, windows))
        stays, dead = group.marked(linked), group.marked(death_rows)
        facts = written("day_facts", build_day_facts(tables, group.rows, codes, stays, death_rows, windows, group.ids))
        columns = summary.phase_column_lists(codes.sheet_rows, facts.columns)
        people = written("person_summary", summary.person_summary(cohort, facts, stays, dead, columns))
    return dict(zip(OUTPUTS, (cohort, linked, death_rows, facts, people)))


def output_sizes(outputs: dict[str, DataFrame]) -> DataFrame:
    """Per output table: rows, persons, and the sum of its person ids; one aggregate over all of them."""
    spark = next(iter(outputs.values())).sparkSession
    # a row for every table, counted as none, so that an empty one is listed
    named = spark.createDataFrame([(name, None, 0) for name in outputs], f"output string, {PERSON} long, rows int")
    rows = [df.select(F.lit(name).alias("output"), F.col(PERSON).cast("long"), F.lit(1).alias("rows")) for name, df in outputs.items()]
    return reduce(DataFrame.unionByName, [named, *rows]).groupBy("output").agg(
        F.sum("rows").alias("n"), F.countDistinct(PERSON).alias("persons"), F.coalesce(F.sum(PERSON), F.lit(0)).alias("person_sum"),
    )
