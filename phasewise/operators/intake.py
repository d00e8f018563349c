"""From raw event and person tables to the rows a study needs."""

from pyspark.sql import DataFrame, functions as F

from phasewise.functions.sizing import bounded
from phasewise.names import CONCEPT, DATE, EXTRACTION, PARTNER, PERSON, SAMPLE_SEED
from phasewise.functions.dates import plausible

PERSON_COLUMNS = [
    PERSON, "year_of_birth", "month_of_birth", "day_of_birth",
    "ethnicity_concept_name", "race_concept_name", "sex", "location_id", PARTNER,
]
_BUCKETS = 1 << 32


def dated_events(
    events: DataFrame, date_col: str, concept_col: str, extra: dict[str, str] | None = None
) -> DataFrame:
    """Project an event table to (person, date, concept, ...) and drop undated rows.

    ``extra`` maps further source columns to their output names.
    """
    return events.where(F.col(date_col).isNotNull()).select(
        PERSON,
        F.col(date_col).alias(DATE),
        F.col(concept_col).alias(CONCEPT),
        *[F.col(source).alias(name) for source, name in (extra or {}).items()],
    )


def in_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of cohort persons."""
    return df.join(cohort.select(PERSON), PERSON, "left_semi")


def cohort_ids(cohort: DataFrame) -> DataFrame:
    """The cohort's ids, marked for broadcast if they are small enough."""
    return bounded(cohort.select(PERSON))


def early_cohort_filter(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Raw rows of cohort persons, cut before anything is built from them.

    With marked ids no row moves. Beyond that size the semi join shuffles the projected rows
    by person, adaptive execution splits a person with very many of them, and the aggregate per
    person and day that follows sees cohort rows only.
    """
    return df.join(ids, PERSON, "left_semi")


def occurrence_intake(
    events: DataFrame,
    cohort: DataFrame,
    date_col: str,
    concept_col: str,
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """Dated events of cohort persons under common column names."""
    rows = dated_events(events, date_col, concept_col, extra)
    return early_cohort_filter(rows, cohort_ids(cohort))


def person_sample(person: DataFrame, fraction: float = 1.0, seed: int = SAMPLE_SEED) -> DataFrame:
    """Distinct persons, or a fixed pseudo-random share of them.

    The share is taken by the first 32 bits of the MD5 of ``<seed>:<id>``: the same persons come out
    however the table is partitioned and whatever engine takes it, and all rows of a person stay together.
    """
    people = person.withColumnRenamed("gender_concept_name", "sex").select(*PERSON_COLUMNS)
    if fraction < 1.0:
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(PERSON).cast("string")))
        draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
        people = people.where(draw < F.lit(int(fraction * _BUCKETS)))
    return people.distinct()


def dimension_dedup(dimension: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by the other columns, in column order."""
    rest = [c for c in dimension.columns if c != key]
    return (
        dimension.groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("row"))
        .select(key, *[F.col("row")[c].alias(c) for c in rest])
    )


def locations(location: DataFrame) -> DataFrame:
    chosen = dimension_dedup(location.select("location_id", "city", "state", "zip", "county"), "location_id")
    return chosen.withColumnRenamed("zip", "postal_code")


def normalize_shift_days(manifest: DataFrame) -> DataFrame:
    """Shift text with '' and 'na' as '0', and the same as integer (null if not a number)."""
    raw = F.col("max_num_shift_days")
    text = F.when(raw == "", F.lit("0")).otherwise(F.regexp_replace(F.lower(raw), "na", "0"))
    return manifest.withColumn("max_num_shift_days", text).withColumn(
        "shift_days", F.col("max_num_shift_days").try_cast("int")
    )


def source_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest under output names, extraction date as a date (C15)."""
    return normalize_shift_days(manifest).select(
        PARTNER,
        F.col("run_date").cast("date").alias(EXTRACTION),
        "cdm_name", "cdm_version", "shift_date_yn", "max_num_shift_days", "shift_days",
    )


def plausible_dates(
    df: DataFrame, sources: DataFrame, date_col: str, floor: str, horizon_days: int
) -> DataFrame:
    """Rows dated from the floor up to the source's extraction date plus the horizon.

    ``sources`` is the ``source_manifest``; rows of other sources drop out.
    """
    return (
        df.join(sources.select(PARTNER, EXTRACTION), PARTNER)
        .where(plausible(date_col, EXTRACTION, floor, horizon_days))
        .select(*df.columns)
    )
