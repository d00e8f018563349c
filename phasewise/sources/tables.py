"""Input tables and reading or writing them."""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class StudyTables:
    """Source tables of a cohort study; columns as listed in FIXTURES.md section 1.1."""

    person: DataFrame
    measurement: DataFrame
    condition_occurrence: DataFrame
    device_exposure: DataFrame
    drug_exposure: DataFrame
    observation: DataFrame
    procedure_occurrence: DataFrame
    visits: DataFrame
    death: DataFrame
    vaccine_doses: DataFrame
    location: DataFrame
    manifest: DataFrame
    concept_sets: DataFrame
    required_sheet: DataFrame
    custom_sheet: DataFrame


def read_study(spark: SparkSession, folder: str) -> StudyTables:
    """Read every table from ``folder/<table name>`` as parquet."""
    return StudyTables(
        **{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(StudyTables)}
    )


def write_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
