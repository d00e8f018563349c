"""Birth date, age and label groups."""

from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions.dates import whole_years
from phasewise.names import (
    EARLIEST_BIRTH, ETHNICITY_HISPANIC, HISPANIC_ANY_RACE, INDEX, NON_HISPANIC_SUFFIX,
    RACE_MEMBERS, UNKNOWN,
)


def date_of_birth(people: DataFrame, as_of: str, max_shift: Column | int) -> DataFrame:
    """Add ``date_of_birth`` from year, month and day with missing parts filled in.

    Month 7 and day 1 stand in for missing or zero parts. A missing year, an impossible
    date, or one outside [1902-01-01, as_of + max_shift] gives null.
    """
    month = F.coalesce(F.nullif(F.col("month_of_birth"), F.lit(0)), F.lit(7))
    day = F.coalesce(F.nullif(F.col("day_of_birth"), F.lit(0)), F.lit(1))
    born = F.concat_ws(
        "-",
        F.coalesce(F.col("year_of_birth"), F.lit(1)).cast("string"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    ).try_cast("date")
    latest = F.date_add(F.lit(as_of).cast("date"), max_shift)
    return people.withColumn("date_of_birth", born).withColumn(
        "date_of_birth",
        F.when(F.col("date_of_birth").between(F.lit(EARLIEST_BIRTH).cast("date"), latest),
               F.col("date_of_birth")),
    )


def age_at_index(df: DataFrame, index: str = INDEX, alias: str = "age_at_covid") -> DataFrame:
    """Completed years from birth date to index date."""
    return df.withColumn(alias, whole_years(index, "date_of_birth"))


def category_map(
    df: DataFrame,
    source: str,
    groups: dict[str, list[str]],
    default: str,
    alias: str,
    override: tuple[Column, str] | None = None,
) -> DataFrame:
    """Map raw labels to the first group that lists them; ``override`` wins over all groups."""
    rules = [] if override is None else [override]
    rules += [(F.col(source).isin(*members), label) for label, members in groups.items()]
    (condition, label), *others = rules
    mapped = F.when(condition, label)
    for condition, label in others:
        mapped = mapped.when(condition, label)
    return df.withColumn(alias, mapped.otherwise(default))


def race(df: DataFrame) -> DataFrame:
    return category_map(df, "race_concept_name", RACE_MEMBERS, UNKNOWN, "race")


def race_ethnicity(df: DataFrame) -> DataFrame:
    """Race with ethnicity: a Hispanic ethnicity or race label decides, the rest are suffixed."""
    groups = {
        HISPANIC_ANY_RACE if label == ETHNICITY_HISPANIC else label + NON_HISPANIC_SUFFIX: members
        for label, members in RACE_MEMBERS.items()
    }
    hispanic = (F.col("ethnicity_concept_name") == ETHNICITY_HISPANIC, HISPANIC_ANY_RACE)
    return category_map(df, "race_concept_name", groups, UNKNOWN, "race_ethnicity", hispanic)
