"""Day facts to one row per person, by phase."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from phasewise.functions import flags
from phasewise.functions.dates import days_between, mask
from phasewise.functions.sql import over
from phasewise.names import (
    BMI, BMI_POST, BMI_PRE, CRITICAL_CARE, DEATH, DEATH_ANY, DEATH_IN_WINDOW,
    DOSE, DOSES_POST, DOSES_PRE, FIRST_DX, FIRST_LAB, IN_STRONG_STAY, IN_WEAK_STAY,
    LENGTH_OF_STAY, PERSON, PHASE_EXTRAS, PHASE_SUFFIX, POST, PRE, REINFECTED, REINFECTION,
    SEVERITY, SEVERITY_CLASSES, STRONG_ED, STRONG_END, STRONG_START, WEAK_ED, WEAK_START,
)
from phasewise.operators.codesets import INDICATOR

PHASE_FLAG = {"pre": PRE, "during_strong": IN_STRONG_STAY, "during_weak": IN_WEAK_STAY, "post": POST}
NOT_FILLED = [PERSON, BMI_PRE, BMI_POST, "postal_code", "age_at_covid"]
_NOT_INDICATORS = [BMI, DOSE, REINFECTION]


def phase_columns(sheet: DataFrame, facts: DataFrame) -> DataFrame:
    """(phase, column) rows: what the sheet and the fixed extras ask for and the facts have."""
    per_phase = [
        sheet.where(F.col("pre_during_post").contains(phase))
        .select(F.lit(phase).alias("phase"), F.col(INDICATOR).alias("column"))
        .unionByName(
            sheet.sparkSession.createDataFrame([(phase, c) for c in extras], "phase string, column string")
        )
        for phase, extras in PHASE_EXTRAS.items()
    ]
    return (
        reduce(DataFrame.unionByName, per_phase)
        .where(F.col("column").isin(*facts.columns))
        .distinct()
    )


def phase_column_lists(sheet_rows: list, facts_columns: list[str]) -> dict[str, list[str]]:
    """The same from sheet rows the driver has already read, as sorted lists."""
    lists = {}
    for phase, extras in PHASE_EXTRAS.items():
        named = {r[INDICATOR] for r in sheet_rows if r[INDICATOR] and phase in (r["pre_during_post"] or "")}
        lists[phase] = sorted((named | set(extras)) & set(facts_columns))
    return lists


def _wanted(columns: dict[str, list[str]], phase: str) -> list[str]:
    return columns["during" if phase.startswith("during") else phase]


def _phase_indicators(columns: dict[str, list[str]], phase: str) -> list[str]:
    """Indicators of a phase; the critical-care ones are always there in a stay."""
    names = [c for c in _wanted(columns, phase) if c not in _NOT_INDICATORS]
    if phase.startswith("during"):
        names += [c for c in CRITICAL_CARE if c not in names]
    return names


def _phase_values(columns: dict[str, list[str]], phase: str) -> list[Column]:
    """Aggregates of a phase that are not indicators."""
    if phase not in ("pre", "post"):
        return []
    inside = F.col(PHASE_FLAG[phase]) == 1
    pre = phase == "pre"
    values = [F.max(mask(inside, BMI)).alias(BMI_PRE if pre else BMI_POST)]
    if DOSE in _wanted(columns, phase):
        values.append(F.sum(mask(inside, F.col(DOSE).cast("long"))).alias(DOSES_PRE if pre else DOSES_POST))
    if not pre:
        values.append(F.max(mask(inside, REINFECTION)).alias(REINFECTED))
    return values


def _rollup(facts: DataFrame, columns: dict[str, list[str]], phases: list[str], extra: list[Column]) -> DataFrame:
    """All phases in one aggregate per person; indicators as one bit word set per phase."""
    indicators = sorted({c for phase in phases for c in _phase_indicators(columns, phase)})
    have = facts.columns
    present = {c: F.col(f"`{c}`") for c in indicators if c in have}
    others = [c for c in (*PHASE_FLAG.values(), BMI, DOSE, REINFECTION, DEATH_IN_WINDOW) if c in have]
    packed = facts.select(PERSON, *others, *flags.words(present, indicators))
    merged, read_back = [], []
    for phase in phases:
        for name in flags.word_names(indicators):
            merged.append(F.bit_or(mask(F.col(PHASE_FLAG[phase]) == 1, name)).alias(f"{phase}{name}"))
        read_back += [
            flags.flag(indicators, c, f"{phase}_word").alias(c + PHASE_SUFFIX[phase])
            for c in _phase_indicators(columns, phase)
        ]
        read_back += [F.col(name) for name in _value_names(columns, phase)]
    values = [value for phase in phases for value in _phase_values(columns, phase)]
    grouped = packed.groupBy(PERSON).agg(*merged, *values, *extra)
    extras = [c for c in grouped.columns if c == DEATH_IN_WINDOW]
    return grouped.select(PERSON, *read_back, *extras)


def _value_names(columns: dict[str, list[str]], phase: str) -> list[str]:
    if phase not in ("pre", "post"):
        return []
    doses = [DOSES_PRE if phase == "pre" else DOSES_POST] if DOSE in _wanted(columns, phase) else []
    return [BMI_PRE, *doses] if phase == "pre" else [BMI_POST, *doses, REINFECTED]


def phase_rollup(facts: DataFrame, phase: str, columns: dict[str, list[str]]) -> DataFrame:
    """One phase, for persons with a day in it.

    ``phase`` is pre, during (strong and weak stays side by side) or post.
    """
    phases = ["during_strong", "during_weak"] if phase == "during" else [phase]
    inside = reduce(lambda a, b: a | b, [F.col(PHASE_FLAG[p]) == 1 for p in phases])
    return _rollup(facts.where(inside), columns, phases, [])


def phase_rollups(facts: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """All phases and the death-in-window flag, one row per person of the facts."""
    return _rollup(facts, columns, list(PHASE_FLAG), [F.max(DEATH_IN_WINDOW).alias(DEATH_IN_WINDOW)])


def length_of_stay(df: DataFrame) -> DataFrame:
    return df.withColumn(LENGTH_OF_STAY, days_between(STRONG_END, STRONG_START))


def severity(df: DataFrame) -> DataFrame:
    """First class of the ordered list that applies to the person."""
    def critical(phase: str) -> Column:
        return reduce(
            lambda a, b: a | b, [F.col(c + PHASE_SUFFIX[phase]) == 1 for c in CRITICAL_CARE]
        )

    conditions = {
        "no_index": F.col(FIRST_LAB).isNull() & F.col(FIRST_DX).isNull(),
        "death": F.col(DEATH_IN_WINDOW) == 1,
        "strong_critical": critical("during_strong"),
        "strong_stay": F.col(STRONG_START).isNotNull(),
        "strong_ed": F.col(STRONG_ED).isNotNull(),
        "weak_critical": critical("during_weak"),
        "weak_stay": F.col(WEAK_START).isNotNull(),
        "weak_ed": F.col(WEAK_ED).isNotNull(),
    }
    first, *others = conditions.items()
    classes = F.when(first[1], SEVERITY_CLASSES[first[0]])
    for name, condition in others:
        classes = classes.when(condition, SEVERITY_CLASSES[name])
    return df.withColumn(SEVERITY, classes.otherwise(SEVERITY_CLASSES["none"]))


def fill_numbers(df: DataFrame, keep_null: list[str]) -> DataFrame:
    """0 in place of null in numeric columns but those kept; dates and text stay null.

    Keys must be among those kept: a filled key is a new column, by which Spark shuffles again.
    """
    return df.na.fill(0, subset=[c for c in df.columns if c not in keep_null])


def person_summary(
    cohort: DataFrame,
    facts: DataFrame,
    linked: DataFrame,
    deaths: DataFrame,
    columns: dict[str, list[str]],
) -> DataFrame:
    """One row per cohort person: cohort columns, phase rollups, linked visits, outcome flags."""
    any_death = deaths.select(PERSON, F.col(DEATH).alias(DEATH_ANY))
    joined = (
        cohort.join(phase_rollups(facts, columns), PERSON, "left")
        .join(linked, PERSON, "left")
        .join(any_death, PERSON, "left")
    )
    return severity(fill_numbers(length_of_stay(joined), NOT_FILLED))


def count_by_shift(summary: DataFrame) -> DataFrame:
    """Distinct persons per date-shift flag; null is a group."""
    return over(
        {"person_summary": summary},
        f"select count(distinct {PERSON}) as N, shift_date_yn from {{person_summary}} group by 2",
    ).select("shift_date_yn", "N")
