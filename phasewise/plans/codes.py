"""Code sets and sheet of a study, resolved once."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from phasewise.functions.lineage import cut_bounded
from phasewise.names import CONCEPT, DEATH, DOMAINS, DOSE, LAB_FLAGS
from phasewise.operators import codesets, intake
from phasewise.plans.study import CodeSets
from phasewise.sources.tables import StudyTables


# Rows of the merged sheet: each names an output column.
MAX_SHEET_ROWS = 100_000


@dataclass(frozen=True)
class StudyCodes:
    """What every step needs to know about concepts.

    ``roles`` and ``words`` have one row per concept (and domain) the study names, ``sources`` one
    per source; they are written once and their sizes are known from the writing. ``sheet_rows`` is the sheet itself: it names the output columns.
    """

    sheet: DataFrame
    sheet_rows: list[Row]
    roles: DataFrame
    words: DataFrame
    sources: DataFrame
    indicators: list[str]

    def ids(self, role: str) -> DataFrame:
        return self.roles.where(F.col(role)).select(CONCEPT)

    def domain_indicators(self, domain: str) -> list[str]:
        return _indicators([r for r in self.sheet_rows if domain in (r["domain"] or "")])


def _indicators(rows: list[Row]) -> list[str]:
    return sorted({r[codesets.INDICATOR] for r in rows if r[codesets.INDICATOR]})


def resolve_codes(tables: StudyTables, sets: CodeSets) -> StudyCodes:
    merged = codesets.merge_sheets(tables.required_sheet, tables.custom_sheet)
    merged = merged.select(codesets.SET_NAME, codesets.INDICATOR, "domain", "pre_during_post")
    # the sheet names the output columns, so the driver must know it; a larger one is an error
    rows = merged.limit(MAX_SHEET_ROWS + 1).collect()
    if len(rows) > MAX_SHEET_ROWS:
        raise ValueError(f"the sheets have more than {MAX_SHEET_ROWS} rows")
    sheet = merged.sparkSession.createDataFrame(rows, merged.schema)
    fixed = [DOSE, *LAB_FLAGS, DEATH]
    indicators = fixed + [i for i in _indicators(rows) if i not in fixed]
    pairs = codesets.domain_indicator_map(tables.concept_sets, sheet, DOMAINS)
    return StudyCodes(
        sheet=sheet,
        sheet_rows=rows,
        roles=cut_bounded(codesets.concept_roles(tables.concept_sets, sets.roles())),
        words=cut_bounded(codesets.indicator_words(pairs, indicators)),
        sources=cut_bounded(intake.source_manifest(tables.manifest)),
        indicators=indicators,
    )
