"""Day arithmetic used by several operators."""

from pyspark.sql import Column, functions as F


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(later, earlier)


def plausible(date: str | Column, extraction: str | Column, floor: str, horizon_days: int) -> Column:
    """From ``floor`` up to, not including, the extraction date plus the horizon."""
    date = F.col(date) if isinstance(date, str) else date
    return (date >= F.lit(floor).cast("date")) & (date < F.date_add(extraction, horizon_days))


def within(days: Column, window: tuple[int, int]) -> Column:
    return days.between(*window)


def whole_years(later: str | Column, earlier: str | Column) -> Column:
    return F.floor(F.months_between(later, earlier, roundOff=False) / 12).cast("long")


def mask(condition: Column, value: str | Column) -> Column:
    """``value`` where the condition holds, else null."""
    return F.when(condition, F.col(value) if isinstance(value, str) else value)
