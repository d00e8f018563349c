"""SQL over study tables by name."""

from pyspark.sql import DataFrame


def over(tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """The result of a statement that names its tables in braces: ``select ... from {cohort}``.

    Columns may be grouped or ordered by their position. The names live for this statement
    only, so tables of several studies cannot mix.
    """
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(statement, **tables)
