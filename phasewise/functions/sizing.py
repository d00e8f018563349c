"""Broadcast only what has been measured.

Dimension-like frames are marked where they are made; Spark carries the mark through the
filters and projections on the way to a join, so it is measured once however often it is used.
"""

from pyspark.sql import Column, DataFrame, functions as F

MAX_BROADCAST_BYTES = 128 << 20
# Bytes of a row beside its values, and of a value of fixed size.
ROW_BYTES, VALUE_BYTES = 16, 8


def row_bytes(df: DataFrame) -> Column:
    """About what one row takes in memory: fixed sizes from the schema, lengths from the data."""
    fixed = F.lit(ROW_BYTES + VALUE_BYTES * len(df.columns))
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary") or kind.startswith(("varchar", "char")):
            fixed = fixed + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            fixed = fixed + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return fixed.cast("long")


def bounded(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its rows take at most ``max_bytes``.

    The bytes are summed, not estimated. A larger side is returned unmarked: Spark then
    shuffles the join and splits hot keys at run time.
    """
    return F.broadcast(df) if fits(df, max_bytes) else df


def fits(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes
