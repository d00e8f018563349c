"""0/1 indicator columns packed into 64-bit words.

A study has dozens to hundreds of indicators. Aggregating them one by one makes wide
shuffle rows and aggregates too long to compile; as bits, 64 of them travel in one long
and one ``bit_or`` merges them.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

WORD_BITS = 64


def word_names(flags: list[str], prefix: str = "_word") -> list[str]:
    return [f"{prefix}{i}" for i in range(-(-len(flags) // WORD_BITS))]


def _chunks(flags: list[str]) -> list[list[str]]:
    return [flags[i:i + WORD_BITS] for i in range(0, len(flags), WORD_BITS)]


def words(values: dict[str, Column], flags: list[str], prefix: str = "_word") -> list[Column]:
    """One long per 64 flags; a flag without a column in ``values`` stays 0."""
    none = F.lit(0).cast("long")
    packed = []
    for name, chunk in zip(word_names(flags, prefix), _chunks(flags)):
        bits = [
            F.when(values[flag] > 0, F.lit(_bit(i))).otherwise(none)
            for i, flag in enumerate(chunk) if flag in values
        ]
        packed.append(reduce(Column.bitwiseOR, bits, none).alias(name))
    return packed


def words_by_label(label: str, flags: list[str], prefix: str = "_word") -> list[Column]:
    """The words of one flag whose name is the value of column ``label``."""
    packed = []
    for name, chunk in zip(word_names(flags, prefix), _chunks(flags)):
        whens = " ".join(f"WHEN {_text(flag)} THEN {_bit(i)}L" for i, flag in enumerate(chunk))
        packed.append(F.expr(f"CASE `{label}` {whens} ELSE 0L END").alias(name))
    return packed


def flag(flags: list[str], wanted: str, prefix: str = "_word") -> Column:
    """Read one flag back as int 0/1; null where the word is null."""
    word, bit = divmod(flags.index(wanted), WORD_BITS)
    return F.expr(f"CAST(shiftrightunsigned({word_names(flags, prefix)[word]}, {bit}) & 1L AS INT)")


def unpacked(flags: list[str], prefix: str = "_word") -> list[Column]:
    return [flag(flags, name, prefix).alias(name) for name in flags]


def merged(flags: list[str], prefix: str = "_word") -> list[Column]:
    """Aggregates that merge the words of a group."""
    return [F.bit_or(name).alias(name) for name in word_names(flags, prefix)]


def _bit(position: int) -> int:
    value = 1 << position
    return value - (1 << 64) if position == WORD_BITS - 1 else value


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
