"""Small helpers of the operators in this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of text worked on at once in a task.
PORTION_CHARS = 1_000_000
#: Rows of an Arrow column turned into Python values at once.
ROWS_AT_ONCE = 200


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def portions(texts: pa.Array, size: int = PORTION_CHARS) -> Iterator[list[str]]:
    """Texts of a column in lists of about so many characters; null counts as empty."""
    part: list[str] = []
    total = 0
    for at in range(0, len(texts), ROWS_AT_ONCE):
        for t in texts.slice(at, ROWS_AT_ONCE).to_pylist():
            part.append(t or "")
            total += len(part[-1])
            if total >= size:
                yield part
                part, total = [], 0
    if part:
        yield part


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal leading ``keys`` columns, from batches sorted by them."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in batch.columns[:keys]:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            own = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_held: list[dict] = []


def hold(memory: dict) -> dict:
    """The only word memory of this worker: another operator's, if there is one, is emptied."""
    if not (_held and _held[0] is memory):
        for other in _held:
            other.clear()
        _held[:] = [memory]
    return memory


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task; when the task ends, what it has freed goes back to the system.

    A Python worker serves many tasks, and its allocators would keep the most that any took.
    """
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = ctypes.CDLL(None)
        if hasattr(system, "mallopt"):  # very large blocks are mapped, and unmapped when freed
            system.mallopt(-3, 8 << 20)
            system.mallopt(-1, 64 << 20)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(system, "malloc_trim"):
                system.malloc_trim(0)
    return tidied
