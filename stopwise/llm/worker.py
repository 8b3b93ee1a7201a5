"""Memory of Python workers: what a task needed is given back when the task ends.

Workers are reused by later stages, whose own needs come on top of what earlier ones leave behind.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc

Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Return free memory of Python, Arrow and the C heap to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run: Callable[[Batches], Batches], *forget: Callable[[], None]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, which empties caches by the calls ``forget`` and trims memory at the end of a task."""

    @wraps(run)
    def bounded(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            for clear in forget:
                clear()
            trim()

    return bounded


#: Bytes of text that a worker handles at a time; a longer text is taken alone.
SLICE_BYTES = 1_000_000


def sliced(batches: Batches, column: int = 1, limit: int = SLICE_BYTES) -> Batches:
    """Batches cut by the bytes of a text column, whose rows may be of very different length."""
    for batch in batches:
        first, held = 0, 0
        for row, size in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if held and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)
