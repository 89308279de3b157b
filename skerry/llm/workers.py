"""How a Python worker gives memory back between tasks, and the one bounded thing that it may keep for the next of its job."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: dict[str, object] = {}


def kept(job: str, make: Callable[[], object]) -> object:
    """An object of bounded size for all tasks of a job that this worker runs, so that its cache stays warm.

    A task of another job drops it, and Spark ends workers that are idle for a minute."""
    if job not in _kept:
        free()
        _kept[job] = make()
    return _kept[job]


def free() -> None:
    """Drop what an earlier job kept, and return unused memory to the system."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, in a worker that gives back what earlier tasks have left and, also after an error, what this one took."""

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        try:
            yield from run(batches)
        finally:
            free()

    return begun
