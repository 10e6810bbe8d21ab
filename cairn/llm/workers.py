"""Memory of Python workers: what a task no longer needs goes back to the system.

Workers outlive their tasks and share a machine with the JVM; freed arrays otherwise
stay in the allocators' pools until the worker ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions over a task's batches."""
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def releasing_group(run: Callable) -> Callable:
    """For functions of a group's table, or of two; keeps the number of arguments, by which Spark tells whether a key is wanted."""
    def one(table):
        out = run(table)
        release()
        return out

    def two(left, right):
        out = run(left, right)
        release()
        return out

    return two if run.__code__.co_argcount == 2 else one
