"""What a Python worker holds between tasks.

Spark reuses workers: what one operator leaves behind is still there when the next one runs.  Operators wrap their
functions in ``tidy``: a task drops the caches of other operators when it begins and gives free memory back to the
system when it ends.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Cache name -> how to empty it.
_caches: dict[str, Callable[[], None]] = {}


def cache(name: str, empty: Callable[[], None]) -> None:
    """Names a cache of this process; tasks that don't keep it empty it."""
    _caches[name] = empty


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable:
    """``run`` for ``mapInArrow``, with only the cache ``keep`` left from earlier tasks and memory given back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in _caches if n != keep]:
            _caches.pop(name)()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def sliced(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``rows``, and of about ``size`` bytes in one string or binary column: what is
    made of a slice is bounded, whatever Spark puts into a batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            yield batch
            continue
        step = max(1, min(rows, n * size // max(1, batch.column(column).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
