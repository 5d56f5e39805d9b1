"""Memory of the Python workers, which outlive the tasks and operators that they serve."""

import ctypes
import gc

import pyarrow as pa

# Bytes of an Arrow batch that are turned into Python objects at a time.
SLICE = 4 << 20

#: Functions that empty the stores which modules keep from task to task.
_stores: list = []
_operator = None


def store(clear) -> None:
    """Register what empties a store when another operator takes over the worker."""
    _stores.append(clear)


def enter(operator: str) -> None:
    """Empty the stores of earlier operators; tasks of one operator share theirs."""
    global _operator
    if operator != _operator:
        for clear in _stores:
            clear()
        release()
        _operator = operator


def release() -> None:
    """Give unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def sliced(batches, size: int = SLICE):
    """Arrow batches cut into slices of about `size` bytes."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
