"""Memory of Python workers, which Spark keeps for later tasks and stages, and of what is sent to them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame

from sqlcurate.sources import storage

#: Bytes of a batch that goes to a Python worker. Spark's 64 MB, or 10,000 rows, are whole partitions of texts, which an
#: executor holds several times for each task: as Arrow's buffers, as what is sent, and as what Python has read.
BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def give_back() -> None:
    """Returns freed memory to the system; allocators keep it otherwise, beside what the next stage's workers take."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def giving_back(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that gives memory back at the end."""

    @wraps(function)
    def run(parts: Iterator) -> Iterator:
        yield from function(parts)
        give_back()

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows read back from a written table, for which Python workers get small batches."""
    return stored_parts([df], name)


def stored_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    return storage.stored_parts(parts, name, {BATCHES: BATCH_BYTES})
