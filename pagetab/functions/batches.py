"""Arrow batches for tasks that hold little: small ones come in, small ones go out, and memory is given back at the end."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of the batches that Spark hands to a worker, and rows that a worker takes of one at a time.
BATCH_BYTES, ROWS = 4 << 20, 256

Batches = Iterator[pa.RecordBatch]


def batch_limits(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Spark end a batch at ``most`` bytes; a task has several workers, and each of them holds the batch it has and the next."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if int(number) << 10 * "_kmgtp".index(unit or "_") > most:
        spark.conf.set(name, str(most))


def slices(batches: Batches, rows: int = ROWS) -> Batches:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` on slices; what its worker has free goes back to the system when it ends, as Spark keeps the worker."""

    @wraps(run)
    def tidy(batches: Batches) -> Batches:
        yield from run(slices(batches))
        give_back()

    return tidy


def column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """``pa.array(values, kind)`` for texts, bytes, longs, booleans and lists of them.

    ``pa.array`` loads pandas where that is installed, which no task here needs and which
    would take more of each worker than its batches do.
    """
    n = len(values)
    known = np.fromiter((v is not None for v in values), bool, n)
    bits = lambda flags: pa.py_buffer(np.packbits(flags, bitorder="little"))
    valid, rest, children = None if known.all() else bits(known), [], None
    if pa.types.is_boolean(kind):
        rest = [bits(np.fromiter(map(bool, values), bool, n))]
    elif pa.types.is_int64(kind):
        rest = [pa.py_buffer(np.fromiter((v or 0 for v in values), np.int64, n))]
    elif pa.types.is_list(kind):
        parts = [v or () for v in values]
        rest, children = [_ends(parts)], [column([x for v in parts for x in v], kind.value_type)]
    elif pa.types.is_string(kind) or pa.types.is_binary(kind):
        parts = [v.encode() if isinstance(v, str) else v or b"" for v in values]
        rest = [_ends(parts), pa.py_buffer(b"".join(parts))]
    else:
        raise TypeError(f"no column of {kind}")
    return pa.Array.from_buffers(kind, n, [valid, *rest], children=children)


def _ends(parts: Sequence) -> pa.Buffer:
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=ends[1:])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("a batch holds 2 GB at most")
    return pa.py_buffer(ends.astype(np.int32))


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)
