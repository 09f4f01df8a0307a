"""Python work on Arrow batches in slices.

Spark bounds a batch by its bytes in Arrow; as Python strings, with what is made of them, it takes many times that. Work goes over slices of a few megabytes, and what
was made of one leaves for Spark before the next is read, so a worker holds its batch and little more however large tables, batches and rows' results are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: A slice has about so many bytes in Arrow, and one row at least.
SLICE_BYTES = 2 << 20


def give_back() -> None:
    """Returns memory that a worker has freed to the system, where the C library can: what one block or batch needed would else stay with
    the worker while it waits for other stages, beside all that those need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def row_bytes(values: pa.Array) -> np.ndarray:
    """About how many bytes each row of texts, bytes or lists of them has."""
    if pa.types.is_list(values.type):
        total = np.concatenate([[0], np.cumsum(row_bytes(values.values))])
        return np.diff(total[values.offsets.to_numpy()]) + 8
    if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
    return np.full(len(values), 8, np.int64)


def spans(values: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of at most ``most`` bytes, or of one row; one empty slice of no rows."""
    ends, begin = np.cumsum(row_bytes(values)), 0
    if not len(values):
        yield 0, 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, end - begin
        begin = end


def over_slices(batches: Iterator, by: str | None = None) -> Iterator:
    """The slices of all arrays, or of all record batches by the bytes of their column ``by``; memory is given back after each batch."""
    for batch in batches:
        for begin, n in spans(batch if by is None else batch.column(by)):
            yield batch.slice(begin, n)
        batch = None
        give_back()


def mapped(work: Callable, kind: DataType | str, arrow: pa.DataType):
    """An Arrow function of one column: ``work`` on each of its values."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in over_slices(batches):
            made, part = pa.array(map(work, part.to_pylist()), arrow), None
            yield made

    return run
