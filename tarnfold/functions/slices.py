"""Arrow batches in parts of bounded size, so that a Python worker holds the objects of one part at a time, however large its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa


def slices(batch: pa.RecordBatch, rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and bytes; a single row may be larger."""
    n = batch.num_rows
    if n > rows or (n > 1 and batch.nbytes > size):
        yield from slices(batch.slice(0, n // 2), rows, size)
        yield from slices(batch.slice(n // 2), rows, size)
    elif n:
        yield batch


def each(values: pa.Array, function: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """function of each value, null or not, part by part."""
    parts = [pa.array([function(v) for v in part.column(0).to_pylist()], kind) for part in slices(pa.RecordBatch.from_arrays([values], ["v"]))]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
