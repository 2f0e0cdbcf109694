"""Arrow string columns as flat NumPy arrays, for functions that work on all rows of a batch at once.

Spark cuts batches by bytes; ``row_blocks`` cuts them further, so that what a kernel makes on the way stays
a small multiple of BLOCK_BYTES, or of a single longer row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the rows' bounds in them; null rows are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``views``, with one byte for each character: of others than ASCII the first."""
    flat, bounds = views(column)
    if len(flat) and flat.max() >= 128:
        keep = (flat & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        flat = flat[keep]
    return flat, bounds


def row_blocks(bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of about ``most`` bytes, one row at least."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        end = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end
        first = end


def places(starts: np.ndarray, sizes: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[i], starts[i] + step ... (sizes[i] of them) for each i, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - step * first, sizes) + step * np.arange(int(sizes.sum()))


def column_of(flat: np.ndarray, sizes: np.ndarray, null: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    """A string or binary column from its bytes and row sizes."""
    large = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}[kind]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    mask = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(large, len(sizes), [mask, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat, np.uint8))]).cast(kind)


def nulls(*columns: pa.Array) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out |= c.is_null().to_numpy(zero_copy_only=False)
    return out
