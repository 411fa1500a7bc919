"""Views of Arrow string columns as one byte vector, for work inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Base code of each byte: A, C, G, T are 0 to 3, anything else 4.
BASE = np.full(256, 4, np.uint8)
BASE[[65, 67, 71, 84]] = range(4)


#: Bytes of a chunk, but for a single row that is longer.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterable[pa.RecordBatch], rows: int, size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from the batches, fewer where rows are long: what a
    task holds at once is bounded by ``size`` bytes or by its longest row."""
    held, n, total = [], 0, 0
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            if n and (n + part.num_rows > rows or total + part.nbytes > size):
                yield pa.Table.from_batches(held)
                held, n, total = [], 0, 0
            held.append(part)
            n += part.num_rows
            total += part.nbytes
    if n:
        yield pa.Table.from_batches(held)


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row and the n+1 offsets; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = pa.concat_arrays(filled.chunks) if filled.num_chunks else pa.array([], pa.large_string())
    _, at, data = filled.buffers()
    offsets = np.frombuffer(at, np.int64, len(filled) + 1, filled.offset * 8) if len(filled) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings ``data[start:end]`` as an Arrow column."""
    size = np.maximum(end - start, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row that each byte of ``flat`` belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of k bases A, C, G, T starts within one row, and its rows."""
    if len(data) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = owners(offsets)
    bad = np.concatenate([[0], np.cumsum(BASE[data] > 3)])
    start = np.flatnonzero((bad[k:] == bad[:-k]) & (row[: len(data) - k + 1] == row[k - 1 :]))
    return start, row[start]


def codes(data: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """The k <= 31 bases from each start as a number of two bits a base."""
    base, out = BASE[data], np.zeros(len(start), np.int64)
    for j in range(k):
        out = (out << 2) | base[start + j]
    return out
