"""Arrow batches as numpy arrays of UTF-8 bytes, words and word hashes."""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20

_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, size=(64, 256), dtype=np.uint64)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def release() -> None:
    """Give memory that is free but still held back to the system; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` of batches, with memory released after each batch and at the end."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(released(batches))
        finally:
            release()

    return run


def lean_group(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``function`` of a group, with memory released after a large one."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            if table.nbytes >= PIECE_BYTES:
                release()

    return run


def lean_cogroup(function: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``function`` of two groups, with memory released after large ones."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            if left.nbytes + right.nbytes >= PIECE_BYTES:
                release()

    return run


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with about ``limit`` bytes in ``column`` each."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and where each row starts (one entry more than rows). Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _UPPER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``word_bytes`` (a mask of 256); words don't reach across rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = word_bytes[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    joined = inside[1:] & inside[:-1] & ~cut[1:-1]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], joined)))
    ends = np.flatnonzero(inside & ~np.concatenate((joined, [False]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hashes of byte spans that don't overlap and are in order."""
    lengths = ends - starts
    upto = np.cumsum(lengths)
    total = int(upto[-1]) if len(upto) else 0
    place = np.arange(total) - np.repeat(upto - lengths, lengths)
    values = _TABLE[place & 63, data[np.repeat(starts, lengths) + place]]
    if total and int(lengths.max()) > 64:
        values = values * (2 * (place >> 6) + 1).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return mixed(sums[upto] - sums[upto - lengths] + lengths.astype(np.uint64))
