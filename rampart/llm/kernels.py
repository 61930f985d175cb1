"""Vectorised text kernels over Arrow string columns: segmentation and polynomial hashes of words and word windows.

Hashes are prefix sums of ``value * base**position`` modulo 2**64. An odd base has an inverse, so the hash of any
span is one subtraction and one product, whatever its length; a final mix spreads the bits.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """base**i for i < n, kept and enlarged on demand."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, (INVERSES if inverse else BASES)[which], dtype=U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if size <= 4 * CHUNK_BYTES:
            _powers[which, inverse] = have
    return have[:n]


#: What modules keep between the batches of a task, as functions that empty it.
forget: list[Callable[[], object]] = [_powers.clear]


def _release() -> None:
    for f in forget:
        f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


Task = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Task, cycles: bool = True) -> Task:
    """``run`` as the body of a task: at its end caches are emptied and free memory goes back to the system, as a
    worker process outlives its tasks, and what an idle one keeps counts against its executor.

    Without ``cycles`` nothing looks for reference cycles meanwhile, which is slow where caches hold many strings.
    """

    @functools.wraps(run)
    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = gc.isenabled()
        if not cycles:
            gc.disable()
        try:
            yield from run(batches)
        finally:
            if on:
                gc.enable()
            _release()

    return body


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=U)
    out[0] = 0
    np.cumsum(values * powers(which, False, len(values)), out=out[1:], dtype=U)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed hash of the spans [start, end), equal for equal values wherever they stand."""
    inv = powers(which, True, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array, without copying."""
    column = strings(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), at


def slices(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of groups of rows of about ``size`` bytes of text; a longer row stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, n = 0, len(ends)
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(ends, before + size, side="right")), lo + 1), n)
        yield lo, hi
        lo = hi


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of groups of rows of about ``size`` bytes, lower-cased if asked for.
    Only one group at a time is copied."""
    for lo, hi in slices(column, size):
        part = strings(column.slice(lo, hi - lo))
        data, at = raw(pc.utf8_lower(part) if lower else part)
        yield lo, hi, data[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of all rows, and each row's first word (one more entry than rows)."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(at), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hash(prefix_hash(data.astype(U) + U(1), which), starts, ends, which)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
