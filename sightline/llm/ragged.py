"""Whole-batch text kernels: words, hashes and segment sums over the byte buffer of an Arrow string column."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sightline.runtime import bound_batches

#: Bytes of text worked on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240117).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to the n-th; those for a longer text than most aren't kept."""
    if not _POW or len(_POW[0]) < n + 1:
        up, down = (np.full(max(n + 1, 1 << 16), m, np.uint64) for m in (_MULT, _INV))
        up[0] = down[0] = 1
        made = [np.cumprod(up), np.cumprod(down)]
        if n > 2 * CHUNK_BYTES:
            return made[0], made[1]
        _POW[:] = made
    return _POW[0], _POW[1]


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give memory that is free in this process back to the system: workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library keeps what it keeps


def released(work: Work) -> Work:
    """work, with the worker's free memory given back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def map_batches(df: DataFrame, work: Work, schema: StructType | str) -> DataFrame:
    """df.mapInArrow() in batches of bounded bytes, with the worker's free memory given back when a task ends."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(released(work), schema)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold about `most` bytes; a single longer row is a slice."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b[text]), 0), dtype=np.int64)
        at, n = 0, len(sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        while at < n:
            end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into them) of the runs of bytes other than ASCII white space."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    rows = offs[:-1][offs[:-1] < len(data)]
    first[rows] = solid[rows]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = solid[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial over randomised byte values."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs inside each row and the row offsets into them; rows with fewer words have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g = g * np.uint64(_MULT) + h[k : k + m]
    counts = np.maximum(np.diff(rows) - n + 1, 0)
    to = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(rows[:-1] - to[:-1], counts) + np.arange(to[-1])
    return mix(g[at]), to


def owner(rows: np.ndarray) -> np.ndarray:
    """For each item the row that holds it, from row offsets."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values over each row's run of items; empty rows give 0."""
    return np.bincount(owner(rows), weights=values, minlength=len(rows) - 1).astype(np.float64)


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each byte span of valid UTF-8."""
    total = np.concatenate([[0], np.cumsum(_LEAD[data])])
    return total[ends] - total[starts]


def take_runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1 of all runs, one after another."""
    to = np.cumsum(counts) - counts
    return np.repeat(starts - to, counts) + np.arange(int(counts.sum()))
