"""Whole columns of text as byte arrays, and hashes of their words.

The Python tasks of this package work on Arrow buffers: the texts of a batch lie end to end in
one byte array, and every step (word borders, word hashes, shingles) is a handful of numpy
passes over that array. A chunk holds whole texts, at most ``CHUNK`` bytes unless one text alone
is longer, so memory follows the chunk, not the partition.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 512 << 10
BATCH = 8 << 20
U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def small_batches(df: DataFrame) -> DataFrame:
    """The same plan; batches to Python hold ``BATCH`` bytes, for rows of text are long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _spread(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_STEP) + U(seed))


BYTE_CODE = _spread(256, 7)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = BYTE_CODE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WEIGHTS = _spread(64, 11) | U(1)


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, ``n`` of each at least."""
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = _powers(max(CHUNK + 2, n + n // 4))
    return _TABLES


def release() -> None:
    """Give freed memory back at the end of a task: workers are used again, and several of them
    share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(batches: Iterator) -> Iterator:
    """A task's batches, and ``release`` after the last."""
    yield from batches
    release()


class Rolling:
    """Prefix hashes of a byte or code array; ``of(starts, ends)`` hashes any stretches."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(codes * up[:len(codes)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts]
                   + (ends - starts).astype(U) * U(_STEP))


def chunks(column: pa.Array, limit: int = CHUNK,
           rows: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, row + rows)
        yield row, data[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs without ASCII white space)."""
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[:-1][offs[:-1] < len(buf)]
    first[cuts] = inside[cuts]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z folded, and its row number."""
    starts, ends, row = words(buf, offs)
    return Rolling(FOLDED_CODE[buf]).of(starts, ends), row


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = h[:n] * WEIGHTS[0]
    for i in range(1, k):
        g = g + h[i:i + n] * WEIGHTS[i]
    return mix(g + U(k))
