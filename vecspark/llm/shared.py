"""Helpers shared by the training-data operators: stage tables and numpy kernels."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.store import Stage, shared_dir

__all__ = ["Stage", "shared_dir"]

#: White space that separates words: space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of text that a Python task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

#: Rows up to which a side of (id, small value) rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


_LIBC = ctypes.CDLL(None)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, of rows of a few numbers, marked for broadcast if it is counted to have few enough rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def uniform(key, seed: int, cells: int = 1 << 30):
    """A column in [0, 1) that depends on ``key`` and ``seed`` alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(cells)) / F.lit(float(cells))


# --- batches of texts as bytes -------------------------------------------------


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column (null: empty) and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _release() -> None:
    """Gives freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def sliced(batches, column: str, most: int = SLICE_BYTES):
    """The record batches again in pieces of about ``most`` bytes of text."""
    for batch in batches:
        _release()
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes, dtype=np.int64) - 1) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    _release()


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20_231).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("r", ())) < max(n, 1):
        m = max(n, 1 << 16)
        for k, base in (("r", _R), ("inv", _RINV)):
            a = np.empty(m, np.uint64)
            a[0], have = 1, 1
            while have < m:  # doubling: a[have:2 have] = a[:have] * base ** have
                step = np.uint64(pow(int(base), have, 1 << 64))
                take = min(have, m - have)
                a[have : have + take] = a[:take] * step
                have += take
            _powers[k] = a
    return _powers["r"][:n], _powers["inv"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit hashes (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """S with S[i] = sum of t(data[k]) r^k for k < i, modulo 2^64."""
    r, _ = _power(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * r, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends] that depend on these bytes alone."""
    _, inv = _power(len(sums))
    return mixed((sums[ends] - sums[starts]) * inv[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a batch, and n + 1 offsets of the rows' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = _SPACE[data]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = ~gap[edge]
    last[edge - 1] = ~gap[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items at each of len(h) - n + 1 places."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    r, inv = _power(len(h) + 1)
    np.cumsum(h * r[: len(h)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * inv[: len(h) - n + 1])


def sliding(a: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or what ``pick`` takes) of ``width`` neighbours from each place on."""
    if len(a) < width:
        return a[:0]
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
