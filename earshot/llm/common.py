"""What the text operators share: stored tables, and how texts split into words and words into hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from earshot.sources.store import shared_folder, stored  # noqa: F401

#: The bytes that separate words (space, tab, line feed, vertical tab, form feed, carriage return).
SEPARATORS = b" \t\n\x0b\x0c\r"


def pieces(batches: Iterable[pa.RecordBatch], column: str | int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of at most ``size`` bytes of ``column`` (one row at least), so that a task's memory does not follow the batch size."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(int(np.searchsorted(ends, size + (ends[a - 1] if a else 0), "right")), a + 1)
            yield batch.slice(a, b - a)
            a = b


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_SEPARATOR[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


_VALUES = _byte_values()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_PIECE = 1 << 19


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, _PIECE), powers(_INVERSE, _PIECE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from running sums over the bytes, with no loop over words; works in pieces to stay in cache."""
    out = np.empty(len(starts), np.uint64)
    up, down = _tables()
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(int(np.searchsorted(ends, low + _PIECE, "right")), at + 1)
            high = ends[to - 1]
            if high - low > _PIECE:  # one word that is longer than a piece
                up, down = powers(_BASE, high - low), powers(_INVERSE, high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_VALUES[data[low:high]] * up[: high - low], out=sums[1:])
            a, b = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            at = to
    return out


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values (``len(values) - width + 1`` of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += values[k : k + n]
    return mix(out)
