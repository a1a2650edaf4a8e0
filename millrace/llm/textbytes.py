"""Vectorised word handling on the UTF-8 bytes of Arrow string columns.

Every function works on a *slice*: some consecutive rows whose texts lie in one byte array,
with the offsets of the rows in it. White space here is 0x20 and 0x09-0x0D, all ASCII, so
words can be cut out of the bytes without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Masks that keep the first k bytes of eight, the least significant ones.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STARTS = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64)


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for 2**log_size places."""
    n = 1 << log_size
    with np.errstate(over="ignore"):
        up = np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]).cumprod(dtype=np.uint64)
        down = np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]).cumprod(dtype=np.uint64)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(18, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``, none of them across rows, and for each row the index of its first run (one more at the end)."""
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(inside)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    return spans(~SPACE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they lie.

    Eight bytes at a time are mixed into the hash of those before (no sum of powers, whose collisions
    modulo 2**64 are known for long spans); each round works on the spans that are long enough for it.
    """
    size = (ends - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))  # at every byte

    def step(held: np.ndarray, at: np.ndarray, left: np.ndarray, done: int) -> np.ndarray:
        part = eight[at] & _HEADS[np.minimum(left, 8)]
        with np.errstate(over="ignore"):
            x = (held ^ part) * _BASE + np.uint64(done + 1)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(32))

    out = step(_STARTS[seed] ^ size.astype(np.uint64), starts, size, 0)
    active, done = np.flatnonzero(size > 8), 8
    while len(active):
        left = size[active] - done
        out[active] = step(out[active], starts[active] + done, left, done)
        done += 8
        active = active[left > 8]
    return mix(out)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values (callers drop the runs that cross rows).

    A sum of powers modulo 2**64, for n up to a few hundred; below 1024 values it has no collisions by construction.
    """
    if len(values) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=prefix[1:])
        at = np.arange(len(values) - n + 1)
        return mix((prefix[at + n] - prefix[at]) * down[at] + np.uint64(n))


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_grams(first: np.ndarray, n: int) -> np.ndarray:
    """The word indexes at which a run of ``n`` words of one row starts."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    return spread(first[:-1], count)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] values for each i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return jump + np.arange(total)


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(length: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``length`` places lie in a run of ``width`` from one of ``starts``."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, length), -1)
    return np.cumsum(steps)[:-1] > 0
