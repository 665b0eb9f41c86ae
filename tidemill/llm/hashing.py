"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time, and rows.
BLOCK, ROWS = 1 << 20, 4096
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed)) | np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, BLOCK + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, one after the other, and where each begins; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), bounds


def row_blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``ROWS`` rows and about ``BLOCK`` bytes, or one longer row."""
    start, n = 0, len(bounds) - 1
    while start < n:
        end = int(np.searchsorted(bounds, bounds[start] + BLOCK, "right")) - 1
        end = min(max(end, start + 1), start + ROWS, n)
        yield start, end
        start = end


def _cuts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of bytes that end where a row ends or before white space."""
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        cut = min(at + BLOCK, end)
        row_end = int(bounds[np.searchsorted(bounds, cut)])
        while cut < row_end:
            space = np.flatnonzero(is_space(data[cut : cut + 4096]))
            if len(space):
                cut += int(space[0])
                break
            cut = min(cut + 4096, row_end)
        yield at, cut
        at = cut


def word_hashes(
    data: np.ndarray, bounds: np.ndarray, lower: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and the row it is in.

    Words are runs of bytes that aren't white space; ``lower`` takes A-Z as a-z.
    """
    hashes, rows = [], []
    for lo, hi in _cuts(data, bounds):
        part = data[lo:hi]
        if lower:
            part = part | (((part >= 65) & (part <= 90)).astype(np.uint8) << 5)
        space = is_space(part)
        breaks = np.empty(len(part) + 1, bool)
        breaks[0] = breaks[-1] = True
        breaks[1:-1] = space[:-1]
        first, last = np.searchsorted(bounds, [lo, hi])
        breaks[bounds[first:last] - lo] = True
        word = ~space
        starts = np.flatnonzero(word & breaks[:-1])
        ends = np.flatnonzero(word & (breaks[1:] | np.append(space[1:], True))) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_ODD, len(part)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _power(_INVERSE, len(part) + 1)[starts]
        hashes.append(mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_ODD)))
        rows.append(np.searchsorted(bounds, starts + lo, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def sorted_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and made distinct, and how many are left of each row."""
    values = values.copy()
    ends = np.cumsum(counts)
    for end, count in zip(ends[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
        values[end - count : end].sort()
    rows = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.bincount(rows[new], minlength=len(counts))


def shingle_sets(
    hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles of ``width`` words, sorted, and their number.

    A row with fewer words has the whole sequence as its one shingle; one without
    words has none.
    """
    factor = constants(width, 5)
    words = np.bincount(rows, minlength=n_rows)
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    of = np.repeat(np.arange(n_rows), counts)
    short = (words < width)[of]
    out = np.empty(len(of), np.uint64)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total += hashes[i : i + n] * factor[i]
        out[~short] = mix(total)[rows[width - 1 :] == rows[:n]]
    begins = (np.cumsum(words) - words)[of[short]]
    value = words[of[short]].astype(np.uint64) * np.uint64(_ODD)
    for i in range(width - 1):
        has = words[of[short]] > i
        value[has] += hashes[begins[has] + i] * factor[i]
    out[short] = mix(value)
    return sorted_sets(out, counts)
