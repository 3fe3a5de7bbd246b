"""Vectorised word hashing over Arrow text columns: no Python object is made for a word or a shingle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes whose rows are handled together; a longer text is a block of its own.
BLOCK = 1 << 18

#: Bytes whose words are hashed together; only a longer word makes a piece longer.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made longer on demand; those beyond a piece are not kept."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) >= n:
            return cls.up, cls.down
        base = np.ones((2, n + 1), np.uint64)
        base[0, 1:], base[1, 1:] = _ODD, _INVERSE
        up, down = np.cumprod(base, axis=1)
        if n <= 2 * PIECE:
            cls.up, cls.down = up, down
        return up, down


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def blocks(at: np.ndarray):
    """Runs of rows ``(first, last)`` of about BLOCK bytes."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield first, last
        first = last


def _pieces(data: np.ndarray, at: np.ndarray):
    """Ranges ``(lo, hi)`` of about ``PIECE`` bytes that end where no word goes on."""
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data):
            end = int(np.searchsorted(at, hi))
            gaps = np.flatnonzero(_SPACE[data[hi : hi + PIECE]])
            stop = min(at[end] if end < len(at) else len(data), hi + int(gaps[0]) if len(gaps) else len(data))
            if len(gaps) or stop <= hi + PIECE:
                hi = int(stop)
                break
            hi = min(hi + PIECE, len(data))
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some rows, and the n + 1 offsets of the rows' words among them.

    A hash is the sum of a random number for each byte times a power of an odd base, modulo 2**64, and its length.
    """
    hashes, begins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for lo, hi in _pieces(data, at):
        rows = at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo
        found, starts = _words(data[lo:hi], rows, lower)
        hashes.append(found)
        begins.append(starts + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), at)


def _words(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a piece in which rows begin at ``at``."""
    if lower:
        data = _LOWER[data]
    gap = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True  # a row's first byte starts a word even if no space comes before
    cut[[0, -1]] = True
    inside = ~gap
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = _Powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    found = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mix(found), starts


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a row, with the rows' offsets; a shorter row is one shingle."""
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = at[:-1][row] + np.arange(to[-1]) - to[:-1][row]
    out = np.full(len(first), 0x5851F42D4C957F2D, np.uint64)
    length = np.minimum(n, size)[row]
    for k in range(size):
        has = length > k
        out[has] = mix(out[has] * np.uint64(_ODD) + hashes[first[has] + k])
    return mix(out ^ length.astype(np.uint64)), to


def sets(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, with the rows' offsets."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(at) - 1))])
