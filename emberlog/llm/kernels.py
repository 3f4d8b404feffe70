"""Vectorised hashing of words and byte windows, used inside tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
Hashes are 64-bit, equal for equal words in every process.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_RAW = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_WORD = _RAW.copy()
_WORD[65:91] = _WORD[97:123]
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows in ``data``, and each row's offsets into them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    row_start = np.zeros(n + 1, bool)
    row_start[offsets[offsets <= n]] = True
    row_start[n] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | row_start[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | row_start[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(1 << max(10, int(n).bit_length()))
    sums = np.zeros(n + 1, U64)
    np.cumsum(_WORD[data] * up[:n], out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return hashed, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one row; a shorter row is one run, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        out = np.zeros(1, U64)
        for h in hashes:
            out = mix(out * _BASE + h)
        return mix(out + U64(n))
    out = np.zeros(n - width + 1, U64)
    for j in range(width):
        out = out * _BASE + hashes[j : n - width + 1 + j]
    return mix(out)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-byte windows of ``data``; ``width`` is a power of two."""
    h = _RAW[data]
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < width:
        if len(h) <= step:
            return np.zeros(0, U64)
        h = h[:-step] * U64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    return mix(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    if len(values) < width:
        return values[:0]
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as byte planes of their differences: near 5.5 bytes a key when there are many."""
    if len(keys) == 0:
        return b""
    diff = np.diff(keys, prepend=U64(0))
    planes = diff.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = max(1, 8 - int(np.argmax(planes[:, ::-1].any(0))) if planes.any() else 1)
    return bytes([used]) + planes[:, :used].T.tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, U64)
    used = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(used, -1)
    diff = np.zeros((planes.shape[1], 8), np.uint8)
    diff[:, :used] = planes.T
    return np.cumsum(diff.view("<u8").ravel().astype(U64), dtype=U64)
