"""Words and shingles of a text as arrays of 64-bit hashes, computed over bytes without a Python loop."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x5851F42D4C957F2D)  # odd, so that its powers have inverses modulo 2**64
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.int8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_numbers = np.arange(1 << 16, dtype=np.int64)
_PLACES = 64
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, r))]) for r in (_R, _R_INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _drawn(cell: np.ndarray) -> np.ndarray:
    """A number for each byte at each place of a word, as if drawn at random."""
    return mix(mix(cell.astype(np.uint64) + _R) ^ _M2)


_TABLE = _drawn(np.arange(_PLACES * 256))


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of each run without ASCII white space; the case of A-Z doesn't count.

    A word's hash is the sum of the numbers drawn for its bytes at their places, so that two words, whatever their length
    and pattern, have the same one by chance only."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(len(raw) + 2, np.int8)
    np.take(_WORD, raw, out=inside[1:-1])
    step = np.diff(inside)
    starts, ends = (step == 1).nonzero()[0], (step == -1).nonzero()[0]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    # the place of each byte in its word, times 256, plus the byte
    cell = np.zeros(len(raw), np.int64)
    cell[starts] = starts
    np.maximum.accumulate(cell, out=cell)
    np.subtract(_counted(len(raw)), cell, out=cell)
    np.left_shift(cell, 8, out=cell)
    np.bitwise_or(cell, _LOWER[raw], out=cell)
    drawn = _TABLE.take(cell, mode="clip")
    if (ends - starts).max() > _PLACES:
        far = (cell >= len(_TABLE)).nonzero()[0]
        drawn[far] = _drawn(cell[far])
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(drawn, out=total[1:])
    return mix(total[ends] - total[starts]), starts, ends


def _counted(n: int) -> np.ndarray:
    """0 to n - 1, kept for later calls."""
    global _numbers
    if len(_numbers) < n:
        _numbers = np.arange(1 << (n - 1).bit_length(), dtype=np.int64)
    return _numbers[:n]


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring words, in order; of fewer words, one hash of them all; of none, none."""
    if not len(ids):
        return ids
    if len(ids) < n:
        return shingles(ids, len(ids)) ^ np.uint64(len(ids))
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out ^ ids[k : len(ids) - n + 1 + k]) + np.uint64(k)
    return out


class Members:
    """Which of many hashes are in a set: a bit table first, then a search."""

    def __init__(self, members: np.ndarray) -> None:
        self.sorted = np.unique(members.astype(np.uint64))
        size = 1 << max(16, (8 * max(1, len(self.sorted)) - 1).bit_length())
        self.mask, self.bits = np.uint64(size - 1), np.zeros(size, bool)
        self.bits[(self.sorted & self.mask).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.bits[(hashes & self.mask).astype(np.int64)]
        at = out.nonzero()[0]
        if len(at):
            k = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
            out[at] = self.sorted[k] == hashes[at]
        return out
