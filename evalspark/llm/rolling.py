"""Rolling hashes over byte arrays, vectorised: any substring's hash is the difference
of two prefix sums, and a window's smallest k-gram is a sliding minimum."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _RNG.integers(0, 1 << 64, size=(2, 256), dtype=np.uint64, endpoint=False)
_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have an inverse
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the multiplier and of its inverse modulo 2 ** 64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        made = []
        for m in (_MULT[which], pow(_MULT[which], -1, 1 << 64)):
            steps = np.full(size, np.uint64(m), dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        have = _POWERS[which] = (made[0], made[1])
    return have


class Prefix:
    """Prefix sums of one byte array for one of two independent hashes."""

    def __init__(self, raw: np.ndarray, which: int):
        power, self.inverse = _powers(which, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[which][raw] * power[:len(raw)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``raw[start:end]``; equal bytes give equal hashes."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:size + n] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (size - done)], x[size - done:]) if done < size else x
