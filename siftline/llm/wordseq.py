"""Word sequences of one text as numpy arrays: bounds, hashes, sequence hashes, minimisers."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd multiplier, so that its powers can be inverted modulo 2**64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(m, -1, 1 << 64) for m in MULTIPLIERS)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse; kept, as most texts need the same few."""
    known = _POWERS.get(which)
    if known is None or len(known[0]) < size:
        made = []
        for base in (MULTIPLIERS[which], _INVERSES[which]):
            steps = np.full(max(size, 4096), base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[which] = known = (made[0], made[1])
    return known[0][:size], known[1][:size]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


class Sequence:
    """Hashes of any run of words of one text, after one pass over the words."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        self.which, self.size = which, len(hashes)
        _, inverse = powers(which, self.size + 1)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(hashes * inverse[: self.size], out=self.sums[1:])

    def runs(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The hash of the ``length`` words from each start."""
        power, _ = powers(self.which, self.size + 1)
        return mixed((self.sums[starts + length] - self.sums[starts]) * power[starts])


def minimisers(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its smallest one, the leftmost if several are."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(values, width)
    return np.arange(len(windows)) + windows.argmin(axis=1)
