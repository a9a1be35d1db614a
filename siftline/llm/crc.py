"""CRC-32 of many overlapping byte spans at once, from tables of a byte's part by its distance from the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Distances from the end that the table has; longer spans are folded in blocks of this size.
BLOCK = 64
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
#: Bytes of spans that are worked on together, which bounds memory for texts of any length.
_TOGETHER = 2_000_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``parts[d * 256 + b]``: what byte b adds to the register when d bytes follow it; ``starts[n]``: what the
    register's first value has become after n bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1)
    parts = np.empty((BLOCK, 256), np.uint32)
    parts[0] = first
    for d in range(1, BLOCK):
        parts[d] = first[parts[d - 1] & 255] ^ (parts[d - 1] >> 8)
    starts = np.empty(BLOCK + 1, np.uint32)
    starts[0] = _ONES
    for n in range(1, BLOCK + 1):
        starts[n] = first[starts[n - 1] & 255] ^ (starts[n - 1] >> 8)
    return parts.ravel(), starts


PARTS, STARTS = _tables()


def _short(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers after spans of 1 to BLOCK bytes."""
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    at = np.arange(ends[-1], dtype=np.int32)
    after = np.repeat((ends - 1).astype(np.int32), sizes) - at  # bytes that follow in the span
    at += np.repeat((starts - firsts).astype(np.int32), sizes)
    after *= 256
    after += data[at]
    return np.bitwise_xor.reduceat(PARTS[after], firsts) ^ STARTS[sizes]


def _long(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers after longer spans: a first block of what is left over, then whole blocks, each folded onto the register."""
    head = (sizes - 1) % BLOCK + 1
    register = _short(data, starts, head)
    at, left = starts + head, (sizes - head) // BLOCK
    distance = np.arange(BLOCK - 1, -1, -1, dtype=np.int64) * 256
    active = np.nonzero(left)[0]
    while len(active):
        bytes_ = data[at[active, None] + np.arange(BLOCK)].astype(np.int64)
        for k in range(4):  # the register's bytes act on the block's first four
            bytes_[:, k] ^= (register[active] >> np.uint32(8 * k)) & np.uint32(255)
        register[active] = np.bitwise_xor.reduce(PARTS[bytes_ + distance], axis=1)
        at[active] += BLOCK
        left[active] -= 1
        active = active[left[active] > 0]
    return register


def _chunks(which: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Cut ``which`` where its sizes sum up to about _TOGETHER."""
    if len(which):
        yield from np.split(which, np.nonzero(np.diff(np.cumsum(sizes[which]) // _TOGETHER))[0] + 1)


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[starts[i] : starts[i] + sizes[i]]`` for every i; spans may overlap or be empty.

    CRC-32 is linear: the register after a span is the XOR of one table entry for each byte, by
    the byte's distance from the span's end, and of a constant for the span's length.
    """
    register = np.full(len(starts), _ONES, np.uint32)
    for some in _chunks(np.nonzero((sizes > 0) & (sizes <= BLOCK))[0], sizes):
        register[some] = _short(data, starts[some], sizes[some])
    for some in _chunks(np.nonzero(sizes > BLOCK)[0], np.full(len(sizes), BLOCK)):
        register[some] = _long(data, starts[some].astype(np.int64), sizes[some])
    return register ^ _ONES
